"""Embeddings as array columns: cleaning, 8-bit codes, similarity, exact top-k for a query table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from skein.functions.text import terms

#: A query side of more rows than this is not broadcast.
BROADCAST_ROWS = 2_000


def usable(vector: Column, dim: int) -> Column:
    """Of the wanted length, finite, not all zero; others are invalid and wait for a new vector."""
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """In double; vectors of different or no length give 0."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)


def quantised(vector: Column) -> Column:
    """struct<scale, q>: scale is the largest magnitude / 127 (1 for a zero vector), q whole steps of it in -127..127."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    q = F.transform(vector, lambda x: F.least(F.greatest(F.round(x.cast("double") / scale), F.lit(-127.0)), F.lit(127.0)).cast("int"))
    return F.when(vector.isNotNull(), F.struct(scale.alias("scale"), q.alias("q")))


def restored(code: Column) -> Column:
    return F.transform(code["q"], lambda q: q * code["scale"])


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank) of the exact k best by dot product, ties by key.

    queries: (query, v); corpus: (key, v). A query table of checked size is broadcast and meets every row of
    the corpus in place; a larger one is cut into blocks that are joined by block number, so neither side is
    ever held whole. Null and mismatched vectors score 0.
    """
    n = queries.limit(BROADCAST_ROWS + 1).count()
    q = queries.select("query", F.col("v").alias("qv"))
    if n <= BROADCAST_ROWS:
        pairs = corpus.crossJoin(F.broadcast(q))
    else:
        blocks = max(2, -(-queries.count() // BROADCAST_ROWS))
        q = q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        pairs = corpus.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(q, "block")
    scored = pairs.select("query", "key", dot(F.col("v"), F.col("qv")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A text's vector without a model: its terms hashed to signed places, counted, of unit length. Replaceable by embed_with().

    One Arrow batch a call; an empty text gives a zero vector, null gives null.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for hashes in batch:
                if hashes is None:
                    out.append(None)
                    continue
                h = np.asarray(hashes, np.int64).view(np.uint64)
                v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0), dim).astype(np.float32)
                length = np.linalg.norm(v)
                out.append(v / length if length else v)
            yield pd.Series(out)

    return run(F.when(text.isNotNull(), F.transform(terms(text), lambda t: F.xxhash64(t))))


def embed_with(df: DataFrame, text: str, model, dim: int, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Vectors of a model: a picklable factory of a function from a list of texts to a matrix; it is made once a worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            rows: list = []
            for k in range(0, len(texts), batch):
                rows += list(np.asarray(encode(texts.iloc[k : k + batch].fillna("").tolist()), np.float32).reshape(-1, dim))
            yield pd.Series(rows)

    return df.withColumn(name, run(F.col(text)))


def backfilled(df: DataFrame, text: str, vector: str, dim: int, *, force: bool = False) -> DataFrame:
    """The table with a vector in every row: only missing or unusable ones are made anew, or all with force."""
    ok = F.lit(False) if force else usable(F.col(vector), dim)
    kept = df.filter(ok)
    return kept.unionByName(df.filter(~ok).withColumn(vector, hashed_embedding(F.col(text), dim)))


#: Bits of a signature, and how many nearest by them the approximate lane gives.
BITS, NEAR = 64, 200


def signature(vector: Column, dim: int, seed: int = 11) -> Column:
    """64 signs of a vector's products with fixed random planes; the more of them two vectors share, the smaller their angle. Null for unusable vectors.

    A stored column: adding or removing vectors adds or removes rows, nothing is rebuilt.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(seed).standard_normal((dim, BITS)).astype(np.float32)
        weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for batch in batches:
            ok = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype="Int64")
            if ok.any():
                signs = np.stack(batch[ok].to_list()).astype(np.float32) @ planes > 0
                out[ok] = (signs * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield out

    return run(F.when(usable(vector, dim), vector))


def approximate(queries: DataFrame, corpus: DataFrame, top: int = NEAR) -> DataFrame:
    """(query, key) of the `top` nearest by signature, ties by key: eight bytes a vector are read instead of all of it.

    queries: (query, s), of a checked size; corpus: (key, s). Rows without a signature are left out.
    """
    q = queries.filter("s is not null").select("query", F.col("s").alias("qs"))
    if q.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} queries: ask them in parts")
    far = corpus.filter("s is not null").crossJoin(F.broadcast(q)).select("query", "key", F.bit_count(F.col("s").bitwiseXOR(F.col("qs"))).alias("far"))
    w = Window.partitionBy("query").orderBy("far", "key")
    return far.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("query", "key")

"""Vectors: validity, 8-bit codes, similarity, top-k, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import vectors as V
from skein.tables import memories, table


def cache(s, d):
    rows = table(s, d, "query_cache").select("text_hash", F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(V.usable(F.col("v"), 96)).groupBy("text_hash").agg(F.min("v").alias("v"))


def vector_validity(s, d):
    state = F.when(F.col("embedding").isNull(), "pending").when(F.size("embedding") != 96, "wrong_length").when(V.usable(F.col("embedding"), 96), "usable").otherwise("zero")
    return table(s, d, "query_cache").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def vector_quantised(s, d):
    q = V.quantised(F.col("v"))
    return cache(s, d).select("text_hash", F.round(q["scale"], 6).alias("scale"), F.aggregate(q["q"], F.lit(0), lambda a, x: a + x).alias("sum_q"))


def vector_quantise_error(s, d):
    """Largest error of a restored value, as it is and in steps of the scale (never above a half)."""
    q = V.quantised(F.col("v"))
    worst = F.array_max(F.zip_with("v", V.restored(q), lambda a, b: F.abs(a - b))) / q["scale"]
    return cache(s, d).agg(F.count(F.lit(1)).alias("vectors"), F.round(F.max(worst), 6).alias("steps"), F.round(F.max(worst * q["scale"]), 9).alias("error"))


def embeddings(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))


def vector_top10(s, d):
    """The exact ten nearest of every fiftieth vector, against all."""
    e = embeddings(s, d)
    found = V.top_k(e.filter("key % 50 = 0").toDF("query", "v"), e, 10)
    return found.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_top10_quantised(s, d):
    """The ten nearest of the same vectors over 8-bit codes."""
    e = embeddings(s, d)
    coded = e.select("key", V.restored(V.quantised(F.col("v"))).alias("v"))
    near = V.top_k(e.filter("key % 50 = 0").toDF("query", "v"), coded, 10)
    return near.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_approximate(s, d):
    """Of every fiftieth vector, how many of the exact ten nearest the signatures bring among the nearest 200."""
    e = embeddings(s, d)
    signed = e.withColumn("s", V.signature(F.col("v"), 64))
    near = V.approximate(signed.filter("key % 50 = 0").select(F.col("key").alias("query"), "s"), signed.select("key", "s"))
    exact = V.top_k(e.filter("key % 50 = 0").toDF("query", "v"), e, 10).select("query", "key")
    return exact.join(near.withColumn("hit", F.lit(1)), ["query", "key"], "left").groupBy("query").agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("kept"))


def embed_texts(s, d):
    e = memories(s, d).select("id", V.hashed_embedding(F.col("content")).alias("v"))
    return e.select("id", F.transform("v", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def embed_backfill(s, d):
    cached = table(s, d, "query_cache").select("text_hash", "embedding")
    return V.backfilled(cached, "text_hash", "embedding", 96).agg(F.count(F.lit(1)).alias("rows"), F.count_if(V.usable(F.col("embedding"), 96)).alias("usable"))


QUERIES = {f.__name__: f for f in (vector_validity, vector_quantised, vector_quantise_error, vector_top10, vector_top10_quantised, vector_approximate, embed_texts, embed_backfill)}

CACHE = """c AS (SELECT text_hash, min(CAST(embedding AS DOUBLE[])) AS v FROM query_cache WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
SCALE = "list_max(list_transform(v, lambda x: abs(x))) / 127"
SQL = {
    "vector_validity": """SELECT CASE WHEN embedding IS NULL THEN 'pending' WHEN len(embedding) <> 96 THEN 'wrong_length' WHEN len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN 'usable' ELSE 'zero' END AS state, count(*) AS n FROM query_cache GROUP BY 1""",
    "vector_quantised": f"WITH {CACHE}, s AS (SELECT text_hash, v, {SCALE} AS scale FROM c) SELECT text_hash, round(scale, 6) AS scale, CAST(list_sum(list_transform(v, lambda x: round(x / scale))) AS INTEGER) AS sum_q FROM s",
    "vector_quantise_error": f"WITH {CACHE}, x AS (SELECT v, {SCALE} AS scale FROM c), y AS (SELECT scale, list_max(list_transform(v, lambda x: abs(x - round(x / scale) * scale))) AS worst FROM x) SELECT count(*) AS vectors, round(max(worst / scale), 6) AS steps, round(max(worst), 9) AS error FROM y",
    "vector_top10": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
        SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "vector_top10_quantised": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT vec_id, v, list_transform(v, lambda x: round(x / ({SCALE})) * ({SCALE})) AS w FROM e), p AS (SELECT a.vec_id AS query, b.vec_id, list_dot_product(a.v, b.w) AS score FROM k a, k b WHERE a.vec_id % 50 = 0)
        SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "embed_backfill": "SELECT count(*) AS rows, count(*) AS usable FROM query_cache",
}

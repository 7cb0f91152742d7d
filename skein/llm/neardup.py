"""Problem 2: texts of one group that share at least a given part of their words.

Method: vantage-point trees over fingerprints under Hamming distance. The word set of a text is spread over
B segments by word hash; a segment's fingerprint is 64 bits, one bit flipped per word. Two sets that differ
in d words differ in at most d bits, and in some segment in at most d/B bits, so no pair is lost. A
similarity of t bounds d by (1-t)/(1+t) of the sizes' sum. For each (group, size class, segment) the
fingerprints form a vantage-point tree: a distance to the vantage point and its median part them, and a
query goes to both sides only where its radius crosses the boundary (triangle inequality). The upper levels
of the tree are the shards of hot groups, and a text is sent as a query to every shard that its radius
overlaps. Candidates are checked exactly on the word hashes.

Equal word sets are one class from the start, so copies cost nothing; the number of segments grows with the
size class, so the radius in a segment stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.session import cut, stored

THRESHOLD = 0.8
#: A shard of more fingerprints than this is split by vantage points.
SHARD = 20_000
#: Bounds of what the driver holds for that: fingerprints sampled of a size class, groups known by name, levels.
SAMPLE, NAMED, DEEPEST = 2_048, 10_000, 12
#: Copies of one class are expanded in blocks of this many.
BLOCK = 1_000
LEAF = 48
#: 64-bit numbers in the fingerprint of a whole set, a power of two.
WHOLE = 8

WORDS = "[^\\p{L}\\p{N}]+"


def word_set(text: Column) -> Column:
    """Distinct maximal runs of letters and digits of the lower-cased text; null is like empty."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS)), "")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_class(n: np.ndarray) -> np.ndarray:
    """0 up to 8 words, then one class for each factor of four."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 8) / 2)).astype(np.int64)


def segments(kind: np.ndarray) -> np.ndarray:
    """Segments of a size class: 1, 2, 8, 32, ...; up to 16 words in each."""
    return np.where(kind > 0, 2 * 4 ** np.maximum(kind - 1, 0), 1).astype(np.int64)


class Radius:
    """Largest differences that a similarity of t allows."""

    def __init__(self, t: float) -> None:
        self.t, self.part = t, (1 - t) / (1 + t)

    def pair(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.floor((n + m) * self.part + 1e-9).astype(np.int64)

    def query(self, n: np.ndarray) -> np.ndarray:
        """Against any partner: the largest has n/t words."""
        return np.floor(n * (1 + 1 / self.t) * self.part + 1e-9).astype(np.int64)


def fingerprints(hashes: np.ndarray, row: np.ndarray, rows: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment fingerprints of all rows one after another, fingerprint of the whole set of each row in WHOLE numbers)."""
    first = np.concatenate([[0], np.cumsum(parts)])
    segs, whole = np.zeros(first[-1], np.uint64), np.zeros(WHOLE * rows, np.uint64)
    x = _mix(hashes.view(np.uint64))
    at = first[row] + (x % parts[row].astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(segs, at, np.uint64(1) << ((x >> np.uint64(40)) & np.uint64(63)))
    place = ((x >> np.uint64(56)) % np.uint64(WHOLE)).astype(np.int64)
    np.bitwise_xor.at(whole, WHOLE * row + place, np.uint64(1) << ((x >> np.uint64(50)) & np.uint64(63)))
    return segs, whole.reshape(rows, WHOLE)


def folded(whole: np.ndarray, kind: int) -> np.ndarray:
    """Whole fingerprints as wide as a size class needs: 128 bits up to class 2, then twice as many for each, up to WHOLE numbers."""
    width = min(WHOLE, 2 ** max(1, kind - 1))
    return np.bitwise_xor.reduce(whole.reshape(len(whole), -1, width), axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints; the numbers of whole sets lie in the last axis."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    return d.sum(axis=-1) if a.ndim > 1 else d


def vantage_pairs(fp: np.ndarray, whole: np.ndarray, n: np.ndarray, home: np.ndarray, parts: int, radius: Radius) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of a shard, at least one of each pair at home in it.

    fp, whole and n describe rows of one segment. The tree is built over the rows at home and walked by all
    rows at once. Where the segment's fingerprints are all alike, the whole sets' fingerprints part the rows.
    """
    out_a, out_b = [], []
    r = radius.query(n)
    e = r // parts
    stack = [(np.flatnonzero(home), np.arange(len(fp)), False)]
    while stack:
        data, query, alike = stack.pop()
        if len(data) == 0 or len(query) == 0:
            continue
        if len(data) > LEAF:
            values, reach = (whole, r) if alike else (fp, e)
            point = values[data[len(data) // 2]]
            d, q = (distance(values[i], point) for i in (data, query))
            middle = np.median(d)
            inner = d <= middle
            if inner.all():
                middle = middle - 1
                inner = d <= middle
            if inner.any() and not inner.all():
                reach = reach[query]
                stack.append((data[inner], query[q - reach <= middle], alike))
                stack.append((data[~inner], query[q + reach > middle], alike))
                continue
            if not alike:
                stack.append((data, query[q <= d[0] + e[query]], True))
                continue
        step = max(1, (1 << 21) // len(data))
        for k in range(0, len(query), step):
            part = query[k : k + step]
            a, b = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[data][None, :]) <= e[part][:, None])
            a, b = part[a], data[b]
            big, small = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
            ok = radius.pair(n[a], n[b])
            ok = (np.bitwise_count(fp[a] ^ fp[b]) <= ok // parts) & (distance(whole[a], whole[b]) <= ok) & (small + 1e-9 >= radius.t * big) & (a != b) & ((a < b) | ~home[a])
            out_a.append(a[ok])
            out_b.append(b[ok])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def build_top(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The upper levels of a tree as (vantage point, boundary), in heap order; points and medians come of the sample."""
    nodes: list[tuple[int, int]] = []
    parts = [sample]
    for _ in range(depth):
        below = []
        for p in parts:
            if len(p) < 2:
                p = sample
            point = p[len(p) // 2]
            d = np.bitwise_count(p ^ point).astype(np.int64)
            middle = int(np.median(d))
            nodes.append((int(point), middle))
            below += [p[d <= middle], p[d > middle]]
        parts = below
    return nodes


def route(fp: np.ndarray, e: np.ndarray, depth: np.ndarray, top: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) for every shard that a row's radius overlaps."""
    row, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    if not top:
        return row, node, home
    points, middles = np.array([p for p, _ in top], np.uint64), np.array([m for _, m in top], np.int64)
    for level in range(int(depth.max(initial=0))):
        go = depth[row] > level
        still = (row[~go], node[~go], home[~go])
        row, node, home = row[go], node[go], home[go]
        d = np.bitwise_count(fp[row] ^ points[node]).astype(np.int64)
        inner = d <= middles[node]
        left, right = d - e[row] <= middles[node], d + e[row] > middles[node]
        row, node, home = (
            np.concatenate([still[0], row[left], row[right]]),
            np.concatenate([still[1], 2 * node[left] + 1, 2 * node[right] + 2]),
            np.concatenate([still[2], home[left] & inner[left], home[right] & ~inner[right]]),
        )
    return row, node, home


def _unpack(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, row of each) of a list<long> column."""
    column = batch.column(name)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def keyed(df: DataFrame, key: str, text: str, group: Column | None = None) -> DataFrame:
    """(key, grp, words, cls) of every row with words: its distinct words in order, and the class of its group and words.

    Written once to the shared folder: members, classes, counts and samples are all read from there, each its own columns.
    """
    g = F.coalesce(F.concat(F.lit("="), group), F.lit("")) if group is not None else F.lit("")
    # told from the text, since a condition on the words would make them twice
    rows = df.filter(df[text].rlike("[\\p{L}\\p{N}]")).select(df[key].alias("key"), g.alias("grp"), F.concat_ws(" ", F.sort_array(word_set(df[text]))).alias("words"))
    return stored(rows.withColumn("cls", F.unhex(F.md5(F.concat_ws("\n", "grp", "words")))))


class Top(NamedTuple):
    """How hot groups are split: levels by group, levels of any other, upper tree and share of each leaf by size class, rows by group."""

    depth: dict[int, int]
    other: int
    trees: dict[int, list[tuple[int, int]]]
    share: dict[int, list[np.ndarray]]
    rows: dict[int, int]
    rest: int
    shard: int

    def blocks(self, grp: np.ndarray, kind: int, depth: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Blocks of the leaf that each row went to: one for each `shard` rows that the sample lets expect there."""
        share = np.zeros(len(node))
        for level, s in enumerate(self.share.get(kind, [])):
            at = depth == level
            share[at] = s[node[at] - (2**level - 1)]
        count = np.array([self.rows.get(int(g), self.rest) for g in grp], np.float64)
        return np.maximum(1, np.ceil(count * share / self.shard)).astype(np.int64)


NOWHERE = Top({}, 0, {}, {}, {}, 0, 1)


def top_levels(rows: DataFrame, shard: int = SHARD) -> Top:
    """How the hot groups of keyed() rows are split. Splitting loses nothing in any form, so a sample will do for medians
    and shares, and counts of rows for counts of classes. The driver holds at most NAMED groups and SAMPLE texts.
    """
    hot = rows.groupBy(F.xxhash64("grp").alias("grp")).count().filter(F.col("count") > shard).orderBy(F.desc("count")).limit(NAMED).collect()
    if not hot:
        return NOWHERE
    level = lambda count: min(DEEPEST, int(np.ceil(np.log2(count / shard))))
    depth = {r["grp"]: level(r["count"]) for r in hot}
    rest = hot[-1]["count"] if len(hot) == NAMED else 0  # groups beyond those known by name are no larger
    some = rows.select("cls", "words").orderBy("cls").limit(SAMPLE).select(F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))
    values = [np.array(r["h"], np.int64) for r in some.collect()]
    kinds, trees, share = size_class(np.array([len(v) for v in values])), {}, {}
    deepest = max(depth.values())
    for k in np.unique(kinds):
        chosen = [v for v, x in zip(values, kinds, strict=True) if x == k]
        row = np.repeat(np.arange(len(chosen)), [len(v) for v in chosen])
        segs, _ = fingerprints(np.concatenate(chosen), row, len(chosen), np.full(len(chosen), segments(np.array([k]))[0]))
        trees[int(k)] = build_top(segs[:: max(1, len(segs) // SAMPLE)], deepest)
        share[int(k)] = []
        for d in range(deepest + 1):
            _, node, home = route(segs, np.zeros(len(segs), np.int64), np.full(len(segs), d), trees[int(k)])
            share[int(k)].append(np.bincount(node[home] - (2**d - 1), minlength=2**d) / len(segs) * (len(chosen) / len(values)))
    return Top(depth, level(rest) if rest else 0, trees, share, {r["grp"]: r["count"] for r in hot}, rest, shard)


def class_links(rows: DataFrame, *, threshold: float = THRESHOLD, top: Top = NOWHERE) -> DataFrame:
    """(cls_a, cls_b) of the pairs of classes of one group with at least the threshold; exact, on 64-bit hashes of the words.

    rows: what keyed() gives; top: what top_levels() gives. The classes are shuffled once, by their id, and
    that exchange serves the shards and both sides of the check.
    """
    radius = Radius(threshold)
    # the filter that joins imply, said here, leaves all plans over the classes alike, so that they share one exchange
    found = rows.filter("cls is not null").groupBy("cls").agg(F.first("grp").alias("grp"), F.first("words").alias("words"))
    known = rows.sparkSession.sparkContext.broadcast(top)  # bounded by NAMED, DEEPEST and SAMPLE

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, row = _unpack(batch, "h")
            n = np.bincount(row, minlength=batch.num_rows)
            grp, cls = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("cls")
            kinds = size_class(n)
            below = size_class(np.floor(n * threshold + 1e-9).astype(np.int64)) < kinds  # a smaller partner may be in the class below
            deep = np.array([top.depth.get(int(g), top.other) for g in grp], np.int64)
            for shift, mine in ((0, np.arange(len(n))), (1, np.flatnonzero(below))):
                if not len(mine):
                    continue
                kind = kinds[mine] - shift
                parts = segments(kind)
                place = np.full(len(n), -1)
                place[mine] = np.arange(len(mine))
                keep = place[row] >= 0
                fp, whole = fingerprints(hashes[keep], place[row[keep]], len(mine), parts)
                own = np.repeat(np.arange(len(mine)), parts)
                seg = np.arange(len(fp)) - np.repeat(np.cumsum(parts) - parts, parts)
                e = (radius.query(n[mine]) // parts)[own]
                for k in np.unique(kind):
                    at = np.flatnonzero(kind[own] == k)
                    r, leaf, home = route(fp[at], e[at], deep[mine][own[at]], top.trees.get(int(k), []))
                    r = at[r]
                    o = own[r]
                    block = np.zeros(len(r), np.int64)
                    if top.trees:  # a leaf of many rows, alike ones among them, is cut into blocks; everyone asks all of them
                        many = top.blocks(grp[mine][o], int(k), deep[mine][o], leaf)
                        r, o, leaf, home, mod = (np.repeat(x, many) for x in (r, o, leaf, home, many))
                        block = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                        home = home & (block == (_mix(np.bitwise_xor.reduce(whole[o] * np.arange(1, 2 * WHOLE, 2, dtype=np.uint64), axis=1)) % mod.astype(np.uint64)).astype(np.int64))
                    with np.errstate(over="ignore"):
                        shard = _mix(_mix(_mix(grp[mine][o].view(np.uint64) + np.uint64(k)) + seg[r].astype(np.uint64)) + (leaf + (block << 32)).astype(np.uint64))
                    info = n[mine][o] * 256 + k * 2 + (home & (shift == 0))
                    wide = folded(whole, int(k))[o]
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * wide.shape[1]), len(o), [None, pa.py_buffer(np.ascontiguousarray(wide))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([cls.take(pa.array(mine[o])), pa.array(shard.view(np.int64)), pa.array(fp[r].view(np.int64)), packed, pa.array(info)], ["cls", "shard", "fp", "whole", "info"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard after another: the rows come sorted by shard."""
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            shard, fp, info = (t.column(c).to_numpy() for c in ("shard", "fp", "info"))
            cls, whole = (t.column(c).combine_chunks() for c in ("cls", "whole"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                sets = np.frombuffer(b"".join(whole[a:b].to_pylist()), np.uint64).reshape(b - a, -1)
                i, j = vantage_pairs(
                    fp[a:b].view(np.uint64), sets, info[a:b] // 256, (info[a:b] & 1).astype(bool), int(segments(np.array([(info[a] % 256) // 2]))[0]), radius
                )
                if len(i):
                    yield pa.RecordBatch.from_arrays([cls.take(pa.array(a + i)), cls.take(pa.array(a + j))], ["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            shard = rest.column("shard").to_numpy()
            end = np.searchsorted(shard, shard[-1])  # the last shard may go on
            if end:
                yield from pairs(rest.slice(0, end))
                rest = rest.slice(end)
        if rest is not None:
            yield from pairs(rest)

    hashed = found.select("cls", F.xxhash64("grp").alias("grp"), F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))
    spread = hashed.mapInArrow(shards, "cls binary, shard long, fp long, whole binary, info long")
    hits = spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "x binary, y binary")
    candidates = hits.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b")).distinct()
    a, b = (found.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cls", "grp", "words"))) for s in "ab")
    both = candidates.join(a, "cls_a").join(b, "cls_b").filter("cls_a <> cls_b")
    u, v = (F.transform(F.split(w, " "), lambda x: F.xxhash64(x)) for w in ("words_a", "words_b"))
    # c common of s in all: c / (s - c) >= t, said so that the costly side stands once
    # and the groups, which differ only where shards' hashes collide, must not become a key of the join
    enough = F.when(F.col("grp_a") == F.col("grp_b"), F.size(F.array_intersect(u, v))).otherwise(0) >= (F.size(F.split("words_a", " ")) + F.size(F.split("words_b", " "))) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)
    return both.filter(enough).select("cls_a", "cls_b")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b) of all members of linked classes and of one class, the smaller key first.

    Members of a class are numbered into blocks by hash, and blocks are paired, so that a class with many
    copies is spread over many tasks.
    """
    blocks = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select("cls", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n")
    placed = members.join(blocks, "cls").select("cls", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    between = (
        links.select("cls_a", "cls_b")
        .join(blocks.select(F.col("cls").alias("cls_a"), F.col("blocks").alias("na")), "cls_a")
        .join(blocks.select(F.col("cls").alias("cls_b"), F.col("blocks").alias("nb")), "cls_b")
    )
    within = blocks.filter("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.col("blocks").alias("na"), F.col("blocks").alias("nb"))
    grid = (
        between.unionByName(within)
        .withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .filter("cls_a <> cls_b or block_a <= block_b")
    )
    left = placed.select(F.col("cls").alias("cls_a"), F.col("block").alias("block_a"), F.col("key").alias("x"))
    right = placed.select(F.col("cls").alias("cls_b"), F.col("block").alias("block_b"), F.col("key").alias("y"))
    joined = grid.select("cls_a", "block_a", "cls_b", "block_b").join(left, ["cls_a", "block_a"]).join(right, ["cls_b", "block_b"])
    kept = joined.filter("x <> y and (cls_a <> cls_b or block_a < block_b or x < y)")
    return kept.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def similar_pairs(df: DataFrame, key: str, text: str, group: Column | None = None, *, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(key_a, key_b) of all pairs of different keys of one group (null is a group) with similar word sets.

    Null, empty and wordless texts are similar to nothing; repeated rows count once; a key is compared as what
    it is, so keys should be unique up to repeated rows.
    """
    rows = keyed(df, key, text, group)
    links = class_links(rows, threshold=threshold, top=top_levels(rows, shard))
    return expand(rows.select("key", "cls").distinct(), cut(links))


def similar_groups(df: DataFrame, key: str, text: str, group: Column | None = None, *, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(key, class_id, group_id, n_copies, n_links) of every key with words.

    Equal word sets share class_id; linked classes share group_id; n_copies counts the class, n_links the
    other classes it is similar to.
    """
    rows = keyed(df, key, text, group)
    members = rows.select("key", "cls").distinct()
    links = class_links(rows, threshold=threshold, top=top_levels(rows, shard))
    links = cut(links.select(F.hex("cls_a").alias("a"), F.hex("cls_b").alias("b")))
    parts = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = members.select("key", F.hex("cls").alias("class_id"))
    copies = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
    per_class = copies.join(degree, "class_id", "left").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    per_class = per_class.select("class_id", F.coalesce("component", "class_id").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return named.join(per_class, "class_id").select(F.col("key").alias(key), "class_id", "group_id", "n_copies", "n_links")

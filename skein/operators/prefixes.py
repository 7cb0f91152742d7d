"""Rows whose sets of words may be alike, found by prefixes: numbers in place of words, one shuffle of rows in groups of like size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose words are counted for the order of prefixes, and words whose counts the tasks get.
COUNTED, COMMON = 20_000, 200_000
#: Words of a group before it is split by prefix words, and MB that a task takes up before it looks for pairs.
HOT, HELD_MB = 8_000_000, 32
#: Words that are packed, prefix words that are looked up, and numbers of parities that are compared at a time.
PIECE, LOOKED_UP, BLOCK = 250_000, 500_000, 1_000_000
PACKED = "k int, g long, id long, n int, i int, t binary, s binary"


def _bits(k: int) -> int:
    """Bits of parity of a row in the groups of sizes from 2^k: twice its words at least, so that they tell long rows apart too."""
    return max(256, 4 << k)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One number for several."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
    return x.view(np.int64)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Pieces of the values, each from its start to the next one's."""
    offsets = (np.r_[starts, len(values)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all pieces and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]), np.diff(offsets) // size


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most PIECE words, or of one row."""
    for b in batches:
        ends = np.cumsum(b.column("h").value_lengths().to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield b.slice(at, to - at)
            at = to


def _packed(words: np.ndarray, counts: np.ndarray, threshold: float, hot: np.ndarray, split: np.ndarray) -> Callable:
    """PACKED: a row in the group of its bucket and size, and in those of larger sizes where it may have partners.

    k and g are the group, i says how many of the words t can be the smaller row's, s is the parity of all words. t are the words, rarest
    first, that the row shares with every partner; where partners are larger, fewer do. A hot group is split by the words in t.
    """

    def records(rows: np.ndarray, k: int, n: np.ndarray, first: np.ndarray, h: np.ndarray, ranked: np.ndarray, length: np.ndarray, short: np.ndarray, ids: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        within = lambda size: np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place, rec = within(length[rows]), np.repeat(np.arange(len(rows)), length[rows])
        t = (ranked[first[rows][rec] + place] >> np.uint64(32)).astype(np.uint32)
        group = _mixed(bucket[rows], k)
        at = np.minimum(np.searchsorted(hot, group), max(len(hot) - 1, 0))
        parts = np.where(hot[at] == group, split[at], 1) if len(hot) else np.ones(len(rows), np.int64)
        part = t % parts[rec]
        if (parts > 1).any():
            order = np.lexsort((place, part, rec))
            t, rec, part, place = t[order], rec[order], part[order], place[order]
        starts = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (part[1:] != part[:-1])])
        of = rec[starts]
        wide = _bits(k) // 64
        all_, row = h[np.repeat(first[rows], n[rows]) + within(n[rows])], np.repeat(np.arange(len(rows)), n[rows])
        parity = np.zeros(len(rows) * wide, np.uint64)
        np.bitwise_xor.at(parity, row * wide + ((all_ & np.uint64(64 * wide - 1)) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (all_ & np.uint64(63)))
        whose = rows[of]
        return pa.record_batch({
            "k": np.full(len(of), k, np.int32), "g": _mixed(bucket[whose], k, part[starts]), "id": ids[whose], "n": n[whose].astype(np.int32),
            "i": np.add.reduceat(place < short[rows][rec], starts, dtype=np.int32), "t": _binary(t, starts), "s": _binary(parity.reshape(-1, wide)[of].ravel(), np.arange(len(of)) * wide),
        })

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            lists, ids, bucket = b.column("h"), b.column("id").to_numpy(), b.column("bucket").to_numpy()
            h, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            first = np.r_[0, np.cumsum(n)[:-1]]
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            often = np.where(words[at] == h, counts[at], 0) if len(words) else np.zeros(len(h), np.int64)
            order = np.lexsort((h, often, row))
            h, ranked = h.view(np.uint64), h[order].view(np.uint64)
            whole = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            short = n - np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9).astype(np.int64) + 1
            own = np.frexp(n.astype(float))[1] - 1
            for up in count():
                rows = np.flatnonzero(n >= threshold * np.exp2(own + up) - 1e-9) if up else np.arange(len(n))
                if not len(rows):
                    break
                for k in np.unique(own[rows] + up):
                    yield records(rows[own[rows] + up == k], int(k), n, first, h, ranked, short if up else whole, short, ids, bucket)

    return of


def _met(threshold: float) -> Callable:
    """(a, b) of rows, sorted by k and g, that share a word in a group and whose sizes and parities allow the threshold."""
    apart = (1 - threshold) / (1 + threshold)  # most differing words of two rows, as a share of their words

    def pairs(x: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        ids, n, index = (x.column(c).to_numpy() for c in ("id", "n", "i"))
        n, wide = n.astype(np.int64), _bits(k) // 64
        (t, size), (parity, _) = (_numbers(x.column(c).combine_chunks(), kind) for c, kind in (("t", np.uint32), ("s", np.uint64)))
        parity = parity.reshape(-1, wide)
        row = np.repeat(np.arange(len(n), dtype=np.int32), size)
        first = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size) < index[row]
        parts = -(-len(t) // LOOKED_UP)
        for part in range(parts):
            own = np.flatnonzero((t >> np.uint32(8)) % np.uint32(parts) == part) if parts > 1 else slice(None)
            yield from found(ids, n, parity, t[own], row[own], first[own], k)

    def found(ids: np.ndarray, n: np.ndarray, parity: np.ndarray, t: np.ndarray, row: np.ndarray, first: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """Pairs of rows with a word in common: the smaller one says it among its first words."""
        said = (t.astype(np.uint64) << np.uint64(32)) | n[row].astype(np.uint64)
        small, large = np.flatnonzero(first), np.flatnonzero(n[row] >= 1 << k)  # what only visits the group is the smaller one
        large = large[np.argsort(said[large], kind="stable")]
        small = small[np.argsort(said[small], kind="stable")]
        keys = said[large]
        low = np.searchsorted(keys, said[small], "left")
        most = np.floor(n[row[small]] / threshold + 1e-6).astype(np.uint64)
        many = np.searchsorted(keys, (said[small] & ~np.uint64(0xFFFFFFFF)) | most, "right") - low
        ends, kept, held, at, block = np.cumsum(many), [], 0, 0, max(1, BLOCK // parity.shape[1])
        while at < len(small):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            own = many[at:to]
            i = row[np.repeat(small[at:to], own)].astype(np.int64)
            j = row[large[np.repeat(low[at:to], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]].astype(np.int64)
            other = (n[i] < n[j]) | (i < j)
            i, j = i[other], j[other]
            near = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= apart * (n[i] + n[j]) + 1e-6
            kept.append(np.unique((i[near] << 32) | j[near]))
            held, at = held + len(kept[-1]), to
            if held > BLOCK or at == len(small):
                both = np.unique(np.concatenate(kept))
                kept, held = [], 0
                a, b = ids[both >> 32], ids[both & 0xFFFFFFFF]
                for z in range(0, len(both), 50_000):
                    yield pa.record_batch({"a": np.minimum(a, b)[z : z + 50_000], "b": np.maximum(a, b)[z : z + 50_000]})

    def groups(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(held)
        k = x.column("k").to_numpy()
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for at, to in zip(starts, [*starts[1:], len(k)], strict=True):
            yield from pairs(x.slice(at, to - at), int(k[at]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            g = b.column("g").to_numpy()
            if size > HELD_MB << 20 and g[0] != g[-1]:  # up to the last group, which may go on
                end = int(np.flatnonzero(g != g[-1])[-1]) + 1
                yield from groups([*held[:-1], b.slice(0, end)])
                held = [b.slice(end)]
                size = held[0].nbytes
        if held:
            yield from groups(held)

    return of


def candidates(sets: DataFrame, rows: int, threshold: float, without: DataFrame | None = None) -> DataFrame:
    """(a, b) of ids, a < b, once each: all pairs whose sets have at least the threshold, and some others.

    sets: (id: long, h: the words as 64-bit hashes of word and bucket, not empty, and bucket: long, of which rows of one bucket have the same), a stored
    table of about that many rows. Rows whose id is in `without` are left out. The words of some rows are counted to put rare ones first; any order
    finds all pairs. Equal hashes of unlike words of two rows only add candidates.
    """
    if "bucket" not in sets.columns:
        sets = sets.withColumn("bucket", F.lit(0).cast("long"))
    some = sets.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // COUNTED))) == 0).select(F.explode("h").alias("t"))
    common = some.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy(F.desc("c"), "t").limit(COMMON).toPandas().sort_values("t")
    sizes = sets.groupBy("bucket", (F.length(F.bin(F.size("h"))) - 1).alias("k")).agg(F.sum(F.size("h")).alias("c")).filter(F.col("c") > HOT // 2)
    large = {(r["bucket"], r["k"]): r["c"] for r in sizes.collect()}
    parts = {int(_mixed(b, k)[0]): -(-(large.get((b, k), 0) + large.get((b, k - 1), 0)) // HOT) for b, j in large for k in (j, j + 1)}
    hot = np.array(sorted(parts), np.int64)
    split = np.array([parts[g] for g in sorted(parts)], np.int64)
    shown = sets.select("id", "h", "bucket").mapInArrow(_packed(common["t"].to_numpy(np.int64), common["c"].to_numpy(np.int64), threshold, hot, split), PACKED)
    if without is not None:
        shown = shown.join(without, "id", "left_anti").select(*(x.split()[0] for x in PACKED.split(", ")))
    return shown.repartition("g").sortWithinPartitions("k", "g").mapInArrow(_met(threshold), "a long, b long").distinct()

"""Problem 7: items packed into containers of one capacity.

Method: best fit over runs, a form of bulk-synchronous best fit whose sweep is not distributed. Items are sorted by size, and numbered within a size; open containers are
kept sorted by their gap. A superstep takes the largest size left, sweeps to the smallest gaps that hold it,
gives the k-th item of the size to the k-th place (that is how conflicts are resolved), updates the gaps and
repeats. As sizes and gaps are whole numbers up to the capacity, both lists are kept as runs (equal size:
how many; equal gap: which containers), so a superstep costs a few runs however many items there are, and
the sweep needs the counts of sizes only and is done on the driver, at a cost that the capacity bounds.
Counting and numbering the items and giving them their containers is distributed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

#: Items are numbered in hash buckets of about this many rows, so that a common size is no single task.
BUCKET = 100_000


class Run(NamedTuple):
    """Items number low to high - 1 of a size go to containers from first on, each of which takes a number of them."""

    size: int
    low: int
    high: int
    first: int
    each: int


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """(runs, containers) of best fit over the counts of sizes 1 to capacity, largest first."""
    gaps: list[tuple[int, int, int]] = []  # (gap, first container, how many), sorted
    runs: list[Run] = []
    opened = 0
    for size in sorted(counts, reverse=True):
        low, left = 0, counts[size]
        while left > 0:
            k = bisect_left(gaps, (size, -1, -1))
            if k < len(gaps):
                gap, first, many = gaps.pop(k)
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // size))
                opened += many
            each = gap // size
            used = min(many, -(-left // each))
            full, rest = (used, 0) if used * each <= left else (used - 1, left - (used - 1) * each)
            placed = full * each + rest
            runs.append(Run(size, low, low + placed, first, each))
            for g, f, n in ((gap - each * size, first, full), (gap - rest * size, first + full, used - full), (gap, first + used, many - used)):
                if n and g:
                    insort(gaps, (g, f, n))
            low, left = low + placed, left - placed
    return runs, opened


def numbered(items: DataFrame, by: str, order: list[str]) -> DataFrame:
    """items with "rank", from 0, within the values of a column; hot values are numbered in hash buckets with offsets."""
    buckets = max(1, -(-items.count() // BUCKET))
    placed = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = placed.groupBy(by, "bucket").count()
    before = F.sum("count").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(by, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order)) - 1
    return placed.withColumn("inside", inside).join(offsets, [by, "bucket"]).withColumn("rank", F.col("inside") + F.col("offset")).drop("bucket", "inside", "offset")


def pack(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, size, start, container) of every piece of every item.

    Only an item over the capacity is split: into pieces of the capacity and a rest. Items of size 0 or null
    take no room and are put in container 0; repeated rows are items of their own; a negative size counts as
    0. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity has to be positive")
    n = F.greatest(F.coalesce(df[size].cast("long"), F.lit(0)), F.lit(0))
    whole = df.select(df[key].alias("key"), n.alias("n"))
    pieces = whole.select("key", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    items = cut(pieces.select("key", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("n")))
    counts = {r["n"]: r["count"] for r in items.filter("n > 0").groupBy("n").count().collect()}  # at most capacity rows
    runs, _ = sweep(counts, capacity)
    known = df.sparkSession.sparkContext.broadcast(np.array(runs or [(0, 0, 0, 0, 1)], np.int64))  # bounded by the capacity's sizes and gaps
    kind = df.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = known.value
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        runs = runs[order]
        width = int(runs[:, 2].max()) + 1
        starts = runs[:, 0] * width + runs[:, 1]
        for batch in batches:
            size, rank = batch.column("n").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            r = runs[np.searchsorted(starts, size * width + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(r[:, 3] + (rank - r[:, 1]) // r[:, 4])], ["key", "piece_no", "start", "n", "container"])

    ranked = numbered(items.filter("n > 0"), "n", ["key", "piece_no"]).select("key", "piece_no", "start", "n", F.col("rank").cast("long").alias("rank"))
    placed = ranked.mapInArrow(assign, f"key {kind}, piece_no int, start long, n int, container long")
    empty = items.filter("n = 0").select("key", "piece_no", "start", "n", F.lit(0).cast("long").alias("container"))
    return placed.unionByName(empty).select(F.col("key").alias(key), "piece_no", F.col("n").alias(size), "start", "container")

"""Structured Streaming: the access fold, rings of recent items, expiry, errors that come and go, ingest by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

#: Width of an access window and how late an access may come.
WINDOW, LATE = "2 seconds", "12 hours"
RING = 20


def access_fold(accesses: DataFrame, *, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """(window_start, memory_id): one use a memory and window, however often it was touched in it.

    Works on a stream and on a table. On a stream, accesses later than the watermark are left out and the
    state of closed windows is dropped; null ids count for nothing.
    """
    rows = accesses.filter("memory_id is not null and accessed_at is not null").select("memory_id", F.col("accessed_at").cast("timestamp").alias("at"))
    placed = rows.select(F.window("at", window).start.alias("window_start"), "memory_id")
    if placed.isStreaming:
        placed = placed.withWatermark("window_start", late)
    return placed.dropDuplicates(["memory_id", "window_start"])


def access_counts(folded: DataFrame) -> DataFrame:
    """(memory_id, added, last_window) to be added to the store."""
    return folded.groupBy("memory_id").agg(F.count(F.lit(1)).alias("added"), F.max("window_start").alias("last_window"))


def apply_accesses(memories: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, access_count, last_accessed_at) with the counts added; memories without new ones stay as they are."""
    x = memories.join(counts.withColumnRenamed("memory_id", "id"), "id", "left")
    return x.select("id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("access_count"), F.greatest("last_accessed_at", "last_window").alias("last_accessed_at"))


def recent_ring(events: DataFrame, key: str, item: str, time: str, *, size: int = RING) -> DataFrame:
    """A stream of (key, item, time) of each key's newest distinct items, given out anew whenever they change.

    The state of a key is at most `size` items, whatever comes in; ties of time go by item.
    """
    state = "items array<string>, times array<double>"
    out = "key string, items array<string>"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, times = state.get if state.exists else ([], [])
        newest = dict(zip(items, times, strict=True))
        for batch in batches:
            for i, t in zip(batch["item"], batch["time"], strict=True):
                if i is not None:
                    newest[i] = max(t, newest.get(i, float("-inf")))
            newest = dict(sorted(newest.items(), key=lambda x: (-x[1], x[0]))[:size])
        state.update((list(newest), list(newest.values())))
        yield pd.DataFrame({"key": [k[0]], "items": [list(newest)]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"), F.col(time).cast("timestamp").cast("double").alias("time")).filter("key is not null and item is not null and time is not null")
    return rows.groupBy("key").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)


def error_states(events: DataFrame, key: str, status: str, message: str, time: str | None = None) -> DataFrame:
    """A stream of (key, event, message) from checks: "raised" when an error comes or its message changes, "cleared" when a check passes again; the same error again gives nothing.

    time: within a micro-batch a key's checks are taken in its order, at one time failed ones first, those without a time last; without it as they come.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        ordered = pd.concat(list(batches)).sort_values(["at", "ok"], kind="stable", na_position="last") if time else None
        for batch in [ordered] if time else batches:
            for ok, text in zip(batch["ok"], batch["message"], strict=True):
                if ok and now is not None:
                    out.append((k[0], "cleared", now))
                    now = None
                elif not ok and text != now:
                    out.append((k[0], "raised", text))
                    now = text
        state.update((now,))
        yield pd.DataFrame(out, columns=["key", "event", "message"])

    at = F.col(time).cast("timestamp").cast("double") if time else F.lit(None).cast("double")
    rows = events.select(F.col(key).cast("string").alias("key"), (F.col(status) == "ok").alias("ok"), F.coalesce(F.col(message), F.lit("")).alias("message"), at.alias("at")).filter("key is not null and ok is not null")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event string, message string", "now string", "append", GroupStateTimeout.NoTimeout)


# Suffixes of files whose changes count (files without any suffix count too), and folders whose files do not.
WATCHED = "rs ts svelte py js go tsx jsx md".split()
UNWATCHED = ("/.", "/node_modules/", "/target/")


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, name, changed_at, words) of the files that come into a folder or change there, for the boost of what is in work."""
    from skein.functions.text import name_words

    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    local = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rows = seen.select(local.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("changed_at"))
    skipped = reduce(lambda a, part: a | F.col("path").contains(part), UNWATCHED, F.lit(False))
    suffix = F.regexp_extract("name", r"^.+\.([^.]*)$", 1)
    return rows.filter(~skipped & ((suffix == "") | suffix.isin(*WATCHED))).withColumn("words", name_words(F.col("path")))


def expiring(rows: DataFrame, *, time: str = "created_at", ttl: str = "expires_at") -> DataFrame:
    """Rows of a stream that have not expired at their own event time plus nothing: late ones whose time to live is over are dropped."""
    return rows.filter(F.col(ttl).isNull() | (F.col(ttl) > F.col(time)))


def ingest(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a micro-batch function over what is there, then stop. The batch number lets the function write each batch once."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet under a folder, and give back all that it put out with its batch."""
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/out"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    try:
        return spark.read.schema(schema).option("basePath", out).parquet(out).drop("b")
    except Exception as e:  # no batch had any data
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def replay(spark: SparkSession, path: str, *, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, some files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    import os

    if os.path.isdir(path) or "://" in path:
        return source.parquet(path)
    return source.option("pathGlobFilter", name).parquet(folder)

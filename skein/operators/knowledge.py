"""Subject-predicate-object facts with validity in days, both ends included; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current() -> Column:
    return F.col("valid_to").isNull()


def as_of(df: DataFrame, day: str) -> DataFrame:
    """Facts valid on a day."""
    at = F.lit(day).cast("date")
    return df.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))


def to_add(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct normalised triples of a batch of which no current one is known."""
    keys = ["subject", "predicate", "object"]
    plain = batch.select(*(F.regexp_replace(F.lower(F.trim(c)), " ", "_").alias(c) for c in keys)).dropna().distinct()
    return plain.join(known.filter(current()).select(*keys), keys, "left_anti")


def invalidate(df: DataFrame, gone: DataFrame, day: str) -> DataFrame:
    """All facts, the current ones that match ended on a day; "changed" tells which."""
    keys = ["subject", "predicate", "object"]
    marked = df.join(gone.select(*keys, F.lit(True).alias("hit")).distinct(), keys, "left")
    changed = F.coalesce(F.col("hit"), F.lit(False)) & current()
    return marked.select(*df.columns, changed.alias("changed")).withColumn("valid_to", F.when(F.col("changed"), F.lit(day).cast("date")).otherwise(F.col("valid_to")))


def about(df: DataFrame, entity: str) -> DataFrame:
    """Facts from and to an entity; one of it with itself comes in both directions."""
    side = lambda name, own, other: df.filter(F.col(own) == entity).select(F.lit(name).alias("direction"), "id", "predicate", F.col(other).alias("other"), current().alias("current"), "valid_from", "valid_to", "confidence")
    return side("outgoing", "subject", "object").unionByName(side("incoming", "object", "subject"))


def timeline(df: DataFrame, entity: str | None, limit: int | None) -> DataFrame:
    """By start, open starts last, ties by id."""
    if entity is not None:
        df = df.filter((F.col("subject") == entity) | (F.col("object") == entity))
    ordered = df.orderBy(F.asc_nulls_last("valid_from"), "id")
    return ordered.limit(limit) if limit is not None else ordered


def statistics(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(current()).alias("current"), F.count_if(~current()).alias("expired"), F.array_sort(F.collect_set("predicate")).alias("predicates"))
    entities = df.select(F.col("subject").alias("e")).union(df.select("object")).distinct().agg(F.count(F.lit(1)).alias("entities"))
    return counts.crossJoin(F.broadcast(entities))  # rows of one each


def support(df: DataFrame, day: str) -> DataFrame:
    """(memory_id, active, expired): facts that rest on a memory."""
    at = F.lit(day).cast("date")
    return df.filter("source_memory_id is not null").groupBy(F.col("source_memory_id").alias("memory_id")).agg(F.count_if(current() | (F.col("valid_to") >= at)).alias("active"), F.count_if(F.col("valid_to") < at).alias("expired"))


def penalty(active: Column, expired: Column) -> Column:
    """0.3 where all facts of a memory have ended, else down to 0.5 by the part that has."""
    share = active / F.nullif(active + expired, F.lit(0))
    return F.when(F.coalesce(expired, F.lit(0)) == 0, 1.0).when(F.coalesce(active, F.lit(0)) == 0, 0.3).otherwise(0.5 + 0.5 * share)

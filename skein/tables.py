"""Tables of the store as DataFrames, with the normalisations that many operators share.

Each Spark normalisation has its DuckDB twin here (upper-case constants), so that a query and the SQL it is
checked against start from one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import MANY, stored

#: The moment at which the registered queries are asked; operators take it as a parameter and never read a clock.
AS_OF = "2025-11-01 00:00:00"
#: Kinds that an earlier version of the store wrote, and what they are now.
LEGACY_KINDS = {"problem": "bug", "transcript_chunk": "transcript"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slug(name: Column) -> Column:
    """Lower case; each run of other characters than a-z and 0-9 becomes one hyphen; none at the ends; empty is null."""
    joined = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(joined, "^-|-$", ""), F.lit(""))


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered again are equal in all columns, so any of them stands for all; null keys are kept once."""
    return df.dropDuplicates([key])


def once_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """one_per_id() without a shuffle of the rows: numbers of ids are counted, and only rows whose id may come again are set apart, as a table."""
    again = stored(df.groupBy(F.xxhash64(key).alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again"))
    if again.limit(MANY + 1).count() > MANY:
        return one_per_id(df, key)
    of = lambda how: df.join(F.broadcast(again), F.xxhash64(key) == F.col("again"), how)
    return of("left_anti").unionByName(stored(one_per_id(of("left_semi"), key)))


def kind_of(kind: Column) -> Column:
    plain = F.lower(F.trim(kind))
    for old, new in LEGACY_KINDS.items():
        plain = F.when(plain == old, F.lit(new)).otherwise(plain)
    return plain


def tags_of(tags: Column) -> Column:
    """The array of a JSON text; what is no array of texts gives an empty array."""
    return F.coalesce(F.when(F.trim(tags).rlike(r"^\[.*\]$"), F.from_json(tags, "array<string>")), F.array().cast("array<string>"))


def memories(spark: SparkSession, sf_dir: str, once: Callable[[DataFrame], DataFrame] = one_per_id) -> DataFrame:
    """The memory store, cleaned: one row an id (by `once`), kind and project normalised, tags and scope decoded, importance 1 to 5."""
    raw = once(table(spark, sf_dir, "memories"))
    scope = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("session_id", "thread_id", "window_id")]
    times = [F.col(c).cast("timestamp").alias(c) for c in ("expires_at", "created_at", "updated_at", "last_accessed_at")]
    return raw.select(
        "id",
        F.coalesce("content", F.lit("")).alias("content"),
        kind_of(F.col("kind")).alias("kind"),
        slug(F.col("project")).alias("project"),
        tags_of(F.col("tags")).alias("tags"),
        "source",
        F.least(F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)), F.lit(5)).cast("int").alias("importance"),
        *times,
        "access_count",
        *scope,
    )


SLUG = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), '')"
#: CTE `m`, the twin of memories().
M = f"""m AS (SELECT DISTINCT id, coalesce(content, '') AS content,
  CASE lower(trim(kind)) WHEN 'problem' THEN 'bug' WHEN 'transcript_chunk' THEN 'transcript' ELSE lower(trim(kind)) END AS kind,
  {SLUG.format("project")} AS project,
  CASE WHEN json_valid(tags) AND json_type(tags) = 'ARRAY' THEN from_json(tags, '["VARCHAR"]') ELSE CAST([] AS VARCHAR[]) END AS tags,
  source, least(greatest(coalesce(importance, 3), 1), 5) AS importance, expires_at, created_at, updated_at, last_accessed_at, access_count,
  CASE WHEN json_valid(metadata) THEN metadata->>'$.session_id' END AS session_id,
  CASE WHEN json_valid(metadata) THEN metadata->>'$.thread_id' END AS thread_id,
  CASE WHEN json_valid(metadata) THEN metadata->>'$.window_id' END AS window_id
  FROM memories)"""


def valid_date(text: Column) -> Column:
    """Date of a validity text, which is a date or a timestamp."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge triples: texts lower-cased with underscores, validity as dates, confidence 1 where unknown; one row an id."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "_")
    return one_per_id(table(spark, sf_dir, "knowledge_triples")).select(
        "id",
        plain(F.col("subject")).alias("subject"),
        plain(F.col("predicate")).alias("predicate"),
        plain(F.col("object")).alias("object"),
        valid_date(F.col("valid_from")).alias("valid_from"),
        valid_date(F.col("valid_to")).alias("valid_to"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        "source_memory_id",
        F.col("created_at").cast("timestamp").alias("created_at"),
    )


T = """t AS (SELECT DISTINCT ON (id) id, replace(lower(trim(subject)), ' ', '_') AS subject, replace(lower(trim(predicate)), ' ', '_') AS predicate,
  replace(lower(trim(object)), ' ', '_') AS object, try_cast(substr(valid_from, 1, 10) AS DATE) AS valid_from, try_cast(substr(valid_to, 1, 10) AS DATE) AS valid_to,
  coalesce(confidence, 1.0) AS confidence, source_memory_id, created_at FROM knowledge_triples)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between memories that exist: one row a (source, target), relation in order of RELATIONS, self-links left out."""
    raw = table(spark, sf_dir, "memory_links").filter("source_id is not null and target_id is not null and source_id <> target_id")
    ids = table(spark, sf_dir, "memories").select("id").distinct()
    known = raw.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return known.groupBy("source_id", "target_id").agg(F.min(F.coalesce("relation_type", F.lit("relates_to"))).alias("relation"))


L = """l AS (SELECT source_id, target_id, min(coalesce(relation_type, 'relates_to')) AS relation FROM memory_links
  WHERE source_id <> target_id AND source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories) GROUP BY ALL)"""

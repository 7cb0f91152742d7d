"""Filters, sorts, joins and counts over the memory store; all built-in expressions, no Python in the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, *, project: str | None = None, kind: str | None = None, not_kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, ties by id. Null timestamps come last. Filters reach the scan as pushed predicates."""
    for column, value, keep in (("project", project, True), ("kind", kind, True), ("kind", not_kind, False)):
        if value is not None:
            df = df.filter(F.col(column) == value if keep else ~F.col(column).eqNullSafe(value))
    return df.orderBy(F.desc_nulls_last("updated_at"), "id").offset(offset).limit(limit)


def visible(df: DataFrame, mode: str = "default") -> DataFrame:
    """Credentials are shown in the mode "full" only; an unknown mode is an error."""
    if mode not in ("safe", "default", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    return df if mode == "full" else df.filter(~F.col("kind").eqNullSafe("credential"))


def in_scope(df: DataFrame, **keys: str | None) -> DataFrame:
    """Rows whose scope equals every key that is given."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]) if kv[1] is not None else d, keys.items(), df)


def scope_score(session: str | None, thread: str | None, window: str | None) -> Column:
    """4 for the same thread, 2 for the same window, 1 for the same session."""
    parts = ((thread, "thread_id", 4), (window, "window_id", 2), (session, "session_id", 1))
    return reduce(lambda s, p: s + F.when(F.col(p[1]) == p[0], p[2]).otherwise(0) if p[0] is not None else s, parts, F.lit(0))


def expired(as_of: str) -> Column:
    return F.coalesce(F.col("expires_at") < F.lit(as_of).cast("timestamp"), F.lit(False))


def critical(as_of: str) -> Column:
    return (F.col("importance") >= 4) & ~expired(as_of)


def pinned() -> Column:
    return F.array_contains("tags", "pinned")


def protected() -> Column:
    """Never condensed: pinned rows and capsules themselves."""
    return pinned() | F.array_contains("tags", "session_capsule")


def age_days(column: str, as_of: str) -> Column:
    """Whole periods of 24 hours, not calendar days; null stays null."""
    return F.floor((F.lit(as_of).cast("timestamp").cast("double") - F.col(column).cast("double")) / 86400)


def has_tag(*wanted: str) -> Column:
    """Whether any tag is wanted, whatever its case."""
    return F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*(F.lit(w.lower()) for w in wanted)))


def bulk_delete_matches(df: DataFrame, as_of: str, *, kind: str | None = None, project: str | None = None, importance_max: int | None = None, older_than_days: int | None = None, tag: str | None = None) -> DataFrame:
    """The rows that a bulk deletion takes; pinned rows never. Without any filter it is an error."""
    given = [(kind, lambda v: F.col("kind") == v), (project, lambda v: F.col("project") == v), (importance_max, lambda v: F.col("importance") <= v), (older_than_days, lambda v: age_days("updated_at", as_of) >= v), (tag, lambda v: F.array_contains("tags", v))]
    chosen = [make(v) for v, make in given if v is not None]
    if not chosen:
        raise ValueError("a bulk deletion needs a filter")
    return df.filter(reduce(lambda a, b: a & b, chosen) & ~pinned())


def counts_by(df: DataFrame, column: str, missing: str = "(global)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def project_identities(projects: DataFrame, slug: Column) -> DataFrame:
    """One row a slug: earliest creation, first non-empty path and description by creation."""
    named = projects.withColumn("slug", slug).filter("slug is not null")
    first = lambda c: F.min(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct("created_at", F.col(c).alias("v"))))["v"]
    return named.groupBy("slug").agg(F.min("created_at").alias("created_at"), first("path").alias("path"), first("description").alias("description"))


def project_of_path(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project) by the longest project path that is the path or a folder above it; null without one.

    A path is exploded to its own ancestors and joined by equality, so it is no theta join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("path", F.explode(above).alias("root"))
    roots = projects.filter("path is not null and path <> ''").select(F.regexp_replace("path", "/+$", "").alias("root"), F.col("slug"))
    hit = up.join(roots, "root").groupBy("path").agg(F.max_by("slug", F.struct(F.length("root"), "slug")).alias("project"))
    return paths.join(hit, "path", "left").select("path", "project")


def hygiene(df: DataFrame, links: DataFrame, projects: DataFrame, as_of: str) -> DataFrame:
    """One row of counts, in one pass over the store; orphans come of anti-joins."""
    flags = {
        "total": F.lit(True), "no_project": F.col("project").isNull(), "no_tags": F.size("tags") == 0, "expired": expired(as_of), "pinned": pinned(), "empty": F.trim("content") == "",
        "never_used": F.coalesce("access_count", F.lit(0)) == 0, "future_update": F.col("updated_at") > F.lit(as_of).cast("timestamp"),
    }
    one = df.agg(*(F.count_if(v).alias(k) for k, v in flags.items()))
    ids = df.select(F.col("id").alias("x"))
    ends = links.select(F.explode(F.array("source_id", "target_id")).alias("x")).filter("x is not null")
    orphans = ends.join(ids, "x", "left_anti").agg(F.count(F.lit(1)).alias("orphan_link_ends"))
    unknown = df.filter("project is not null").join(projects.select(F.col("slug").alias("project")), "project", "left_anti").agg(F.count(F.lit(1)).alias("unknown_project"))
    return one.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(unknown))  # rows of one each


def health(df: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    age = age_days("updated_at", as_of)
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(pinned()).alias("pinned"),
        F.count_if(F.array_contains("tags", "session_capsule")).alias("capsules"),
        F.count_if((age > 30) & (F.col("importance") <= 2)).alias("stale"),
        F.count_if((age > 30) & (F.col("importance") <= 3) & ~protected()).alias("compressible"),
        F.round(F.avg(age), 1).alias("average_age"),
        F.sum(F.length("content")).alias("characters"),
    )
    ids = df.select("id")
    dangling = links.filter("source_id is not null or target_id is not null")
    lost = dangling.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("source_id", "target_id").unionByName(dangling.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("source_id", "target_id")).distinct()
    return one.crossJoin(F.broadcast(lost.agg(F.count(F.lit(1)).alias("orphan_links"))))


def newest_per(df: DataFrame, keys: list[str], time: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of every key: a ring buffer's content. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time), tie)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)

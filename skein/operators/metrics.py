"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R@1, R@5, R@10, MRR and NDCG@10 over the queries of gold (query, id), each with one relevant row or more.

    A query whose answer was not found counts 0; queries without gold are not evaluated. The best place of a
    relevant row decides.
    """
    hit = gold.join(results.select("query", "id", "rank"), ["query", "id"], "left").groupBy("query", *(by or [])).agg(F.min("rank").alias("r"))
    r = F.col("r")
    at = lambda k: F.round(F.avg((F.coalesce(r, F.lit(9999)) <= k).cast("double")), 6).alias(f"r_at_{k}")
    mrr, ndcg = F.coalesce(1 / r, F.lit(0.0)), F.when(r <= 10, 1 / F.log2(r + 1.0)).otherwise(0.0)
    return hit.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_queries"), at(1), at(5), at(10), F.round(F.avg(mrr), 6).alias("mrr"), F.round(F.avg(ndcg), 6).alias("ndcg_at_10"))


def by_session(results: DataFrame) -> DataFrame:
    """Results with the session of a turn in place of its id, so that gold sessions match by equality (s1 is not s10)."""
    key = F.regexp_extract("id", r"^(.*)__t\d+$", 1)
    named = results.withColumn("id", F.when(key != "", key).otherwise(F.col("id")))
    return named.groupBy("query", "id").agg(F.min("rank").alias("rank"))


def nearest_rank(values: Column, share: float) -> Column:
    """The element of a sorted array at round((n - 1) x share)."""
    return F.get(values, F.round((F.size(values) - 1) * F.lit(share)).cast("int"))


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Percentiles 50, 95 and 99 and the mean by key; exact by counting values, not by gathering rows.

    Equal values are counted before the shuffle; positions come of the running count within the key.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    place = lambda p: F.round((F.col("all") - 1) * F.lit(p)) + 1
    pick = lambda p: F.min(F.when(F.col("upto") >= place(p), F.col(value)))
    return run.groupBy(key).agg(F.first("all").alias("n"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), (F.sum(F.col(value) * F.col("n")) / F.first("all")).alias("mean"))


def recall_quality(results: DataFrame, specs: DataFrame, memories: DataFrame) -> DataFrame:
    """One row: top-1 and top-5 hits of specs (query, project, id), and leaks of other projects and of credentials into the first five."""
    five = results.filter("rank <= 5").join(memories.select("id", F.col("project").alias("found_project"), "kind"), "id").join(F.broadcast(specs.select("query", "project", F.col("id").alias("gold"))), "query")
    per = five.groupBy("query").agg(
        F.max(((F.col("rank") == 1) & (F.col("id") == F.col("gold"))).cast("int")).alias("top1"),
        F.max((F.col("id") == F.col("gold")).cast("int")).alias("top5"),
        F.max((F.col("project").isNotNull() & F.col("found_project").isNotNull() & (F.col("project") != F.col("found_project"))).cast("int")).alias("project_leak"),
        F.max((F.col("kind") == "credential").cast("int")).alias("credential_leak"),
    )
    every = specs.select("query").join(per, "query", "left")
    return every.agg(F.count(F.lit(1)).alias("n_specs"), *(F.round(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")), 2).alias(c) for c in ("top1", "top5", "project_leak", "credential_leak")))

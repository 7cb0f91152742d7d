"""Context under a budget: ranked sections of the store, taken in a fixed order until the space is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import preview, terms
from skein.operators.folds import within_budget
from skein.operators.relational import critical, expired, pinned, scope_score, visible

#: Characters of a recall, and rows of its sections in their order.
BUDGET = 3_200
BRAIN = {"architecture": ["architecture"], "decisions": ["decision"], "preferences": ["preference"], "bugs": ["bug"], "todos": ["todo"], "recent": ["fact", "milestone", "note"], "patterns": ["pattern", "snippet"]}
SECTIONS = {"critical": 12, "pinned": 20, "hint": 10, "scope": 15, "project": 50, "preference": 12, "pattern": 10, "decision": 10}


def ranked(df: DataFrame, section: str, number: int, order: list[Column], limit: int) -> DataFrame:
    """(section, section_no, rank, id, content ...) of the first rows; a sort with a limit, no window over all."""
    top = df.orderBy(*order, "id").limit(limit)
    w = Window.orderBy(*order, "id")  # over at most `limit` rows
    return top.withColumn("rank", F.row_number().over(w)).withColumns({"section": F.lit(section), "section_no": F.lit(number)})


def critical_score(project: str | None, hint: list[str]) -> Column:
    """8 for the same project, 2 for a global row under a hint, 4 a hint word, 2 a step of importance, up to 5 for use."""
    text = F.lower(F.concat_ws(" ", "content", F.array_join("tags", " ")))
    overlap = reduce(lambda a, w: a + text.contains(w).cast("int"), hint, F.lit(0))
    place = F.when(F.col("project") == project, 8).when(F.col("project").isNull() & F.lit(bool(hint)), 2).otherwise(0) if project else F.lit(0)
    return place + 4 * overlap + 2 * F.col("importance") + F.least(F.coalesce("access_count", F.lit(0)), F.lit(5))


def global_score(hint: list[str], project: str | None, as_of: str) -> Column:
    """What a global row is worth to a context: kind, hint words, use, age, the project's name; plain rows lose."""
    low = F.lower("content")
    kind = F.when(F.col("kind") == "preference", 3).when(F.col("kind").isin("decision", "architecture"), 2).when(F.col("kind") == "pattern", 1).otherwise(0)
    overlap = reduce(lambda a, w: a + low.contains(w).cast("int"), hint, F.lit(0))
    age = F.floor((F.lit(as_of).cast("timestamp").cast("double") - F.col("updated_at").cast("double")) / 86400)
    fresh = F.when(age <= 7, 2).when(age <= 30, 1).when(age > 180, -1).otherwise(0)
    named = low.contains(project).cast("int") * 3 if project else F.lit(0)
    plain = F.when(overlap > 0, 0).otherwise(5)
    return kind + 4 * overlap + F.least(F.coalesce("access_count", F.lit(0)), F.lit(3)) + fresh + named - plain


def sections(df: DataFrame, as_of: str, *, project: str | None, hint: str = "", session: str | None = None, thread: str | None = None, window: str | None = None, mode: str = "default", sizes: dict[str, int] = SECTIONS) -> DataFrame:
    """All ranked sections, each row once: where it comes first."""
    words = [w for w in hint.lower().split() if len(w) >= 3]
    rows = visible(df, mode).filter(~expired(as_of))
    own = rows.filter((F.col("project") == project) | F.col("project").isNull()) if project else rows
    newest = [F.desc_nulls_last("updated_at")]
    rows = rows.withColumn("scoped", scope_score(session, thread, window).cast("int"))
    score = F.lit(0) + reduce(lambda a, w: a + F.arrays_overlap(terms(F.col("content")), F.array(F.lit(w))).cast("int"), words, F.lit(0))
    own = own.withColumn("hits", score.cast("int"))
    parts = {
        "critical": (own.filter(critical(as_of)), [F.desc(critical_score(project, words)), *newest]),
        "pinned": (own.filter(pinned()), newest),
        "hint": (own.filter("hits > 0"), [F.desc("hits"), *newest]),
        "scope": (rows.filter("scoped > 0"), [F.desc("scoped"), *newest]),
        "project": (rows.filter(F.col("project") == project) if project else rows.filter("project is null"), [F.desc("importance"), *newest]),
        **{k: (rows.filter(F.col("kind") == k).withColumn("g", global_score(words, project, as_of)), [F.desc("g"), *newest]) for k in ("preference", "pattern", "decision")},
    }
    columns = ["id", "kind", "project", "importance", "content", "updated_at", "tags", "section", "section_no", "rank"]
    all_ = reduce(lambda a, b: a.unionByName(b), (ranked(f, k, n, o, sizes[k]).select(*columns) for n, (k, (f, o)) in enumerate(parts.items())))
    w = Window.partitionBy("id").orderBy("section_no", "rank")  # at most a few hundred rows
    return all_.withColumn("first", F.row_number().over(w)).filter("first = 1").drop("first")


def recall(df: DataFrame, as_of: str, *, budget: int = BUDGET, **asked) -> DataFrame:
    """(section, section_no, rank, id, size) of the rows that fit, in order; too long ones are passed over."""
    rows = sections(df, as_of, **asked).select(F.lit(1).alias("request"), "section", "section_no", "rank", "id", F.length("content").alias("size"))
    return within_budget(rows, ["request"], ["section_no", "rank", "id"], "size", budget).drop("request")


def brain(df: DataFrame, as_of: str, project: str, *, tokens: int = 1_000) -> DataFrame:
    """(section, rank, id, size) of a project in short: a section stops at its first row that does not fit what is left of tokens x 4 characters.

    The sections come one after the other and share the space.
    """
    rows = visible(df).filter(~expired(as_of) & (F.col("project") == project))
    newest = [F.desc("importance"), F.desc_nulls_last("updated_at")]
    parts = [ranked(rows.filter(F.col("kind").isin(*ks)), name, n, newest, 15) for n, (name, ks) in enumerate(BRAIN.items())]
    every = reduce(lambda a, b: a.unionByName(b), parts).select(F.lit(project).alias("project"), "section", "section_no", "rank", "id", F.length(preview(F.col("content"), 200)).alias("size"))
    # one ordered fold: a section that stopped is shut, the space used goes on to the next one
    lists = every.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("section_no", "rank", "section", "id", "size"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("shut"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(acc, v):
        fits = (acc["used"] + v["size"] <= tokens * 4) & (acc["shut"] != v["section_no"])
        return F.struct(F.when(fits, acc["used"] + v["size"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, acc["shut"]).otherwise(v["section_no"]).alias("shut"), F.when(fits, F.array_append(acc["kept"], acc["at"])).otherwise(acc["kept"]).alias("kept"), (acc["at"] + 1).alias("at"))

    kept = lists.select(F.explode(F.transform(F.aggregate("x", start, step, lambda a: a["kept"]), lambda i: F.get("x", i))).alias("r"))
    return kept.select("r.section", "r.rank", "r.id", "r.size")


def explained(df: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """(id, importance, recency, access, graph): the parts of a memory's standing."""
    age = F.greatest(F.floor((F.lit(as_of).cast("timestamp").cast("double") - F.col("updated_at").cast("double")) / 86400), F.lit(0))
    degree = links.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(degree, "id", "left").select(
        "id",
        (F.col("importance") / 3).alias("importance_part"),
        (0.25 * F.greatest(1 - F.coalesce(age, F.lit(30)) / 30, F.lit(0.0))).alias("recency_part"),
        F.least(0.02 * F.coalesce("access_count", F.lit(0)), F.lit(0.2)).alias("access_part"),
        F.least(0.03 * F.coalesce("n", F.lit(0)), F.lit(0.15)).alias("graph_part"),
    )

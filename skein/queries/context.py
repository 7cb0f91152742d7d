"""Recall, project brains and contexts, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.folds import never_rising, within_budget
from skein.plans import context as C
from skein.queries.metrics import TERMS
from skein.queries.relational import AGE, EXP, PIN
from skein.tables import AS_OF, L, M, links, memories


def recall_project(s, d):
    return C.recall(memories(s, d), AS_OF, project="nimbus-relay", hint="cache lease outage", session="s2")


def recall_global(s, d):
    return C.recall(memories(s, d), AS_OF, project=None, budget=2_000)


def project_brain(s, d):
    return C.brain(memories(s, d), AS_OF, "nimbus-relay")


def project_context(s, d):
    """The most important and newest rows of a project, with the global preferences."""
    m = memories(s, d).filter((F.col("project") == "nimbus-relay") | (F.col("project").isNull() & (F.col("kind") == "preference"))).filter("kind <> 'credential'")
    return m.orderBy(F.desc("importance"), F.desc("updated_at"), "id").limit(25).select("id", "kind", "importance")


def recall_critical(s, d):
    m = memories(s, d).filter("project = 'nimbus-relay' or project is null").filter("kind <> 'credential'").filter(F.col("importance") >= 4).filter(F.coalesce(F.col("expires_at") >= F.lit(AS_OF).cast("timestamp"), F.lit(True)))
    return m.withColumn("score", C.critical_score("nimbus-relay", ["cache", "lease"])).orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(12).select("id", "score")


def recall_explain(s, d):
    return C.explained(memories(s, d), links(s, d), AS_OF).select("id", *(F.round(c, 6).alias(c) for c in ("importance_part", "recency_part", "access_part", "graph_part")))


def pinned_budget(s, d):
    """Pinned rows of every project under 1,500 characters, newest first, too long ones passed over."""
    rows = memories(s, d).filter(F.array_contains("tags", "pinned") & F.col("project").isNotNull()).select("project", (-F.col("importance")).alias("o"), "id", F.length("content").alias("size"))
    return within_budget(rows, ["project"], ["o", "id"], "size", 1_500).select("project", "id", "size")


def budget_stop(s, d):
    """The same, but a project's list ends at the first row that does not fit."""
    rows = memories(s, d).filter(F.array_contains("tags", "pinned") & F.col("project").isNotNull()).select("project", (-F.col("importance")).alias("o"), "id", F.length("content").alias("size"))
    return within_budget(rows, ["project"], ["o", "id"], "size", 1_500, stop=True).select("project", "id", "size")


def score_clamp(s, d):
    """Scores in id order of each project, none above the one before."""
    x = memories(s, d).filter("project is not null").groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("importance").cast("double").alias("v")))), lambda r: r["v"]).alias("v"))
    y = x.withColumn("c", never_rising("v", 0.99))
    return y.select("project", F.size("c").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


QUERIES = {f.__name__: f for f in (recall_project, recall_global, project_brain, project_context, recall_critical, recall_explain, pinned_budget, budget_stop, score_clamp)}

LISTS = f"""x AS (SELECT project, id, length(content) AS size, row_number() OVER (PARTITION BY project ORDER BY -importance, id) AS n FROM m WHERE {PIN} AND project IS NOT NULL)"""
FOLD = """WITH RECURSIVE {M}, {LISTS}, f AS (SELECT project, 0::BIGINT AS n, 0::BIGINT AS used, false AS took, false AS shut FROM (SELECT DISTINCT project FROM x)
  UNION ALL SELECT x.project, x.n, CASE WHEN used + size <= 1500 AND NOT ({stop} AND shut) THEN used + size ELSE used END, used + size <= 1500 AND NOT ({stop} AND shut), shut OR used + size > 1500 FROM f JOIN x ON x.project = f.project AND x.n = f.n + 1)
  SELECT x.project, x.id, x.size FROM x JOIN f ON f.project = x.project AND f.n = x.n AND took"""
AGED = AGE.format("updated_at")
VISIBLE = f"v AS (SELECT *, lower(content) AS low, lower(concat_ws(' ', content, array_to_string(tags, ' '))) AS lowt, {TERMS} AS ts FROM m WHERE kind IS DISTINCT FROM 'credential' AND NOT {EXP})"


def recall_sql(project: str | None, words: list[str], session: str | None, budget: int) -> str:
    """The SQL of a recall: the sections one after the other, each row where it comes first, then an ordered fold over the sizes."""
    held = lambda text: " + ".join([*(f"CAST(contains({text}, '{w}') AS INT)" for w in words), "0"])
    hits = " + ".join([*(f"CAST(list_contains(ts, '{w}') AS INT)" for w in words), "0"])
    own = f"(project = '{project}' OR project IS NULL)" if project else "true"
    place = f"CASE WHEN project = '{project}' THEN 8 WHEN project IS NULL AND {bool(words)} THEN 2 ELSE 0 END" if project else "0"
    critical = f"{place} + 4 * ({held('lowt')}) + 2 * importance + least(coalesce(access_count, 0), 5)"
    fresh = f"CASE WHEN {AGED} <= 7 THEN 2 WHEN {AGED} <= 30 THEN 1 WHEN {AGED} > 180 THEN -1 ELSE 0 END"
    score = f"CASE kind WHEN 'preference' THEN 3 WHEN 'decision' THEN 2 WHEN 'architecture' THEN 2 WHEN 'pattern' THEN 1 ELSE 0 END + 4 * ({held('low')}) + least(coalesce(access_count, 0), 3) + {fresh} + {f"3 * CAST(contains(low, '{project}') AS INT)" if project else 0} - CASE WHEN {held('low')} > 0 THEN 0 ELSE 5 END"
    parts = {
        "critical": (f"{own} AND importance >= 4", f"{critical} DESC,"),
        "pinned": (f"{own} AND {PIN}", ""),
        "hint": (f"{own} AND {hits} > 0", f"{hits} DESC,"),
        "scope": (f"session_id = '{session}'" if session else "false", ""),
        "project": (f"project = '{project}'" if project else "project IS NULL", "importance DESC,"),
        **{k: (f"kind = '{k}'", f"{score} DESC,") for k in ("preference", "pattern", "decision")},
    }
    every = " UNION ALL ".join(f"SELECT '{k}' AS section, {n} AS section_no, id, length(content) AS size, row_number() OVER (ORDER BY {o} updated_at DESC NULLS LAST, id) AS rank FROM v WHERE {w} QUALIFY rank <= {C.SECTIONS[k]}" for n, (k, (w, o)) in enumerate(parts.items()))
    return f"""WITH RECURSIVE {M}, {VISIBLE}, e AS ({every}), x AS (SELECT *, row_number() OVER (ORDER BY section_no, rank, id) AS n FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY section_no, rank) = 1)),
        f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, false AS took UNION ALL SELECT x.n, CASE WHEN used + size <= {budget} THEN used + size ELSE used END, used + size <= {budget} FROM f JOIN x ON x.n = f.n + 1)
        SELECT section, section_no, rank, id, size FROM x JOIN f USING (n) WHERE took"""


BRAIN = " UNION ALL ".join(f"SELECT '{k}' AS section, {n} AS section_no, id, least(length(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 200) AS size, row_number() OVER (ORDER BY importance DESC, updated_at DESC NULLS LAST, id) AS rank FROM v WHERE project = 'nimbus-relay' AND kind IN ({', '.join(repr(x) for x in ks)}) QUALIFY rank <= 15" for n, (k, ks) in enumerate(C.BRAIN.items()))
SQL = {
    "recall_project": recall_sql("nimbus-relay", ["cache", "lease", "outage"], "s2", C.BUDGET),
    "recall_global": recall_sql(None, [], None, 2_000),
    "project_brain": f"""WITH RECURSIVE {M}, {VISIBLE}, e AS ({BRAIN}), x AS (SELECT *, row_number() OVER (ORDER BY section_no, rank) AS n FROM e),
        f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, -1 AS shut, false AS took UNION ALL SELECT x.n, CASE WHEN used + size <= 4000 AND shut <> section_no THEN used + size ELSE used END, CASE WHEN used + size <= 4000 AND shut <> section_no THEN shut ELSE section_no END, used + size <= 4000 AND shut <> section_no FROM f JOIN x ON x.n = f.n + 1)
        SELECT section, rank, id, size FROM x JOIN f USING (n) WHERE took""",
    "project_context": f"WITH {M} SELECT id, kind, importance FROM m WHERE (project = 'nimbus-relay' OR (project IS NULL AND kind = 'preference')) AND kind <> 'credential' ORDER BY importance DESC, updated_at DESC NULLS LAST, id LIMIT 25",
    "recall_critical": f"""WITH {M}, x AS (SELECT *, lower(concat_ws(' ', content, array_to_string(tags, ' '))) AS low FROM m WHERE (project = 'nimbus-relay' OR project IS NULL) AND kind <> 'credential' AND importance >= 4 AND NOT {EXP}),
        y AS (SELECT id, updated_at, CASE WHEN project = 'nimbus-relay' THEN 8 ELSE 2 END + 4 * (CAST(contains(low, 'cache') AS INT) + CAST(contains(low, 'lease') AS INT)) + 2 * importance + least(coalesce(access_count, 0), 5) AS score FROM x)
        SELECT id, score FROM y ORDER BY score DESC, updated_at DESC NULLS LAST, id LIMIT 12""",
    "recall_explain": f"""WITH {M}, {L}, g AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM l UNION ALL SELECT target_id FROM l) GROUP BY 1)
        SELECT m.id, round(importance / 3, 6) AS importance_part, round(0.25 * greatest(1 - coalesce(greatest({AGE.format('updated_at')}, 0), 30) / 30, 0.0), 6)::DOUBLE AS recency_part, round(least(0.02 * coalesce(access_count, 0), 0.2), 6)::DOUBLE AS access_part, round(least(0.03 * coalesce(n, 0), 0.15), 6)::DOUBLE AS graph_part FROM m LEFT JOIN g ON g.id = m.id""",
    "pinned_budget": FOLD.format(M=M, LISTS=LISTS, stop="false"),
    "budget_stop": FOLD.format(M=M, LISTS=LISTS, stop="true"),
    "score_clamp": f"""WITH RECURSIVE {M}, x AS (SELECT project, CAST(importance AS DOUBLE) AS v, row_number() OVER (PARTITION BY project ORDER BY id) AS n FROM m WHERE project IS NOT NULL),
        f AS (SELECT project, n, v FROM x WHERE n = 1 UNION ALL SELECT x.project, x.n, CASE WHEN x.v > f.v THEN f.v * 0.99 ELSE x.v END FROM f JOIN x ON x.project = f.project AND x.n = f.n + 1) SELECT project, count(*) AS n, round(sum(v), 4) AS total FROM f GROUP BY 1""",
}

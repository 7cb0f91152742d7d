"""Duplicates, ageing, merging, capsules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import lifecycle as Y
from skein.queries.relational import AGE, EXP, PIN
from skein.session import cut
from skein.tables import AS_OF, M, memories, once_per_id


def exact_dups(s, d):
    return Y.exact_groups(memories(s, d), "id", "content", ["project"]).select("project", "n", "keep")


def jaccard_pairs(s, d):
    p = Y.similar_word_sets(memories(s, d), "id", "content", ["project", "kind"], Y.MERGE)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def jaccard_members(s, d):
    """The rows that a representative of jaccard_pairs stands for, beside itself."""
    return Y.copies(memories(s, d), "id", "content", ["project", "kind"])


def dedupe_report(s, d):
    rows = Y.worded(memories(s, d, once_per_id), "id", "content", ["project"], 3)
    copies = Y.further(rows)
    groups = Y.seed_groups(Y.alike(rows, copies, Y.REPORT)).toDF("group", "id")
    return Y.with_copies(groups, copies).select(F.col("group").alias("seed"), F.col("id").alias("member"))


def merge_on_insert(s, d):
    """What inserting the rows one by one, oldest first, leaves of those that were merged."""
    m = memories(s, d)
    groups = cut(Y.inserted(m, "id", "content", ["project", "kind"], "created_at"))
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    return Y.merged(m, groups.join(several, "group", "left_semi")).select("group", F.md5("content").alias("content_md5"), "importance", "tags", "session_id", "n")


def gc_scores(s, d):
    return memories(s, d).select("id", F.round(Y.gc_score(AS_OF), 6).alias("score"))


def gc_candidates(s, d):
    return Y.gc_candidates(memories(s, d), AS_OF).select("id", "kind", "project", F.round("score", 6).alias("score"), "place")


def gc_preview(s, d):
    return Y.gc_groups(Y.gc_candidates(memories(s, d), AS_OF), AS_OF)


def gc_plan(s, d):
    return Y.gc_plan(memories(s, d), AS_OF)


def gc_summaries(s, d):
    return Y.summaries(Y.gc_candidates(memories(s, d), AS_OF), ["kind", "project"], F.concat(F.lit("Merged "), F.col("kind")))


def keyword_top5(s, d):
    return Y.keywords(memories(s, d).filter("project is not null"), ["project"], "content", 5)


def capsule_groups(s, d):
    return Y.capsule_groups(memories(s, d), AS_OF).select("id", "project", "chunk")


def capsule_summaries(s, d):
    return Y.summaries(Y.capsule_groups(memories(s, d), AS_OF), ["project", "chunk"], F.lit("Capsule"), n_keywords=8, bullets=6)


def session_capsules(s, d):
    return Y.session_capsules(memories(s, d))


QUERIES = {f.__name__: f for f in (exact_dups, jaccard_pairs, jaccard_members, dedupe_report, merge_on_insert, gc_scores, gc_candidates, gc_preview, gc_plan, gc_summaries, keyword_top5, capsule_groups, capsule_summaries, session_capsules)}

NORM = r"trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g'))"
PROT = f"({PIN} OR list_contains(tags, 'session_capsule'))"
SCORE = f"""least(0.4 * (1 - (importance - 1) / 4) + 0.3 * least(greatest(coalesce({AGE.format('updated_at')}, 0), 0) / 365, 1.0) + 0.3 * CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in Y.KIND_WEIGHT.items())} ELSE 0.5 END, 1.0)"""
GC = f"""gc AS (SELECT *, {AGE.format('updated_at')} AS age, {SCORE} AS score FROM m WHERE kind IN ('bug', 'snippet', 'note', 'todo') AND NOT {PROT} AND NOT {EXP} AND importance < 3 AND {AGE.format('updated_at')} >= 30),
  cand AS (SELECT *, row_number() OVER (PARTITION BY kind, project ORDER BY score DESC, id) AS place FROM gc WHERE score > 0.6 QUALIFY place <= 10)"""
SETS = lambda least, by: f"ws AS (SELECT id, project, kind, list_sort(list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) >= {least}))) AS w FROM m), cl AS (SELECT min(id) AS id, {by}, w FROM ws WHERE len(w) > 0 GROUP BY {by}, w)"
# the first sentence of a text, as functions.text has it
FIRST = r"""substr(CASE WHEN regexp_extract(trim(content), '(?s)^(.{24,}?[.!?])(?:\s|$)', 1) <> '' AND length(regexp_extract(trim(content), '(?s)^(.{24,}?[.!?])(?:\s|$)', 1)) <= 200
  THEN regexp_replace(regexp_extract(trim(content), '(?s)^(.{24,}?[.!?])(?:\s|$)', 1), '\s+', ' ', 'g') ELSE string_split(trim(content), chr(10))[1] END, 1, 200)"""
CAPSULES = f"""cw AS (SELECT session_id, id, created_at, {FIRST} AS s, importance + CASE WHEN kind = 'decision' THEN 5 WHEN kind IN ('architecture', 'preference') THEN 4 WHEN kind IN ('bug', 'milestone') THEN 3 ELSE 1 END AS v FROM m WHERE session_id IS NOT NULL AND kind <> 'credential'),
  cr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY v DESC, created_at NULLS FIRST, id) AS r FROM cw), caps AS (SELECT session_id, count(*) AS n, string_agg('- ' || s, chr(10) ORDER BY r) FILTER (WHERE r <= 6) AS capsule FROM cr GROUP BY 1 HAVING count(*) >= 2)"""
SUMMED = lambda rows, by, label, words, bullets: f"""src AS ({rows}), o AS (SELECT *, {FIRST} AS s, row_number() OVER (PARTITION BY {by} ORDER BY importance DESC, updated_at DESC NULLS LAST, id) AS r FROM src), b AS (SELECT {by}, count(*) AS n, string_agg('- ' || s, chr(10) ORDER BY r) FILTER (WHERE r <= {bullets}) AS bl FROM o GROUP BY {by}),
  t AS (SELECT {by}, unnest(list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) >= 4 AND NOT list_contains({Y.STOP!r}, w)))) AS term FROM src), c AS (SELECT {by}, term, count(*) AS df FROM t GROUP BY ALL), k AS (SELECT {by}, string_agg(term, ', ' ORDER BY df DESC, term) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY df DESC, term) AS r FROM c) WHERE r <= {words} GROUP BY {by})
  SELECT {', '.join('b.' + x.strip() for x in by.split(','))}, n, {label} || ' (' || n || '): ' || coalesce(kw, '') || chr(10) || bl AS summary FROM b LEFT JOIN k ON {' AND '.join(f'b.{x.strip()} IS NOT DISTINCT FROM k.{x.strip()}' for x in by.split(','))}"""  # noqa: E731
SQL = {
    "session_capsules": f"WITH {M}, {CAPSULES} SELECT session_id, n, capsule FROM caps",
    "gc_summaries": f"WITH {M}, {GC}, " + SUMMED("SELECT * FROM cand", "kind, project", "'Merged ' || b.kind", 5, 8),
    "capsule_summaries": f"""WITH {M}, x AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY updated_at NULLS FIRST, id) - 1) // 10 AS chunk FROM m WHERE kind NOT IN ('credential', 'architecture', 'preference') AND NOT {PROT} AND importance <= 3 AND {AGE.format('updated_at')} >= 14),
        """ + SUMMED("SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY project) >= 3 AND count(*) OVER (PARTITION BY project, chunk) >= 2", "project, chunk", "'Capsule'", 8, 6),
    "exact_dups": f"WITH {M} SELECT project, count(*) AS n, min(id) AS keep FROM m GROUP BY project, content HAVING count(*) > 1",
    "jaccard_pairs": f"""WITH {M}, {SETS(1, 'project, kind')}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS t FROM cl a JOIN cl b ON a.project IS NOT DISTINCT FROM b.project AND a.kind IS NOT DISTINCT FROM b.kind AND a.id < b.id)
        SELECT a, b, round(c / (t - c), 6) AS similarity FROM p WHERE c / (t - c) >= 0.85 - 1e-12""",
    "jaccard_members": f"WITH {M}, {SETS(1, 'project, kind')} SELECT cl.id AS representative, ws.id AS member FROM ws JOIN cl ON ws.project IS NOT DISTINCT FROM cl.project AND ws.kind IS NOT DISTINCT FROM cl.kind AND ws.w = cl.w AND ws.id <> cl.id",
    "gc_scores": f"WITH {M} SELECT id, round({SCORE}, 6) AS score FROM m",
    "gc_candidates": f"WITH {M}, {GC} SELECT id, kind, project, round(score, 6) AS score, place FROM cand",
    "gc_preview": f"""WITH {M}, {GC} SELECT kind, project, count(*) AS n, round(avg(score), 2) AS score, min(age) AS youngest, max(age) AS oldest, min(importance) AS low, max(importance) AS high, list_sort(list(id)) AS ids FROM cand GROUP BY 1, 2 HAVING count(*) > 1""",
    "gc_plan": f"""WITH {M}, {GC}, g AS (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY kind, project) AS n FROM cand) WHERE n > 1) SELECT id, CASE WHEN {EXP} THEN 'expire' WHEN id IN (SELECT id FROM g) THEN 'merge' ELSE 'keep' END AS action FROM m""",
    "keyword_top5": f"""WITH {M}, t AS (SELECT project, unnest(list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) >= 4 AND NOT list_contains({Y.STOP!r}, w)))) AS term FROM m WHERE project IS NOT NULL), c AS (SELECT project, term, count(*) AS df FROM t GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY df DESC, term) AS r FROM c) SELECT project, list(term ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY 1""",
    "capsule_groups": f"""WITH {M}, x AS (SELECT id, project, (row_number() OVER (PARTITION BY project ORDER BY updated_at NULLS FIRST, id) - 1) // 10 AS chunk FROM m WHERE kind NOT IN ('credential', 'architecture', 'preference') AND NOT {PROT} AND importance <= 3 AND {AGE.format('updated_at')} >= 14),
        y AS (SELECT *, count(*) OVER (PARTITION BY project) AS a, count(*) OVER (PARTITION BY project, chunk) AS n FROM x) SELECT id, project, chunk FROM y WHERE a >= 3 AND n >= 2""",
}

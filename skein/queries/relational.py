"""Scans, filters, joins, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import relational as R
from skein.tables import AS_OF, SLUG, L, M, links, memories, one_per_id, slug, table

TS = f"TIMESTAMP '{AS_OF}'"
AGE = f"floor((epoch({TS}) - epoch({{0}})) / 86400)"
PIN = "list_contains(tags, 'pinned')"
P = f"p AS (SELECT {SLUG.format('name')} AS slug, * FROM projects)"
text_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def scan_all(s, d):
    return memories(s, d).select("id", "kind", "project", "importance", "source", "access_count", F.size("tags").alias("n_tags"), F.length("content").alias("n_chars"), "session_id", "thread_id", "window_id", text_time("updated_at"))


def point_lookup(s, d):
    return memories(s, d).filter(F.col("id") == "s1__t0").select("id", "content", "kind", "project")


def list_page(s, d):
    return R.page(memories(s, d), project="nimbus-relay", not_kind="credential", limit=20, offset=10).select("id", "kind", text_time("updated_at"))


def list_total(s, d):
    return memories(s, d).filter("project = 'nimbus-relay' and kind <> 'credential'").agg(F.count(F.lit(1)).alias("total"))


def hard_filter(s, d):
    return memories(s, d).filter("project = 'onyx-nest' and kind = 'decision'").select("id", "importance")


def visible_default(s, d):
    return R.visible(memories(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scope_filter(s, d):
    return R.in_scope(memories(s, d), session_id="s2", thread_id=None).select("id", "thread_id", "window_id")


def scope_ranking(s, d):
    scored = memories(s, d).withColumn("score", R.scope_score("s2", "th-467", "w27")).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(50).select("id", "score")


def expired_rows(s, d):
    return memories(s, d).filter(R.expired(AS_OF)).select("id", text_time("expires_at"))


def critical_rows(s, d):
    return memories(s, d).filter(R.critical(AS_OF)).select("id", "importance")


def pinned_rows(s, d):
    return memories(s, d).filter(R.pinned()).select("id", F.array_contains("tags", "session_capsule").alias("capsule"))


def bulk_delete_plan(s, d):
    return R.bulk_delete_matches(memories(s, d), AS_OF, importance_max=2, older_than_days=90).select("id", "kind", "importance")


def tag_overlap(s, d):
    return memories(s, d).filter(R.has_tag("perf", "INDEX")).select("id")


def stats_by_kind(s, d):
    return R.counts_by(memories(s, d), "kind")


def stats_by_project(s, d):
    return R.counts_by(memories(s, d), "project")


def stats_by_importance(s, d):
    return R.counts_by(memories(s, d), "importance")


def store_stats(s, d):
    m = memories(s, d)
    return m.agg(F.count(F.lit(1)).alias("total"), F.count_if(R.expired(AS_OF)).alias("expired_pending"), F.count_distinct("project").alias("projects"), F.count_distinct("kind").alias("kinds"), F.sum("access_count").alias("accesses"))


def hygiene_counts(s, d):
    projects = R.project_identities(table(s, d, "projects"), slug(F.col("name")))
    return R.hygiene(memories(s, d), table(s, d, "memory_links"), projects, AS_OF)


def health_counts(s, d):
    return R.health(memories(s, d), table(s, d, "memory_links"), AS_OF)


def project_slugs(s, d):
    out = R.project_identities(table(s, d, "projects"), slug(F.col("name")))
    return out.select("slug", "path", "description", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def project_counts(s, d):
    projects = R.project_identities(table(s, d, "projects"), slug(F.col("name"))).select(F.col("slug").alias("project"))
    counts = memories(s, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return projects.join(counts, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("n"))


def unknown_projects(s, d):
    projects = R.project_identities(table(s, d, "projects"), slug(F.col("name"))).select(F.col("slug").alias("project"))
    return memories(s, d).filter("project is not null").join(projects, "project", "left_anti").select("id", "project")


def orphan_links(s, d):
    ids = memories(s, d).select("id")
    raw = table(s, d, "memory_links").select("source_id", "target_id").distinct()
    lost = raw.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("source_id", "target_id")
    return lost.unionByName(raw.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("source_id", "target_id")).distinct()


def known_project_rows(s, d):
    projects = R.project_identities(table(s, d, "projects"), slug(F.col("name"))).select(F.col("slug").alias("project"))
    return memories(s, d).join(projects, "project", "left_semi").groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def detect_project(s, d):
    projects = R.project_identities(table(s, d, "projects"), slug(F.col("name")))
    paths = projects.filter("path is not null").select(F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/src/lib/a.py")).alias("path")).unionByName(s.createDataFrame([("/nowhere/at/all",), ("/work/onyx-nestling/x",)], "path string"))
    return R.project_of_path(paths, projects)


def metadata_overlay(s, d):
    """Scope keys laid over the row's own, as a merge does: a given key wins, others stay."""
    given = F.create_map(F.lit("thread_id"), F.lit("th-new"))
    own = F.map_filter(F.create_map(*(x for k in ("session_id", "thread_id", "window_id") for x in (F.lit(k), F.col(k)))), lambda k, v: v.isNotNull())
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(own, lambda k, v: k != "thread_id")), F.map_entries(given)))
    return memories(s, d).withColumn("m", merged).select("id", F.col("m")["session_id"].alias("session_id"), F.col("m")["thread_id"].alias("thread_id"), F.col("m")["window_id"].alias("window_id"))


def recent_ring(s, d):
    accesses = table(s, d, "access_stream").filter("memory_id is not null").select("client", "memory_id", "accessed_at").distinct()
    return R.newest_per(accesses, ["client"], "accessed_at", "memory_id", 20).select("client", "memory_id", "position")


def working_memory(s, d):
    """The 256 newest rows that a project may recall: its own and the global ones, with any of the terms in their text."""
    rows = memories(s, d).filter("project = 'nimbus-relay' or project is null").withColumn("one", F.lit(1))
    kept = R.newest_per(rows, ["one"], "created_at", "id", 256)
    text = F.lower(F.substring("content", 1, 4000))
    return kept.filter(text.contains("cache") | text.contains("lease")).select("id", "position")


def upsert_counts(s, d):
    """What a batch insert of text_chunks as memories would do, by outcome."""
    known = memories(s, d).select(F.col("content").alias("text"), F.lit(1).alias("known")).distinct()
    chunks = one_per_id(table(s, d, "text_chunks").select("chunk_id", "text"), "chunk_id")
    outcome = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "skipped").when(F.col("known") == 1, "merged").otherwise("added")
    return chunks.join(known, "text", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def bulk_update(s, d):
    """Partial update: given values win, null leaves a column as it is; the vector is stale where the text changed."""
    changes = memories(s, d).filter("kind = 'todo'").select("id", F.when(F.col("importance") > 3, F.lit("DONE")).alias("new_content"), F.lit(1).alias("new_importance"), F.lit(None).cast("string").alias("new_kind"))
    joined = memories(s, d).join(changes, "id")
    return joined.select("id", F.length(F.coalesce("new_content", "content")).alias("n_chars"), F.coalesce("new_importance", "importance").alias("importance"), F.coalesce("new_kind", "kind").alias("kind"), (F.coalesce("new_content", "content") != F.col("content")).alias("embed_again"))


def delete_cascade(s, d):
    """What stays of the links when the todos are deleted."""
    gone = memories(s, d).filter("kind = 'todo'").select("id")
    left = links(s, d).join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return left.select("source_id", "target_id", "relation")


def pin_toggle(s, d):
    """Pinning adds the tag once and lifts the importance to 4; unpinning takes every copy of the tag away."""
    m = memories(s, d)
    return m.select("id", F.array_sort(F.array_union("tags", F.array(F.lit("pinned")))).alias("pinned_tags"), F.greatest("importance", F.lit(4)).alias("pinned_importance"), F.array_sort(F.array_remove("tags", "pinned")).alias("unpinned_tags"))


QUERIES = {f.__name__: f for f in (scan_all, point_lookup, list_page, list_total, hard_filter, visible_default, scope_filter, scope_ranking, expired_rows, critical_rows, pinned_rows, bulk_delete_plan, tag_overlap, stats_by_kind, stats_by_project, stats_by_importance, store_stats, hygiene_counts, health_counts, project_slugs, project_counts, unknown_projects, orphan_links, known_project_rows, detect_project, metadata_overlay, recent_ring, working_memory, upsert_counts, bulk_update, delete_cascade, pin_toggle)}

fmt = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
EXP = f"coalesce(expires_at < {TS}, false)"
ID = f"""ids AS (SELECT slug, min(created_at) AS created_at, arg_min(path, (created_at, path)) FILTER (WHERE trim(coalesce(path, '')) <> '') AS path,
  arg_min(description, (created_at, description)) FILTER (WHERE trim(coalesce(description, '')) <> '') AS description FROM p WHERE slug IS NOT NULL GROUP BY slug)"""

SQL = {
    "scan_all": f"WITH {M} SELECT id, kind, project, importance, source, access_count, len(tags) AS n_tags, length(content) AS n_chars, session_id, thread_id, window_id, {fmt.format('updated_at')} AS updated_at FROM m",
    "point_lookup": f"WITH {M} SELECT id, content, kind, project FROM m WHERE id = 's1__t0'",
    "list_page": f"WITH {M} SELECT id, kind, {fmt.format('u')} AS updated_at FROM (SELECT id, kind, updated_at AS u FROM m WHERE project = 'nimbus-relay' AND kind <> 'credential' ORDER BY updated_at DESC NULLS LAST, id LIMIT 20 OFFSET 10)",
    "list_total": f"WITH {M} SELECT count(*) AS total FROM m WHERE project = 'nimbus-relay' AND kind <> 'credential'",
    "hard_filter": f"WITH {M} SELECT id, importance FROM m WHERE project = 'onyx-nest' AND kind = 'decision'",
    "visible_default": f"WITH {M} SELECT kind, count(*) AS n FROM m WHERE kind IS DISTINCT FROM 'credential' GROUP BY kind",
    "scope_filter": f"WITH {M} SELECT id, thread_id, window_id FROM m WHERE session_id = 's2'",
    "scope_ranking": f"""WITH {M}, x AS (SELECT id, updated_at, CASE WHEN thread_id = 'th-467' THEN 4 ELSE 0 END + CASE WHEN window_id = 'w27' THEN 2 ELSE 0 END + CASE WHEN session_id = 's2' THEN 1 ELSE 0 END AS score FROM m)
        SELECT id, score FROM x WHERE score > 0 ORDER BY score DESC, updated_at DESC NULLS LAST, id LIMIT 50""",
    "expired_rows": f"WITH {M} SELECT id, {fmt.format('expires_at')} AS expires_at FROM m WHERE {EXP}",
    "critical_rows": f"WITH {M} SELECT id, importance FROM m WHERE importance >= 4 AND NOT {EXP}",
    "pinned_rows": f"WITH {M} SELECT id, list_contains(tags, 'session_capsule') AS capsule FROM m WHERE {PIN}",
    "bulk_delete_plan": f"WITH {M} SELECT id, kind, importance FROM m WHERE importance <= 2 AND {AGE.format('updated_at')} >= 90 AND NOT {PIN}",
    "tag_overlap": f"WITH {M} SELECT id FROM m WHERE list_has_any(list_transform(tags, lambda x: lower(x)), ['perf', 'index'])",
    "stats_by_kind": f"WITH {M} SELECT coalesce(kind, '(global)') AS kind, count(*) AS n FROM m GROUP BY 1",
    "stats_by_project": f"WITH {M} SELECT coalesce(project, '(global)') AS project, count(*) AS n FROM m GROUP BY 1",
    "stats_by_importance": f"WITH {M} SELECT CAST(importance AS VARCHAR) AS importance, count(*) AS n FROM m GROUP BY 1",
    "store_stats": f"WITH {M} SELECT count(*) AS total, count(*) FILTER (WHERE {EXP}) AS expired_pending, count(DISTINCT project) AS projects, count(DISTINCT kind) AS kinds, CAST(sum(access_count) AS BIGINT) AS accesses FROM m",
    "hygiene_counts": f"""WITH {M}, {P} SELECT count(*) AS total, count(*) FILTER (WHERE project IS NULL) AS no_project, count(*) FILTER (WHERE len(tags) = 0) AS no_tags, count(*) FILTER (WHERE {EXP}) AS expired, count(*) FILTER (WHERE {PIN}) AS pinned, count(*) FILTER (WHERE trim(content) = '') AS "empty",
        count(*) FILTER (WHERE coalesce(access_count, 0) = 0) AS never_used, count(*) FILTER (WHERE updated_at > {TS}) AS future_update,
        (SELECT count(*) FROM (SELECT source_id AS x FROM memory_links UNION ALL SELECT target_id FROM memory_links) WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM m)) AS orphan_link_ends,
        count(*) FILTER (WHERE project IS NOT NULL AND project NOT IN (SELECT slug FROM p WHERE slug IS NOT NULL)) AS unknown_project FROM m""",
    "health_counts": f"""WITH {M} SELECT count(*) AS total, count(*) FILTER (WHERE {PIN}) AS pinned, count(*) FILTER (WHERE list_contains(tags, 'session_capsule')) AS capsules, count(*) FILTER (WHERE {AGE.format('updated_at')} > 30 AND importance <= 2) AS stale,
        count(*) FILTER (WHERE {AGE.format('updated_at')} > 30 AND importance <= 3 AND NOT ({PIN} OR list_contains(tags, 'session_capsule'))) AS compressible, round(avg({AGE.format('updated_at')}), 1) AS average_age, CAST(sum(length(content)) AS BIGINT) AS characters,
        (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM memory_links WHERE source_id NOT IN (SELECT id FROM m) OR target_id NOT IN (SELECT id FROM m))) AS orphan_links FROM m""",
    "project_slugs": f"WITH {P}, {ID} SELECT slug, path, description, {fmt.format('created_at')} AS created_at FROM ids",
    "project_counts": f"WITH {M}, {P} SELECT x.slug AS project, count(m.id) AS n FROM (SELECT DISTINCT slug FROM p WHERE slug IS NOT NULL) x LEFT JOIN m ON m.project = x.slug GROUP BY 1",
    "unknown_projects": f"WITH {M}, {P} SELECT id, project FROM m WHERE project IS NOT NULL AND project NOT IN (SELECT slug FROM p WHERE slug IS NOT NULL)",
    "orphan_links": "SELECT DISTINCT source_id, target_id FROM memory_links WHERE source_id NOT IN (SELECT id FROM memories) OR target_id NOT IN (SELECT id FROM memories)",
    "known_project_rows": f"WITH {M}, {P} SELECT project, count(*) AS n FROM m WHERE project IN (SELECT slug FROM p WHERE slug IS NOT NULL) GROUP BY 1",
    "detect_project": f"""WITH {P}, {ID}, r AS (SELECT regexp_replace(path, '/+$', '') AS root, slug FROM ids WHERE path IS NOT NULL),
        q AS (SELECT root || '/src/lib/a.py' AS path FROM r UNION ALL VALUES ('/nowhere/at/all'), ('/work/onyx-nestling/x'))
        SELECT q.path, arg_max(r.slug, (length(r.root), r.slug)) AS project FROM q LEFT JOIN r ON q.path = r.root OR starts_with(q.path, r.root || '/') GROUP BY q.path""",
    "metadata_overlay": f"WITH {M} SELECT id, session_id, 'th-new' AS thread_id, window_id FROM m",
    "recent_ring": """SELECT client, memory_id, position FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY accessed_at DESC NULLS LAST, memory_id) AS position
        FROM (SELECT DISTINCT client, memory_id, accessed_at FROM access_stream WHERE memory_id IS NOT NULL)) WHERE position <= 20""",
    "working_memory": f"""WITH {M} SELECT id, position FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS position FROM m WHERE project = 'nimbus-relay' OR project IS NULL)
        WHERE position <= 256 AND (contains(lower(substr(content, 1, 4000)), 'cache') OR contains(lower(substr(content, 1, 4000)), 'lease'))""",
    "upsert_counts": f"""WITH {M}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM text_chunks)
        SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'skipped' WHEN text IN (SELECT content FROM m) THEN 'merged' ELSE 'added' END AS outcome, count(*) AS n FROM c GROUP BY 1""",
    "bulk_update": f"""WITH {M} SELECT id, length(CASE WHEN importance > 3 THEN 'DONE' ELSE content END) AS n_chars, 1 AS importance, kind, (importance > 3 AND content <> 'DONE') AS embed_again FROM m WHERE kind = 'todo'""",
    "delete_cascade": f"WITH {M}, {L} SELECT source_id, target_id, relation FROM l WHERE source_id NOT IN (SELECT id FROM m WHERE kind = 'todo') AND target_id NOT IN (SELECT id FROM m WHERE kind = 'todo')",
    "pin_toggle": f"""WITH {M} SELECT id, list_sort(list_distinct(list_append(tags, 'pinned'))) AS pinned_tags, greatest(importance, 4) AS pinned_importance, list_sort(list_filter(tags, lambda x: x <> 'pinned')) AS unpinned_tags FROM m""",
}

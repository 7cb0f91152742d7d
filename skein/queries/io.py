"""Exports, and imports of files that the queries write themselves into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators.relational import visible
from skein.queries.lifecycle import CAPSULES
from skein.session import prepare
from skein.sources import readers as I
from skein.sources import writers as O
from skein.tables import M, memories


def folder(s) -> str:
    prepare(s)
    return f"{s.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"


def export_json(s, d):
    """Written as JSON and read again."""
    at = folder(s)
    m = memories(s, d)
    O.write_json(m.select("id", "content", "kind", "project", "tags", "importance"), at)
    return s.read.schema("id string, content string, kind string, project string, tags array<string>, importance int").json(at).select("id", "kind", "project", "importance", F.length("content").alias("n_chars"), F.size("tags").alias("n_tags"))


def export_markdown(s, d):
    return O.markdown_lines(visible(memories(s, d))).select("kind", "line_no", F.length("line").alias("n_chars"))


def export_sessions(s, d):
    return O.session_documents(memories(s, d)).select("session_id", "n", F.length("document").alias("n_chars"))


def cleaned_text(s, d):
    return memories(s, d).select("id", O.cleaned(F.col("content")).alias("text"))


def import_folder(s, d):
    """Texts of a folder: every project's documents as one text file, the first twenty by path."""
    at = folder(s)
    m = memories(s, d).filter("project is not null").select("project", F.regexp_replace("content", "\\s+", " ").alias("value"))
    m.repartition("project").write.partitionBy("project").text(at)
    return I.text_folder(s, at).select(F.regexp_extract("path", r"project=([^/]+)", 1).alias("project"), (F.length("text") > 0).alias("has_text")).distinct()


def import_legacy(s, d):
    """An export of an earlier version, of which the store holds all but the rows that are marked."""
    at = folder(s)
    m = memories(s, d).filter("kind = 'todo'")
    rows = m.select(F.array(F.struct("id", F.when(F.col("importance") >= 4, F.concat("content", F.lit(" (old)"))).otherwise(F.col("content")).alias("content"), F.lit("problem").alias("kind"), "tags", "importance", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))).alias("memories"))
    rows.write.json(at)
    return I.legacy_export(s, at, memories(s, d), lines=True).select("id", "kind", "importance")


def import_questions(s, d):
    """A question set written and read: sessions of the store as haystacks, one question a session."""
    at = folder(s)
    turns = memories(s, d).filter("session_id is not null").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))), lambda t: F.struct(F.lit("user").alias("role"), t["content"].alias("content"))).alias("session"))
    q = turns.select(F.col("session_id").alias("question_id"), F.lit("what was said?").alias("question"), F.lit("single-session-user").alias("question_type"), F.lit("2025/11/01 (Sat) 10:00").alias("question_date"), F.array("session_id").alias("answer_session_ids"), F.array("session_id").alias("haystack_session_ids"), F.array(F.lit("2025/10/01 (Wed) 09:00")).alias("haystack_dates"), F.array("session").alias("haystack_sessions"))
    q.write.json(at)
    questions, t = I.question_set(s, at, lines=True)
    return questions.join(t, "question_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("turns"), F.max("n").alias("last"))


QUERIES = {f.__name__: f for f in (export_json, export_markdown, export_sessions, cleaned_text, import_folder, import_legacy, import_questions)}

CLEANED = rf"""substr(array_to_string(list_filter(string_split_regex(content, '\r?\n'), lambda x: NOT regexp_matches(x, '{O.NOISE}'))[1:{O.LINES}], chr(10)), 1, {O.CHARACTERS})"""
SQL = {
    "cleaned_text": f"WITH {M} SELECT id, {CLEANED} AS text FROM m",
    "export_sessions": f"""WITH {M}, {CAPSULES}, d AS (SELECT session_id, count(*) AS n, string_agg('### ' || kind || chr(10) || {CLEANED}, chr(10) || chr(10) ORDER BY created_at NULLS FIRST, id) AS t, strftime(min(created_at), '%Y-%m-%d') AS since FROM m WHERE session_id IS NOT NULL AND kind <> 'credential' GROUP BY 1)
        SELECT d.session_id, d.n, length(concat_ws(chr(10) || chr(10), '---' || chr(10) || 'session: ' || d.session_id || chr(10) || 'rows: ' || d.n || chr(10) || 'since: ' || since || chr(10) || '---', capsule, t)) AS n_chars FROM d LEFT JOIN caps ON caps.session_id = d.session_id""",
    "import_folder": f"WITH {M} SELECT project, true AS has_text FROM (SELECT DISTINCT project FROM m WHERE project IS NOT NULL) ORDER BY project || '/' LIMIT 20",
    "export_json": f"WITH {M} SELECT id, kind, project, importance, length(content) AS n_chars, len(tags) AS n_tags FROM m",
    "export_markdown": rf"""WITH {M}, v AS (SELECT * FROM m WHERE kind <> 'credential'), r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY importance DESC, created_at NULLS FIRST, id) AS line_no,
        concat_ws(' ', '- ' || regexp_replace(content, '\s*\n\s*', ' ', 'g'), repeat('★', importance), nullif(array_to_string(list_transform(tags, lambda t: '`' || t || '`'), ' '), '')) AS line FROM v)
        SELECT kind, line_no, length(line) AS n_chars FROM r UNION ALL SELECT kind, 0, length('## ' || kind || ' (' || count(*) || ')') FROM v GROUP BY kind""",
    "import_legacy": f"WITH {M} SELECT id, 'bug' AS kind, importance FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY strftime(created_at, '%Y-%m-%d'), id) AS r FROM m WHERE kind = 'todo' AND importance >= 4) WHERE r = 1",
    "import_questions": f"WITH {M} SELECT session_id AS question_id, count(*) AS turns, count(*) - 1 AS last FROM m WHERE session_id IS NOT NULL GROUP BY 1",
}

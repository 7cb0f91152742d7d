"""Streams over the tables, each checked against the same operator on the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.queries.text import PARTED
from skein.session import prepare
from skein.streaming import streams as S
from skein.tables import M, memories, table


#: Accesses come hours late, not days.
LATE = "2 days"


def folder(s) -> str:
    prepare(s)
    return f"{s.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def access_fold(s, d):
    """Uses by memory, as a batch over all accesses."""
    return S.access_counts(S.access_fold(table(s, d, "access_stream"))).select("memory_id", "added")


def access_fold_stream(s, d):
    """The same as a stream: a window's state is dropped two days behind the latest access, and what comes later still is not counted."""
    stream = S.access_fold(S.replay(s, f"{d}/access_stream.parquet"), late=LATE)
    return S.access_counts(S.drain(stream, folder(s))).select("memory_id", "added")


def access_applied(s, d):
    return S.apply_accesses(memories(s, d), S.access_counts(S.access_fold(table(s, d, "access_stream")))).select("id", "access_count")


def ring_stream(s, d):
    """The last state of every client's twenty newest memories, from the stream."""
    out = S.drain(S.recent_ring(S.replay(s, f"{d}/access_stream.parquet"), "client", "memory_id", "accessed_at"), folder(s), mode="update")
    return out.groupBy(F.col("key").alias("client")).agg(F.max_by("items", "batch").alias("items")).select("client", F.posexplode("items").alias("place", "memory_id"))


def error_stream(s, d):
    """Clients as checks, by time: an access to an unknown memory is an error until a known one follows. How often errors were raised and cleared."""
    a = S.replay(s, f"{d}/access_stream.parquet").select("client", F.when(F.col("memory_id").isNull(), "failed").otherwise("ok").alias("status"), F.lit("no memory").alias("message"), "accessed_at")
    out = S.drain(S.error_states(a, "client", "status", "message", "accessed_at"), folder(s))
    return out.groupBy(F.col("key").alias("client")).agg(F.count_if(F.col("event") == "raised").alias("raised"), F.count_if(F.col("event") == "cleared").alias("cleared"))


#: Places of the test files of file_changes_stream; the last three are not watched.
PLACES = ("src/{}Store.rs", "docs/{}.md", "{}/Makefile", ".cache/{}.py", "target/{}.rs", "media/{}.png")


def file_changes_stream(s, d):
    """Files named after the projects, some where changes do not count, as a stream of changes."""
    at = folder(s) + "/files"
    names = sorted(r["project"] for r in memories(s, d).filter("project rlike '^[a-z]'").select("project").distinct().limit(1_000).collect())  # test files, one each
    files = [(place.format(name), b"x") for name in names for place in PLACES]
    fs = s.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for path, text in files:
        out = fs.create(s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{path}"))
        out.write(bytearray(text))
        out.close()
    changes = S.drain(S.file_changes(s, at), folder(s))
    return changes.select(F.regexp_extract("path", "/files/(.*)$", 1).alias("path"), "name", "words")


def event_windows(s, d):
    """Views by day with late events counted, from the events table."""
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return e.groupBy(F.date_format(F.window("ts", "1 day").start, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def user_sessions(s, d):
    """Sessions of users by gaps of 30 minutes."""
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def ttl_stream(s, d):
    rows = S.replay(s, f"{d}/memories.parquet").select("id", "created_at", "expires_at")
    out = S.drain(S.expiring(rows), folder(s))
    return out.select("id").distinct()


QUERIES = {f.__name__: f for f in (access_fold, access_fold_stream, access_applied, ring_stream, error_stream, file_changes_stream, event_windows, user_sessions, ttl_stream)}

FOLD = "SELECT memory_id, count(DISTINCT epoch_us(accessed_at) // 2000000) AS added FROM access_stream WHERE memory_id IS NOT NULL AND accessed_at IS NOT NULL GROUP BY 1"
PATHS = ", ".join("'" + p.replace("{}", "' || project || '") + "'" for p in PLACES[:3])
SQL = {
    "error_stream": """WITH x AS (SELECT client, memory_id IS NOT NULL AS ok, accessed_at FROM access_stream WHERE client IS NOT NULL), y AS (SELECT client, ok, lag(ok) OVER (PARTITION BY client ORDER BY accessed_at NULLS LAST, ok) AS was FROM x)
        SELECT client, count(*) FILTER (WHERE NOT ok AND coalesce(was, true)) AS raised, count(*) FILTER (WHERE ok AND NOT was) AS cleared FROM y GROUP BY 1 HAVING raised + cleared > 0""",
    "file_changes_stream": f"""WITH {M}, p AS (SELECT unnest([{PATHS}]) AS path FROM (SELECT DISTINCT project FROM m WHERE regexp_matches(project, '^[a-z]'))), w AS (SELECT path, string_split(path, '/')[-1] AS name, list_transform(list_filter(string_split_regex({PARTED}, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3), lambda x: lower(x)) AS ws FROM p)
        SELECT path, name, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS words FROM w""",
    "access_fold": FOLD,
    "access_fold_stream": FOLD,
    "access_applied": f"WITH {M}, a AS ({FOLD}) SELECT id, coalesce(access_count, 0) + coalesce(added, 0) AS access_count FROM m LEFT JOIN a ON a.memory_id = m.id",
    "ring_stream": """WITH x AS (SELECT client, memory_id, max(accessed_at) AS t FROM access_stream WHERE memory_id IS NOT NULL AND client IS NOT NULL GROUP BY 1, 2)
        SELECT client, row_number() OVER (PARTITION BY client ORDER BY t DESC, memory_id) - 1 AS place, memory_id FROM x QUALIFY place < 20""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "user_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x),
        z AS (SELECT user_id, s, count(*) AS n FROM y GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM z GROUP BY 1""",
    "ttl_stream": "SELECT DISTINCT id FROM memories WHERE expires_at IS NULL OR expires_at > created_at",
}

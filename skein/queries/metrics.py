"""Retrieval metrics over self-retrieval, sessions, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import terms
from skein.operators import metrics as E
from skein.operators.batch import best_by_term
from skein.queries.graph import FOLD
from skein.session import stored
from skein.tables import M, memories, table


def self_queries(s, d):
    """The stated query set: every memory whose id, hashed to two hex digits, is divisible by 50 asks, against all, with its own first eight words."""
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substring(md5(id), {k}, 1)) - 1")
    chosen = memories(s, d).filter((digit(1) * 16 + digit(2)) % 50 == 0)
    return chosen.select(F.col("id").alias("query"), "id", "project", F.array_join(F.slice(terms(F.col("content")), 1, 8), " ").alias("text"), "kind")


def self_results(s, d):
    rows = stored(memories(s, d).select(F.col("id").alias("key"), terms(F.col("content")).alias("ts")))  # nothing else of the store is needed
    asked = self_queries(s, d).select("query", F.filter(F.split("text", " "), lambda t: t != "").alias("ts"))
    return best_by_term(rows, asked, 10).select("query", F.col("key").alias("id"), "rank")


def ir_metrics(s, d):
    return E.ranking_metrics(self_results(s, d), self_queries(s, d).select("query", "id"))


def ir_metrics_by_kind(s, d):
    return E.ranking_metrics(self_results(s, d), self_queries(s, d).select("query", "id", "kind"), ["kind"])


def recall_quality(s, d):
    return E.recall_quality(self_results(s, d), self_queries(s, d), memories(s, d))


def session_match(s, d):
    """Turns found for sessions: gold is the session of the asking row."""
    r = self_results(s, d)
    gold = self_queries(s, d).select("query", F.regexp_extract("query", r"^(.*)__t\d+$", 1).alias("id")).filter("id <> ''")
    return E.ranking_metrics(E.by_session(r), gold)


def session_buckets(s, d):
    """Of every session: turns, best importance, mean of the best three."""
    from pyspark.sql import Window

    key = F.regexp_extract("id", r"^(.*)__t\d+$", 1)
    m = memories(s, d).withColumn("session", key).filter("session <> ''")
    w = Window.partitionBy("session").orderBy(F.desc("importance"), "id")
    return m.withColumn("r", F.row_number().over(w)).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("best"), F.round(F.avg(F.when(F.col("r") <= 3, F.col("importance"))), 6).alias("mean3"))


def access_latency(s, d):
    """How late accesses arrive, in whole milliseconds, by client."""
    a = table(s, d, "access_stream").distinct()
    ms = F.floor((F.col("received_at").cast("timestamp").cast("double") - F.col("accessed_at").cast("timestamp").cast("double")) * 1000 + 1e-3).cast("long")
    return E.latency(a.withColumn("ms", ms), "client", "ms").select("client", "n", "p50", "p95", "p99", F.round("mean", 3).alias("mean"))


QUERIES = {f.__name__: f for f in (ir_metrics, ir_metrics_by_kind, recall_quality, session_match, session_buckets, access_latency)}

TERMS = rf"list_filter(string_split_regex({FOLD}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SELF = rf"""w AS (SELECT id, kind, project, {TERMS} AS ts FROM m), q AS (SELECT id AS query, kind, project, id, ts[1:8] AS qs FROM w WHERE ((instr('0123456789abcdef', md5(id)[1]) - 1) * 16 + instr('0123456789abcdef', md5(id)[2]) - 1) % 50 = 0),
  qt AS (SELECT query, unnest(qs) AS term, unnest(range(len(qs))) AS n FROM q), pos AS (SELECT id, unnest(ts) AS term FROM w), tf AS (SELECT id, term, count(*) AS freq FROM pos WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), per AS (SELECT query, n, id, freq FROM tf JOIN qt USING (term)),
  dfs AS (SELECT query, n, count(*) AS df FROM per GROUP BY 1, 2), st AS (SELECT count(*) AS nrows, avg(len(ts)) AS mean FROM w),
  sc AS (SELECT query, id, round(sum(greatest(ln((nrows - df + 0.5) / (df + 0.5)), 1e-6) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * len(ts) / mean))), 6) AS s FROM per JOIN dfs USING (query, n) JOIN w USING (id), st GROUP BY 1, 2),
  res AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM sc QUALIFY rank <= 10)"""
RANKED = lambda by="": f"""SELECT {by}count(*) AS n_queries, round(avg(CAST(coalesce(r, 9999) <= 1 AS INT)), 6) AS r_at_1, round(avg(CAST(coalesce(r, 9999) <= 5 AS INT)), 6) AS r_at_5, round(avg(CAST(coalesce(r, 9999) <= 10 AS INT)), 6) AS r_at_10, round(avg(coalesce(1 / r, 0)), 6) AS mrr,
  round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_at_10 FROM hit"""  # noqa: E731
SQL = {
    "ir_metrics": f"WITH {M}, {SELF}, hit AS (SELECT q.query, min(rank) AS r FROM q LEFT JOIN res USING (query, id) GROUP BY 1) {RANKED()}",
    "ir_metrics_by_kind": f"WITH {M}, {SELF}, hit AS (SELECT q.query, kind, min(rank) AS r FROM q LEFT JOIN res USING (query, id) GROUP BY 1, 2) {RANKED('kind, ')} GROUP BY kind",
    "session_match": rf"""WITH {M}, {SELF}, gold AS (SELECT query, regexp_extract(query, '^(.*)__t\d+$', 1) AS id FROM q WHERE regexp_matches(query, '^.+__t\d+$')), named AS (SELECT query, coalesce(nullif(regexp_extract(id, '^(.*)__t\d+$', 1), ''), id) AS id, min(rank) AS rank FROM res GROUP BY 1, 2),
        hit AS (SELECT gold.query, min(rank) AS r FROM gold LEFT JOIN named USING (query, id) GROUP BY 1) {RANKED()}""",
    "recall_quality": f"""WITH {M}, {SELF}, five AS (SELECT q.query, rank, res.id = q.id AS own, q.project IS NOT NULL AND m.project IS NOT NULL AND q.project <> m.project AS leak, m.kind = 'credential' AS secret FROM res JOIN m ON m.id = res.id JOIN q ON q.query = res.query WHERE rank <= 5),
        pq AS (SELECT query, max(CAST(own AND rank = 1 AS INT)) AS a, max(CAST(own AS INT)) AS b, max(CAST(leak AS INT)) AS c, max(CAST(secret AS INT)) AS e FROM five GROUP BY 1)
        SELECT count(*) AS n_specs, round(avg(coalesce(a, 0)), 2) AS top1, round(avg(coalesce(b, 0)), 2) AS top5, round(avg(coalesce(c, 0)), 2) AS project_leak, round(avg(coalesce(e, 0)), 2) AS credential_leak FROM q LEFT JOIN pq USING (query)""",
    "session_buckets": rf"""WITH {M}, x AS (SELECT regexp_extract(id, '^(.*)__t\d+$', 1) AS session, importance, id FROM m), y AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY importance DESC, id) AS r FROM x WHERE session <> '')
        SELECT session, count(*) AS n, max(importance) AS best, round(avg(importance) FILTER (WHERE r <= 3), 6) AS mean3 FROM y GROUP BY 1""",
    "access_latency": """WITH a AS (SELECT DISTINCT * FROM access_stream), x AS (SELECT client, (epoch_us(received_at) - epoch_us(accessed_at)) // 1000 AS ms FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY client) AS n FROM x WHERE ms IS NOT NULL)
        SELECT client, any_value(n) AS n, max(ms) FILTER (WHERE i = round((n - 1) * 0.5)) AS p50, max(ms) FILTER (WHERE i = round((n - 1) * 0.95)) AS p95, max(ms) FILTER (WHERE i = round((n - 1) * 0.99)) AS p99, round(avg(ms), 3) AS mean FROM y GROUP BY client""",
}

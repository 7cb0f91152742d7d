"""Tokens, postings, prefix and phrase and nearness matches, BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import lexical as L
from skein.tables import M, memories

#: Query texts of the registered queries.
ASKED = {"q1": "cache entries", "q2": "root cause lease", "q3": "memory budget", "q4": "planner deadlocks", "q5": "second site"}


def fields():
    return {"content": F.col("content"), "tags": F.array_join("tags", " "), "kind": F.col("kind"), "project": F.coalesce("project", F.lit(""))}


def asked(s):
    rows = s.createDataFrame(list(ASKED.items()), "query string, text string")
    return rows.select("query", F.posexplode(X.terms(F.col("text"))).alias("n", "term"))


def tokens(s, d):
    return memories(s, d).select("id", X.terms(F.col("content")).alias("terms"))


def postings(s, d):
    return L.postings(memories(s, d), "id", fields()).withColumnRenamed("key", "id")


def document_frequency(s, d):
    return L.postings(memories(s, d), "id", fields()).groupBy("term").agg(F.count_distinct("key").alias("df"), F.sum("tf").alias("cf"))


def prefix_match(s, d):
    q = asked(s)
    hits = L.all_terms(L.match_terms(L.positions(memories(s, d), "id", fields()), q, prefix=True), q)
    return hits.select("query", F.col("key").alias("id")).distinct()


def phrase_match(s, d):
    found = L.phrase(L.positions(memories(s, d), "id", fields()), asked(s))
    return found.withColumnRenamed("key", "id")


def near_match(s, d):
    return L.near(L.positions(memories(s, d), "id", fields()), asked(s), 8).select("query", F.col("key").alias("id")).distinct()


def bm25_scores(s, d):
    q = asked(s)
    m = memories(s, d)
    hits = L.all_terms(L.match_terms(L.positions(m, "id", fields()), q, prefix=True), q)
    return L.bm25(hits, L.lengths(m, "id", fields())).select("query", F.col("key").alias("id"), F.round("score", 6).alias("score"))


def bm25_top10(s, d):
    q = asked(s)
    m = memories(s, d)
    scored = L.bm25_by_term(L.positions(m, "id", {"content": F.col("content")}), q, L.lengths(m, "id", {"content": F.col("content")}), {}).withColumn("score", F.round("score", 6))
    return L.rank(scored, 10).withColumnRenamed("key", "id")


QUERIES = {f.__name__: f for f in (tokens, postings, document_frequency, prefix_match, phrase_match, near_match, bm25_scores, bm25_top10)}

FOLD = f"translate(lower({{0}}), '{X.MARKED}', '{X.PLAIN}')"
TERMS = "list_filter(string_split_regex(" + FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
F4 = """f AS (SELECT id, 'content' AS field, content AS v FROM m UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM m UNION ALL SELECT id, 'kind', kind FROM m UNION ALL SELECT id, 'project', coalesce(project, '') FROM m)"""
POS = f"""w AS (SELECT id, field, {TERMS.format("v")} AS ts FROM f), pos AS (SELECT id, field, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM w)"""
Q = "q AS (SELECT query, unnest(string_split(text, ' ')) AS term, unnest(range(len(string_split(text, ' ')))) AS n FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items()) + ") v(query, text)), need AS (SELECT query, count(*) AS need FROM q GROUP BY 1)"
HITS = "hits AS (SELECT query, n, id, field, count(*) AS tf FROM pos JOIN q ON starts_with(pos.term, q.term) GROUP BY ALL), full_hits AS (SELECT hits.* FROM hits JOIN (SELECT query, id FROM hits JOIN need USING (query) GROUP BY query, id, need HAVING count(DISTINCT n) = need) USING (query, id))"
SCORE = """per AS (SELECT query, n, id, sum(tf * {w}) AS freq FROM {h} GROUP BY 1, 2, 3), dfs AS (SELECT query, n, count(*) AS df FROM per GROUP BY 1, 2), lens AS (SELECT id, {len} AS len FROM w GROUP BY id),
  st AS (SELECT count(*) AS nrows, avg(len) AS mean FROM lens),
  sc AS (SELECT query, id, sum(greatest(ln((nrows - df + 0.5) / (df + 0.5)), 1e-6) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM per JOIN dfs USING (query, n) JOIN lens USING (id), st GROUP BY 1, 2)"""

SQL = {
    "tokens": f"WITH {M} SELECT id, {TERMS.format('content')} AS terms FROM m",
    "postings": f"WITH {M}, {F4}, {POS} SELECT id, field, term, count(*) AS tf FROM pos GROUP BY ALL",
    "document_frequency": f"WITH {M}, {F4}, {POS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM pos GROUP BY 1",
    "prefix_match": f"WITH {M}, {F4}, {POS}, {Q}, {HITS} SELECT DISTINCT query, id FROM full_hits",
    "phrase_match": f"""WITH {M}, {F4}, {POS}, {Q} SELECT query, id, field, count(*) AS n FROM (SELECT query, id, field, pos - n AS at, need FROM pos JOIN q USING (term) JOIN need USING (query) GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT n) = need) GROUP BY 1, 2, 3""",
    "near_match": f"""WITH {M}, {F4}, {POS}, {Q}, h AS (SELECT query, id, field, pos, n, need FROM pos JOIN q USING (term) JOIN need USING (query)),
        c AS (SELECT a.query, a.id, a.field, a.pos, a.need, b.n, min(a.pos - b.pos) AS back FROM h a JOIN h b ON a.query = b.query AND a.id = b.id AND a.field = b.field AND b.pos <= a.pos GROUP BY ALL)
        SELECT DISTINCT query, id FROM (SELECT query, id, field, pos, need FROM c GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = need AND max(back) - 1 <= 8)""",
    "bm25_scores": f"WITH {M}, {F4}, {POS}, {Q}, {HITS}, {SCORE.format(h='full_hits', w='''CASE field WHEN 'content' THEN 8 WHEN 'tags' THEN 5 WHEN 'kind' THEN 2 ELSE 4 END''', len='sum(len(ts))')} SELECT query, id, round(score, 6) AS score FROM sc",
    "bm25_top10": f"""WITH {M}, f AS (SELECT id, 'content' AS field, content AS v FROM m), {POS}, {Q}, h AS (SELECT query, n, id, count(*) AS tf FROM pos JOIN q USING (term) GROUP BY ALL), {SCORE.format(h='h', w='1', len='sum(len(ts))')}
        SELECT query, id, score, rank FROM (SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM sc) WHERE rank <= 10""",
}

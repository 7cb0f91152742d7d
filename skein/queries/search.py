"""The flagship: hybrid search, and its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.text import terms
from skein.operators import graph as G
from skein.operators import lexical as L
from skein.operators import vectors as V
from skein.plans import search as P
from skein.queries.graph import ALL_ENT, ENT
from skein.queries.relational import AGE
from skein.session import cut, stored
from skein.sources import golden
from skein.tables import L as L_
from skein.tables import AS_OF, M, T, links, memories, table, triples

ASKED = {"q1": "cache holds entries", "q2": "root cause of the lease", "q3": "when was the exporter moved", "q4": "what do we prefer for the window", "q5": "nimbus-relay memory budget"}
#: Documents as queries of the fusion query: their number is the vector's.
FUSED = {"d1": ("parser schema endpoint", 3), "d2": ("judge verdict contract", 57), "d3": ("garlic oven recipe", 101)}


def asked(s):
    q = s.createDataFrame(list(ASKED.items()), "query string, text string")
    return q.withColumn("v", V.hashed_embedding(F.col("text")))


#: What was built of a store in this application, by folder.
_BUILT: dict[tuple[str, str], tuple] = {}


def parts(s, d):
    """The store with what a deployment keeps beside it: vectors, links, entities and the index, as stored tables built once an application and folder."""
    known = (s.sparkContext.applicationId, d)
    if known not in _BUILT:
        m = stored(memories(s, d))
        f = P.fields_of(m)
        places, sizes = stored(L.positions(m, "id", f)), stored(L.lengths(m, "id", f))
        index = L.Index(places, sizes, stored(L.stem_forms(places.select("term").distinct())))
        _BUILT[known] = m, {"vectors": stored(m.select("id", V.hashed_embedding(F.col("content")).alias("v"))), "links": stored(links(s, d)), "triples": stored(triples(s, d)), "entities": stored(G.entities(m)), "index": index}
    return _BUILT[known]


def store_build(s, d):
    """(part, n): the rows of every table that a search reads; the first call in an application builds them."""
    m, more = parts(s, d)
    tables = {"memories": m, "places": more["index"].places, "sizes": more["index"].sizes, "words": more["index"].words} | {k: more[k] for k in ("vectors", "links", "triples", "entities")}
    return reduce(lambda a, b: a.unionByName(b), (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, t in tables.items()))


def hybrid_search(s, d):
    m, more = parts(s, d)
    return P.search(asked(s), m, P.Options(AS_OF), **more)


def hybrid_search_filtered(s, d):
    m, more = parts(s, d)
    return P.search(asked(s), m, P.Options(AS_OF, limit=5, project="nimbus-relay", tags=("pinned",), keywords=("exporter",)), **more)


def search_trace(s, d):
    """What each lane brought to each query, and what came out: the telemetry of a search."""
    m, more = parts(s, d)
    c = P.fused(asked(s), m, P.Options(AS_OF), **more)
    return c.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"), F.count("bm25_rank").alias("lexical"), F.count("vec_rank").alias("vector"), F.round(F.max("score"), 6).alias("best"))


def trace_log(s, d):
    """The telemetry of three single searches, a JSON line each, appended to one log and read again."""
    from skein.queries.io import folder
    from skein.sources import writers as O

    at, (m, more) = folder(s), parts(s, d)
    lane = cut(P.lexical_lane(asked(s), m, index=more["index"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("bm25_rank").alias("best")))
    for name in list(ASKED)[:3]:  # one append a search
        O.append_trace(lane.filter(F.col("query") == name), at)
    return s.read.schema("query string, hits long, best int").json(at)


def lexical_lane(s, d):
    m, more = parts(s, d)
    return P.lexical_lane(asked(s), m, index=more["index"])


def hybrid_rrf_top10(s, d):
    """Documents by BM25 and by vector, fused."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    q = s.createDataFrame([(k, t, v) for k, (t, v) in FUSED.items()], "query string, text string, vec_id long")
    words = q.select("query", F.posexplode(terms(F.col("text"))).alias("n", "term"))
    field = {"text": F.col("text")}
    scored = L.bm25_by_term(L.positions(docs, "id", field), words, L.lengths(docs, "id", field), {}).withColumn("score", F.round("score", 6))
    lex = L.rank(scored, 150).select("query", F.col("key").alias("id"), F.col("rank").alias("bm25_rank"))
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = V.top_k(q.join(e, "vec_id").select("query", "v"), e.select(F.col("vec_id").alias("key"), "v"), 100).select("query", F.col("key").alias("id"), F.col("rank").alias("vec_rank"))
    both = lex.join(near, ["query", "id"], "full").withColumn("score", P.rrf(F.col("bm25_rank"), F.col("vec_rank")))
    return P.best(both, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


def search_factors(s, d):
    """The factors of every memory for one query that do not depend on the lanes."""
    words = F.array(F.lit("cache"), F.lit("holds"), F.lit("entries"))
    return memories(s, d).select(
        "id",
        F.round(P.coverage_factor(P.coverage(F.col("content"), words)), 6).alias("coverage"),
        F.round(P.activation(AS_OF), 5).alias("activation"),
        F.round(P.importance_factor(), 6).alias("importance"),
        F.round(P.recency(AS_OF), 6).alias("recency"),
    )


#: Questions whose words are subjects or objects of facts and entities.
NAMED = 3


def query_expansion(s, d):
    """What facts and shared memories add to three questions, each of which names two subjects of facts and a topic."""
    t = triples(s, d).filter("subject rlike '^[a-z]{3,}$'").groupBy("subject").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subject").limit(2 * NAMED)
    w = Window.orderBy(F.desc("n"), "subject")  # over six rows
    numbered = t.withColumn("r", F.row_number().over(w) - 1)
    q = numbered.groupBy(F.concat(F.lit("e"), F.floor(F.col("r") / 2)).alias("query")).agg(F.concat(F.array_join(F.sort_array(F.collect_list("subject")), " "), F.lit(" storage")).alias("text"))
    return P.expansion(q, triples(s, d), G.entities(memories(s, d)))


def session_diversity(s, d):
    """Turns of sessions, best of each first, for one question with a day and a number in it."""
    q = s.createDataFrame([("q", "what was the cache window on two mondays")], "query string, text string")
    turns = memories(s, d).filter(F.col("id").rlike("__t[0-9]+$")).select(F.lit("q").alias("query"), "id", "content", (F.col("importance") + F.length("content") / 100000.0).alias("score"))
    return P.session_fused(turns, 10, q).select("place", "id", F.round("score", 6).alias("score"))


#: Questions of the rerank over the whole table, one for each flag and one for none.
RERANKED = {"r1": "which cache do we prefer", "r2": "what changed instead of the lease last week", "r3": "what did the user say", "r4": "the assistant said before", "r5": "cache holds entries"}


def rerank_local(s, d):
    """All memories under every question, by a score that differs; the best twenty of each."""
    q = s.createDataFrame([*RERANKED.items()], "query string, text string")
    m, more = parts(s, d)
    rows = m.join(F.broadcast(q.select("query")), F.lit(True)).select("query", "id", "kind", "content", (0.3 + 0.02 * F.col("importance")).alias("score"))  # a handful of questions
    return P.best(P.reranked(rows, q, more["entities"].filter("kind in ('topic', 'origin')")), 20).select("query", "id", "score", "rank")


def intent_factors(s, d):
    """The factor of every memory for a question of each kind."""
    m = memories(s, d)
    return m.select("id", *(F.round(P.intent_factor(F.lit(t)), 6).alias(k) for k, t in RERANKED.items()))


def golden_quality(s, d):
    """(query, place, leaks): of every question of the golden corpus the place of its answer, 0 if it is not among the first five, and how many credentials it was shown."""
    m = cut(golden.corpus(s))
    q = golden.questions(s).withColumn("v", V.hashed_embedding(F.col("text")))
    none = {"links": s.createDataFrame([], "source_id string, target_id string, relation string"), "triples": triples(s, d).limit(0), "entities": cut(G.entities(m)), "vectors": cut(m.select("id", V.hashed_embedding(F.col("content")).alias("v")))}
    found = [P.search(q.filter(F.col("mode") == mode).drop("project"), m, P.Options(AS_OF, limit=5, mode=mode), **none) for mode in ("default", "full")]
    hits = found[0].unionByName(found[1]).join(m.select("id", "content", "kind"), "id").join(q.select("query", "answers", "mode"), "query")
    right = F.exists("answers", lambda a: F.col("content").contains(a))
    per = hits.groupBy("query").agg(F.min(F.when(right, F.col("place"))).alias("place"), F.count_if((F.col("kind") == "credential") & (F.col("mode") != "full")).alias("leaks"))
    return q.select("query").join(per, "query", "left").select("query", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("leaks", F.lit(0)).alias("leaks"))


def search_accesses(s, d):
    """What a search adds to the access log."""
    m, more = parts(s, d)
    return P.accesses(P.search(asked(s), m, P.Options(AS_OF), **more), m, AS_OF)


def rerank_cross(s, d):
    """With a model that counts common words, in place of a cross-encoder."""

    def model():
        return lambda pairs: [len(set(a.lower().split()) & set(b.lower().split())) for a, b in pairs]

    q = asked(s).select("query", "text")
    rows = lexical_lane(s, d).join(memories(s, d).select("id", "content"), "id").select("query", "id", "content", (1.0 / (40 + F.col("bm25_rank"))).alias("score"))
    return P.best(P.cross_encoded(rows, q, model), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


def file_context(s, d):
    """Search by the words of a file's name, which also boost."""
    m, more = parts(s, d)
    q = s.createDataFrame([("f", "field state frame")], "query string, text string").withColumn("v", V.hashed_embedding(F.col("text")))
    return P.search(q, m, P.Options(AS_OF, limit=5, keywords=("field", "state", "frame")), **more)


QUERIES = {f.__name__: f for f in (store_build, golden_quality, intent_factors, search_accesses, hybrid_search, hybrid_search_filtered, search_trace, trace_log, lexical_lane, hybrid_rrf_top10, search_factors, query_expansion, session_diversity, rerank_local, rerank_cross, file_context)}

holds = lambda ws: "(" + " OR ".join(f"contains(low, {sql_text(w)})" for w in ws) + ")"
sql_text = lambda w: "'" + w.replace("'", "''") + "'"
flags = lambda text, lists: {k for k, ws in lists.items() if any(w in text for w in ws)}


def factor(condition: str, by: object) -> str:
    return f"CASE WHEN {condition} THEN {by} ELSE 1.0 END"


def intent(text: str) -> str:
    """The SQL of a question's intent factor."""
    after, out = flags(text, P.INTENT), ["1.0::DOUBLE"]
    kinds = lambda ks: f"kind IN ({', '.join(map(sql_text, ks))})"
    out += [factor(f"kind = 'preference' OR {holds(P.ANSWER['preference'])}", 1.16)] * ("preference" in after)
    out += [factor("starts_with(ltrim(low, ' '), 'user:')", 1.12)] * ("user_turn" in after) + [factor("starts_with(ltrim(low, ' '), 'assistant:')", 1.12)] * ("assistant_turn" in after)
    out += [factor(f"{kinds(P.UPDATE_KINDS)} OR {holds(P.ANSWER['update'])}", 1.1)] * ("update" in after)
    out += [f"CASE WHEN turn >= 20 THEN 1.08 WHEN turn <= 2 AND {holds(P.ANSWER['opening'])} THEN 1.05 ELSE 1.0 END * " + factor(holds(P.ANSWER["time"]), 1.05)] * ("temporal" in after)
    out += [factor(kinds(P.TECHNICAL_KINDS), 1.07)] * ("technical" in after)
    return " * ".join(out)


def local(text: str) -> str:
    """The SQL of a question's local rerank, over the entities that these questions hold: a topic for some, and the origin of all."""
    after, long = flags(text, P.LOCAL_INTENT), [w for w in text.split() if len(w) >= 4 and w not in P.LOCAL_STOP]
    share = " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in long)
    shared = "notes" + (" + storage" if set(text.split()) & set(G.TOPIC["storage"].split()) else "")
    out = ["1.0::DOUBLE", f"CASE WHEN ({share}) / {len(long)} >= 0.5 THEN 1 + 0.1 * ({share}) / {len(long)} ELSE 1.0 END", factor(f"contains(low, '{text}')", 1.12) if len(text) >= 12 else "1.0", f"(1 + least(0.05 * ({shared}), 0.15))"]
    out += [factor(f"kind = 'preference' OR {holds(P.LOCAL_ANSWER['preference'])}", 1.08)] * ("preference" in after) + [factor(f"contains(id, '__t') OR {holds(P.LOCAL_ANSWER['temporal'])}", 1.06)] * ("temporal" in after)
    out += [factor("starts_with(ltrim(low, ' '), 'user:')", 1.07)] * ("user_turn" in after) + [factor("starts_with(ltrim(low, ' '), 'assistant:')", 1.07)] * ("assistant_turn" in after) + [factor(holds(P.LOCAL_ANSWER["update"]), 1.07)] * ("update" in after)
    return " * ".join(out)


VALUES = ", ".join(f"('{k}', '{t}', {v})" for k, (t, v) in FUSED.items())
FOLD = "translate(lower(coalesce(text, '')), 'àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž', 'aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz')"
A = AGE.format("updated_at")
TERMS_OF = lambda c: rf"list_filter(string_split_regex({FOLD.replace('text', c)}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SQL = {
    "store_build": f"""WITH {M}, {T}, {L_}, {ENT}, {ALL_ENT}, w AS ({' UNION ALL '.join(f"SELECT {TERMS_OF(c)} AS ts FROM (SELECT content, array_to_string(tags, ' ') AS tagged, kind, project FROM m)" for c in ('content', 'tagged', 'kind', 'project'))}), n AS (SELECT count(*) AS n FROM m)
        SELECT unnest(['memories', 'sizes', 'vectors']) AS part, n FROM n UNION ALL SELECT 'places', sum(len(ts)) FROM w UNION ALL SELECT 'words', count(DISTINCT x) FROM (SELECT unnest(ts) AS x FROM w) UNION ALL SELECT 'links', count(*) FROM l UNION ALL SELECT 'triples', count(*) FROM t UNION ALL SELECT 'entities', count(*) FROM every""",
    "hybrid_rrf_top10": rf"""WITH q AS (SELECT * FROM (VALUES {VALUES}) v(query, text, vec_id)), w AS (SELECT doc_id AS id, list_filter(string_split_regex({FOLD}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM documents),
        pos AS (SELECT id, unnest(ts) AS term FROM w), qt AS (SELECT query, unnest(string_split(text, ' ')) AS term, unnest(range(3)) AS n FROM q), per AS (SELECT query, n, id, count(*) AS freq FROM pos JOIN qt USING (term) GROUP BY ALL),
        dfs AS (SELECT query, n, count(*) AS df FROM per GROUP BY 1, 2), lens AS (SELECT id, len(ts) AS len FROM w), st AS (SELECT count(*) AS nrows, avg(len) AS mean FROM lens),
        sc AS (SELECT query, id, round(sum(greatest(ln((nrows - df + 0.5) / (df + 0.5)), 1e-6) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS s FROM per JOIN dfs USING (query, n) JOIN lens USING (id), st GROUP BY 1, 2),
        lex AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS b FROM sc QUALIFY b <= 150),
        vec AS (SELECT query, e.vec_id AS id, row_number() OVER (PARTITION BY query ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) DESC, e.vec_id) AS v FROM q JOIN embeddings x USING (vec_id), embeddings e QUALIFY v <= 100),
        f AS (SELECT query, id, 1.0 / (40 + coalesce(b, 1000)) + 1.0 / (40 + coalesce(v, 1000)) AS s FROM lex FULL JOIN vec USING (query, id))
        SELECT query, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "search_factors": f"""WITH {M}, x AS (SELECT *, (CAST(contains(lower(content), 'cache') AS INT) + CAST(contains(lower(content), 'holds') AS INT) + CAST(contains(lower(content), 'entries') AS INT)) / 3 AS c,
        greatest(coalesce({AGE.format('last_accessed_at')}, {A}, 0), 0) AS used, coalesce({A}, 9999) AS age FROM m)
        SELECT id, round(CASE WHEN c >= 0.8 THEN 1 + 0.5 * (c - 0.8) ELSE 1.0 END, 6) AS coverage, round(1 + least(0.07 * least(ln(coalesce(access_count, 0) + 1.0) / ln(21.0), 1.0) + 0.05 * least(1 / (1 + used / 14), 1.0), 0.12), 5) AS activation,
        round(CAST(1 + 0.03 * (importance - 3) AS DOUBLE), 6) AS importance, round(CASE WHEN age <= 3 THEN 1.05 WHEN age >= 30 THEN 1.0 ELSE 1 + 0.05 * (30 - age) / 27 END, 6) AS recency FROM x""",
    "intent_factors": f"WITH {M}, x AS (SELECT *, lower(content) AS low, try_cast(nullif(regexp_extract(id, '__t(\\d{{1,9}})$', 1), '') AS INT) AS turn FROM m) SELECT id, " + ", ".join(f"round(least({intent(t)}, 1.35), 6)::DOUBLE AS {k}" for k, t in RERANKED.items()) + " FROM x",
    "rerank_local": f"""WITH {M}, {ENT}, o AS (SELECT id, count(*) FILTER (WHERE kind = 'topic' AND value IN ('storage')) AS storage, count(*) FILTER (WHERE kind = 'origin' AND value = 'notes') AS notes FROM (SELECT DISTINCT id, kind, value FROM ent) GROUP BY 1),
        x AS (SELECT m.*, lower(content) AS low, 0.3 + 0.02 * importance AS base, storage, notes FROM m JOIN o USING (id)), y AS ({" UNION ALL ".join(f"SELECT '{k}' AS query, id, round(base * least({local(t)}, 1.35), 4)::DOUBLE AS score FROM x" for k, t in RERANKED.items())})
        SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM y QUALIFY rank <= 20""",
    "session_diversity": f"""WITH {M}, x AS (SELECT id, importance + length(content) / 100000.0::DOUBLE AS score, regexp_extract(id, '(?s)^(.+?)__t', 1) AS session, {' + '.join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in ('cache', 'window', 'mondays', 'mon', '2'))} AS hits FROM m WHERE regexp_matches(id, '__t[0-9]+$')),
        y AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS i, count(*) OVER (PARTITION BY session) AS c, count(*) OVER () AS n, (SELECT count(DISTINCT session) FROM x) AS sessions FROM x),
        z AS (SELECT *, 0.82 * max(score) OVER (PARTITION BY session) + 0.18 * avg(score) FILTER (WHERE i <= 3) OVER (PARTITION BY session) + 0.012 * greatest(least(c, 4) - 1, 0) + 0.008 * max(hits) FILTER (WHERE i <= 3) OVER (PARTITION BY session) AS v, n > 10 AND n >= 8 AND sessions >= 5 AS diverse FROM y)
        SELECT row_number() OVER (ORDER BY CASE WHEN diverse AND i > 1 THEN 1 ELSE 0 END, CASE WHEN diverse AND i = 1 THEN -v ELSE -score END, rank) AS place, id, round(score, 6)::DOUBLE AS score FROM z QUALIFY place <= 10""",
    "query_expansion": f"""WITH {M}, {T}, {ENT}, {ALL_ENT}, s AS (SELECT subject, row_number() OVER (ORDER BY count(*) DESC, subject) - 1 AS r FROM t WHERE regexp_matches(subject, '^[a-z]{{3,}}$') GROUP BY subject QUALIFY r < 6), q AS (SELECT 'e' || (r // 2) AS query, list_sort(list(subject)) || ['storage'] AS ws FROM s GROUP BY 1),
        w AS (SELECT query, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM q), now AS (SELECT DISTINCT subject, object FROM t WHERE valid_to IS NULL), co AS (SELECT word, b.value, count(DISTINCT b.id) AS n FROM (SELECT DISTINCT word FROM w) x JOIN every a ON lower(a.value) = word JOIN every b ON a.id = b.id AND lower(b.value) <> lower(a.value) GROUP BY 1, 2),
        co4 AS (SELECT word, value FROM co QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, value) <= 4),
        e AS (SELECT DISTINCT query, n, word, object AS extra, 0 AS lane FROM w JOIN now ON lower(subject) = word UNION SELECT query, n, word, subject, 1 FROM w JOIN now ON lower(object) = word UNION SELECT query, n, word, value, 2 FROM w JOIN co4 USING (word)),
        f AS (SELECT *, row_number() OVER (PARTITION BY query, word, lane ORDER BY extra) AS r FROM e QUALIFY r <= 3 OR (lane = 2 AND r <= 4)), g AS (SELECT query, extra, min(n * 10 + lane) AS o FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query = f.query AND w.word = f.extra) GROUP BY 1, 2),
        h AS (SELECT query, extra FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY o, extra) <= 12) SELECT query, list_sort(list(extra)) AS extra FROM h GROUP BY 1""",
}

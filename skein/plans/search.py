"""Hybrid search for a table of queries: two ranked lanes, fused, weighed by what is known of a memory, then reranked.

Everything up to the last few rows of a query is one declarative plan; the greedy and the session steps run on
at most `WIDE` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import contains_any, terms
from skein.operators import graph as G
from skein.operators import knowledge as K
from skein.operators import lexical as L
from skein.operators import vectors as V
from skein.operators.folds import never_rising
from skein.operators.relational import age_days, expired, has_tag
from skein.session import cut, stored

#: The published constant of reciprocal rank fusion, as used here, and the rank of what a lane did not find.
RRF_K, MISSING = 40, 1000
FIRST_VARIANT, OTHER_VARIANTS, VECTORS, WIDE = 150, 75, 100, 30

# What in a question (lower case) asks for something, and what in a memory answers it.
INTENT = {
    "preference": ["prefer", "preference", "like", "favorite", "favourite", "would rather", "préfère", "préférence", "aime", "favori", "plutôt"],
    "temporal": ["when", "before", "after", "first", "last", "latest", "recent", "currently", "now", "timeline", "previously", "earlier", "ensuite", "avant", "après", "dernier", "récemment", "maintenant", "actuellement"],
    "user_turn": ["user", "human", "i said", "i told", "j'ai dit", "je voulais", "utilisateur"],
    "assistant_turn": ["assistant", "you said", "claude", "cursor", "chatgpt", "tu as dit"],
    "update": ["changed", "updated", "correction", "actually", "instead", "not anymore", "now uses", "switch", "switched", "remplace", "corrige", "modifié", "désormais", "maintenant", "en fait", "plutôt"],
    "technical": ["bug", "error", "stack", "architecture", "api", "database", "file", "function", "component", "deploy", "build", "benchmark", "embedding", "reranker"],
}
ANSWER = {
    "preference": ["prefer", "préf", "like", "aime", "favorite", "plutôt"],
    "update": ["changed", "updated", "actually", "instead", "correction", "switch", "maintenant", "désormais", "en fait"],
    "opening": ["first", "initial", "started"],
    "time": ["today", "yesterday", "now", "maintenant"],
}
UPDATE_KINDS, TECHNICAL_KINDS = ("decision", "architecture", "fact"), ("architecture", "decision", "bug", "snippet", "pattern")
# Fixed values of the local rerank: the same flags by shorter lists, and their signals.
LOCAL_INTENT = {
    "preference": ["prefer", "preference", "favorite", "favourite", "like", "préf", "aime", "favori"],
    "temporal": ["when", "before", "after", "last", "recent", "ago", "week", "month", "avant", "après", "dernier", "semaine", "mois"],
    "user_turn": ["i said", "i told", "user", "j'ai dit"],
    "assistant_turn": ["you said", "assistant", "claude", "cursor", "chatgpt", "tu as dit"],
    "update": ["changed", "updated", "actually", "instead", "switch", "correction", "modifié", "en fait", "plutôt"],
}
LOCAL_ANSWER = {
    "preference": ["prefer", "favorite", "favourite", "like", "would rather", "i usually", "i often", "i enjoy", "i love", "i tend", "i think", "i recently", "i've been", "my ", "préf", "aime", "favori"],
    "temporal": ["today", "yesterday", "last ", "ago", "week", "month", "maintenant", "hier", "semaine"],
    "update": ["changed", "updated", "actually", "instead", "switched", "correction", "modifié", "désormais", "en fait"],
}
LOCAL_STOP = ["what", "when", "where", "which", "with", "that", "this", "then", "than", "have", "about", "your", "pour", "dans", "avec", "quoi", "quel", "quelle", "est-ce"]
# Questions that get more candidates before sessions are fused, and other words for terms of sessions.
WIDER = ["when", "before", "after", "last", "ago", "week", "month", "prefer", "favorite", "favourite", "like", "suggest", "recommend", "tips", "should", "what did", "who did", "what was"]
SESSION_STOP = ["what", "when", "where", "which", "with", "that", "this", "then", "than", "have", "about", "your", "from", "during", "there", "some"]
ALIASES = {
    "monday": "mon", "tuesday": "tue", "wednesday": "wed", "thursday": "thu", "friday": "fri", "saturday": "sat", "sunday": "sun",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
#: Kinds of entities that tell two texts belong together.
RELIABLE = ("file", "component", "person", "agent", "topic", "platform", "origin")


@dataclass(frozen=True)
class Options:
    """What a search may be told; the defaults are those of the registered queries."""

    as_of: str
    limit: int = 10
    project: str | None = None
    kind: str | None = None
    mode: str = "default"
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()  # of files in work
    #: Score of a neighbour found over links: below any hit of its own, unless set otherwise.
    graph_share: float = 0.5
    min_score: float = 0.0
    #: Score by vector only what the signatures of vectors (a column "s" beside them) bring near; None: all.
    approximate: int | None = None
    weights: dict = field(default_factory=lambda: dict(L.WEIGHTS))


def fields_of(df: DataFrame) -> dict[str, Column]:
    return {"content": F.col("content"), "tags": F.array_join("tags", " "), "kind": F.col("kind"), "project": F.coalesce("project", F.lit(""))}


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, n, term) of (query, text)."""
    return queries.select("query", F.posexplode(terms(F.col("text"))).alias("n", "term"))


def lexical_lane(queries: DataFrame, rows: DataFrame, weights: dict[str, float] = L.WEIGHTS, index: L.Index | None = None) -> DataFrame:
    """(query, id, bm25_rank): the best rank over the variants: all words as prefixes, side by side, near each other, and as stems.

    index: the stored index of the store that rows are of (else it is made of rows); rows are those that may be found.
    """
    asked = cut(query_terms(queries))  # a few rows a query, read by every step
    index = index or L.Index(L.positions(rows, "id", fields_of(rows)), L.lengths(rows, "id", fields_of(rows)))
    mine = rows.select(F.col("id").alias("key"))
    sizes = index.sizes.join(mine, "key", "left_semi")
    stemmed = cut(L.stemmed(asked))
    forms = L.matched_terms(index.vocabulary(), asked, prefix=True).withColumn("lane", F.lit("prefix")).unionByName(L.matched_terms(index.stems(), stemmed, prefix=True).withColumn("lane", F.lit("stem")))
    forms = forms.join(L.small(asked.withColumnRenamed("term", "word")), ["query", "n"]).withColumn("own", F.col("term") == F.col("word")).drop("word")
    # one pass over the tokens that any variant can use; what is left of a memory is one row for each of its terms
    hits = index.places.join(L.small(cut(forms)), "term").join(mine, "key", "left_semi").withColumn("w", L.weight_of(weights))
    own = F.col("own") & (F.col("lane") == "prefix")
    place = F.struct("field", F.col("pos").cast("int").alias("pos"))
    per = hits.groupBy("query", "lane", "n", "key").agg(F.sum("w").alias("freq"), F.sum(F.when(own, F.col("w"))).alias("own_freq"), F.collect_set(F.when(own, place)).alias("at"))
    each = F.array(F.struct("lane", "freq", F.array().cast("array<struct<field:string,pos:int>>").alias("at")), F.when(F.col("own_freq").isNotNull(), F.struct(F.lit("exact").alias("lane"), F.col("own_freq").alias("freq"), "at")))
    per = stored(per.select("query", "n", "key", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("query", "n", "key", "x.*"))
    known = F.broadcast(per.groupBy("query", "lane", "n").agg(F.count(F.lit(1)).alias("df")))  # a row for each term of a query
    stats = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("mean")))
    scored = per.join(known, ["query", "lane", "n"]).join(sizes, "key").crossJoin(stats)
    found = scored.groupBy("query", "lane", "key").agg(F.sum(L.bm25_term()).alias("score"), F.count(F.lit(1)).alias("have"), F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "at"))).alias("places"))
    # the stemmed variant counts where stemming changes the query
    changed = stemmed.join(asked, ["query", "n", "term"], "left_anti").select("query").distinct().withColumn("changed", F.lit(True))
    need = asked.groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("need")).join(changed, "query", "left")
    several, exact = F.col("need").between(2, 8), F.col("lane") == "exact"
    whole = (F.col("have") == F.col("need")) & ~exact & ((F.col("lane") == "prefix") | F.col("changed"))
    side = exact & (F.col("need") >= 2) & L.side_by_side(F.col("places"), F.least("need", F.lit(6)))
    close = exact & several & L.clumped(F.col("places"), F.least("need", F.lit(5)))
    lanes = F.filter(F.array(F.when(whole, F.col("lane")), F.when(side, F.lit("phrase")), F.when(close, F.lit("near"))), lambda x: x.isNotNull())
    ranked = found.join(L.small(need), "query").select("query", "key", "score", F.explode(lanes).alias("lane"))
    rank = F.row_number().over(Window.partitionBy("query", "lane").orderBy(F.desc("score"), "key"))
    kept = ranked.withColumn("rank", rank).filter((F.col("rank") <= OTHER_VARIANTS) | ((F.col("lane") == "prefix") & (F.col("rank") <= FIRST_VARIANT)))
    return kept.groupBy("query", F.col("key").alias("id")).agg(F.min("rank").alias("bm25_rank"))


def vector_lane(queries: DataFrame, vectors: DataFrame, top: int = VECTORS, *, approximate: int | None = None) -> DataFrame:
    """(query, id, vec_rank) of queries with a vector v; rows without a vector score 0 but are candidates.

    approximate: only the so many nearest by signature are scored; queries and vectors then have a column "s".
    """
    corpus = vectors.select(F.col("id").alias("key"), *[c for c in ("v", "s") if c in vectors.columns])
    if approximate is not None:
        near = V.approximate(queries.select("query", "s"), corpus.select("key", "s"), approximate)
        pairs = near.join(corpus, "key").join(queries.select("query", F.col("v").alias("qv")), "query").select("query", "key", V.dot(F.col("v"), F.col("qv")).alias("score"))
        w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        scored = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    else:
        scored = V.top_k(queries.select("query", "v"), corpus.select("key", "v"), top)
    return scored.select("query", F.col("key").alias("id"), F.col("rank").alias("vec_rank"))


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a lane that found nothing counts as rank MISSING."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + 1.0 / (RRF_K + F.coalesce(r, F.lit(MISSING)))
    return out


def coverage(text: Column, words: Column) -> Column:
    """Part of the words of three letters and more that a text holds; null for a query without such words."""
    long = F.filter(words, lambda w: F.length(w) >= 3)
    return F.size(F.filter(long, lambda w: F.lower(text).contains(w))) / F.nullif(F.size(long), F.lit(0))


def coverage_factor(share: Column) -> Column:
    return F.when(share >= 0.8, 1 + 0.5 * (share - 0.8)).otherwise(1.0)


def activation(as_of: str) -> Column:
    """1 to 1.12 by how often and how lately a memory was used."""
    age = F.greatest(F.coalesce(age_days("last_accessed_at", as_of), age_days("updated_at", as_of), F.lit(0)), F.lit(0))
    often = F.least(F.ln(F.coalesce("access_count", F.lit(0)) + 1.0) / F.ln(F.lit(21.0)), F.lit(1.0))
    return 1 + F.least(0.07 * often + 0.05 * F.least(1 / (1 + age / 14), F.lit(1.0)), F.lit(0.12))


def importance_factor() -> Column:
    return 1 + 0.03 * (F.col("importance") - 3)


def recency(as_of: str) -> Column:
    """1.05 up to three days, falling to 1 at thirty."""
    age = F.coalesce(age_days("updated_at", as_of), F.lit(9999))
    return F.when(age <= 3, 1.05).when(age >= 30, 1.0).otherwise(1 + 0.05 * (30 - age) / 27)


def asks(text: Column, flags: dict[str, list[str]]) -> dict[str, Column]:
    """What a question is after, by flag."""
    low = F.lower(text)
    return {k: contains_any(low, ws) for k, ws in flags.items()}


def intent_factor(text: Column) -> Column:
    """Up to 1.35 where the question (its text) is after something that the memory's kind, turn or content shows."""
    after, low, one = asks(text, INTENT), F.lower("content"), F.lit(1.0)
    lead = F.ltrim(low)
    turn = F.try_to_number(F.regexp_extract("id", r"__t(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    when = lambda ask, shown, by: F.when(ask & shown, by).otherwise(1.0)
    one = one * when(after["preference"], (F.col("kind") == "preference") | contains_any(low, ANSWER["preference"]), 1.16)
    one = one * when(after["user_turn"], lead.startswith("user:"), 1.12) * when(after["assistant_turn"], lead.startswith("assistant:"), 1.12)
    one = one * when(after["update"], F.col("kind").isin(*UPDATE_KINDS) | contains_any(low, ANSWER["update"]), 1.1)
    one = one * F.when(after["temporal"] & (turn >= 20), 1.08).when(after["temporal"] & (turn <= 2) & contains_any(low, ANSWER["opening"]), 1.05).otherwise(1.0)
    one = one * when(after["temporal"], contains_any(low, ANSWER["time"]), 1.05) * when(after["technical"], F.col("kind").isin(*TECHNICAL_KINDS), 1.07)
    return F.least(one, F.lit(1.35))


def expansion(queries: DataFrame, triples: DataFrame, entities: DataFrame, most: int = 12) -> DataFrame:
    """(query, extra): what current facts and shared memories name beside a query's words.

    Up to 3 objects and 3 subjects of facts and 4 entities a word, `most` in all, in order of word and value;
    queries of more than 15 words have none.
    """
    asked = query_terms(queries).filter(F.length("term") >= 3)
    few = asked.groupBy("query").agg(F.max("n").alias("n")).filter("n < 15").select("query")
    words = asked.join(few, "query", "left_semi").select("query", "n", F.col("term").alias("word")).distinct()
    now = triples.filter(K.current())
    out = words.join(now.select(F.lower("subject").alias("word"), F.col("object").alias("extra")).distinct(), "word").withColumn("lane", F.lit(0))
    back = words.join(now.select(F.lower("object").alias("word"), F.col("subject").alias("extra")).distinct(), "word").withColumn("lane", F.lit(1))
    beside = words.join(G.cooccurring(entities, words.select("word").distinct()).select("word", F.col("value").alias("extra")), "word").withColumn("lane", F.lit(2))
    every = out.unionByName(back).unionByName(beside)
    w = Window.partitionBy("query", "word", "lane").orderBy("extra")
    some = every.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= 3) | ((F.col("lane") == 2) & (F.col("r") <= 4)))
    fresh = some.join(words.select("query", F.col("word").alias("extra")), ["query", "extra"], "left_anti").groupBy("query", "extra").agg(F.min(F.struct("n", "lane")).alias("o"))
    all_ = Window.partitionBy("query").orderBy("o", "extra")
    return fresh.withColumn("r", F.row_number().over(all_)).filter(F.col("r") <= most).groupBy("query").agg(F.array_sort(F.collect_list("extra")).alias("extra"))


def fused(queries: DataFrame, memories: DataFrame, options: Options, *, vectors: DataFrame, links: DataFrame, triples: DataFrame, entities: DataFrame, index: L.Index | None = None) -> DataFrame:
    """(query, id, score, sources, ...) of all candidates: fused ranks times every factor.

    queries: (query, text, v). Filters of project, kind, visibility and expiry come before the lanes.
    """
    rows = memories.filter(~expired(options.as_of))
    if options.mode != "full":
        rows = rows.filter(F.col("kind") != "credential")
    for column, value in (("project", options.project), ("kind", options.kind)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    vec = vectors.join(rows.select("id"), "id", "left_semi")
    with ThreadPoolExecutor(1) as pool:  # what facts add is found while the lanes run
        named = pool.submit(lambda: cut(expansion(queries, triples, entities)))
        lex, near = lexical_lane(queries, rows, options.weights, index), vector_lane(queries, vec, approximate=options.approximate)
        both = cut(lex.join(near, ["query", "id"], "full"))  # at most a few hundred rows a query
        extra = named.result()
    asked = queries.select("query", F.coalesce("text", F.lit("")).alias("asked"), terms(F.col("text")).alias("words"))
    x = both.join(rows, "id").join(F.broadcast(asked), "query")  # the query table is small
    x = x.join(F.broadcast(extra), "query", "left")
    x = x.join(G.link_boosts(links), "id", "left").join(K.support(triples, options.as_of[:10]).withColumnRenamed("memory_id", "id"), "id", "left")
    low = F.lower("content")
    held = F.size(F.filter(F.coalesce("extra", F.array().cast("array<string>")), lambda e: low.contains(F.lower(e))))
    watched = sum((low.contains(k.lower()).cast("int") for k in options.keywords), F.lit(0))
    factors = {
        "f_coverage": coverage_factor(coverage(F.col("content"), F.col("words"))),
        "f_intent": intent_factor(F.col("asked")),
        "f_activation": activation(options.as_of),
        "f_importance": importance_factor(),
        "f_recency": recency(options.as_of),
        "f_expansion": 1 + F.least(0.04 * held, F.lit(0.15)),
        "f_links": 1 + F.coalesce("boost", F.lit(0.0)),
        "f_watched": 1 + 0.2 * watched,
        "f_tags": F.when(has_tag(*options.tags), 1.5).otherwise(0.1) if options.tags else F.lit(1.0),
        "f_facts": K.penalty(F.coalesce("active", F.lit(0)), F.coalesce("expired", F.lit(0))),
    }
    x = x.withColumns(factors).withColumn("rrf", rrf(F.col("bm25_rank"), F.col("vec_rank")))
    score = F.col("rrf")
    for name in factors:
        score = score * F.col(name)
    lanes = F.filter(F.array(F.when(F.col("bm25_rank").isNotNull(), F.lit("bm25")), F.when(F.col("vec_rank").isNotNull(), F.lit("vector"))), lambda s: s.isNotNull())
    return x.withColumn("score", score).withColumn("sources", lanes).filter(F.col("score") >= options.min_score)


def best(candidates: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def with_neighbours(top: DataFrame, memories: DataFrame, links: DataFrame, options: Options) -> DataFrame:
    """top with the one-step neighbours of its first three rows, below every hit; filters hold for them too."""
    rows = memories.filter(~expired(options.as_of))
    if options.mode != "full":
        rows = rows.filter(F.col("kind") != "credential")
    for column, value in (("project", options.project), ("kind", options.kind)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    near = top.filter("rank <= 3").select("query", F.col("id").alias("node")).join(G.neighbours(links), "node").select("query", F.col("next").alias("id")).distinct()
    low = top.groupBy("query").agg(F.min("score").alias("low"))
    new = near.join(top.select("query", "id"), ["query", "id"], "left_anti").join(low, "query").join(rows.select("id", "content", "kind", "session_id"), "id")
    return top.select("query", "id", "score", "sources", "content", "kind", "session_id").unionByName(
        new.select("query", "id", (F.col("low") * options.graph_share).alias("score"), F.array(F.lit("graph")).alias("sources"), "content", "kind", "session_id")
    )


def greedy(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a query in greedy order: the best first, then always the one with most for its score and its links to those chosen.

    A link to a chosen row adds 5 %, at most 15 %. Scores then never rise. At most WIDE rows and their
    neighbours a query come here.
    """
    near = pairs.groupBy("query").agg(F.collect_set(F.concat_ws("\u0001", "a", "b")).alias("near"))
    joined = rows.join(F.broadcast(near), "query", "left").select("query", "id", "score", "near")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        near = pdf["near"].iloc[0]
        linked: dict[str, set[str]] = {}
        for p in near if near is not None else ():
            a, b = p.split("\u0001")
            linked.setdefault(a, set()).add(b)
            linked.setdefault(b, set()).add(a)
        left = list(zip(pdf["id"], pdf["score"], strict=True))
        chosen: list[tuple[str, float]] = [left.pop(0)] if left else []
        while left:
            value = [s * (1 + min(0.05 * sum(c in linked.get(i, ()) for c, _ in chosen), 0.15)) for i, s in left]
            k = max(range(len(left)), key=lambda n: (value[n], [-ord(ch) for ch in left[n][0]]))
            chosen.append((left.pop(k)[0], value[k]))
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": [i for i, _ in chosen], "score": [float(s) for _, s in chosen], "place": range(len(chosen))})

    ordered = joined.groupBy("query").applyInPandas(run, f"query {rows.schema['query'].dataType.simpleString()}, id string, score double, place int")
    lists = ordered.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("x"))
    tamed = lists.withColumn("s", never_rising(F.transform("x", lambda v: v["score"])))
    return tamed.select("query", F.explode(F.arrays_zip("x", "s")).alias("z")).select("query", "z.x.id", F.col("z.s").alias("score"), "z.x.place")


def local_factor(text: Column, kind: Column, key: Column, content: Column, shared: Column) -> Column:
    """Factor of the local rerank, up to 1.35: longer words of the question held, the question held as it is, entities in common, five signals."""
    asked, low = F.lower(text), F.lower(content)
    after, lead = asks(text, LOCAL_INTENT), F.ltrim(low)
    long = F.filter(F.split(asked, "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*LOCAL_STOP))
    share = F.size(F.filter(long, lambda w: low.contains(w))) / F.nullif(F.size(long), F.lit(0))
    when = lambda condition, by: F.when(condition, by).otherwise(1.0)
    factor = when(share >= 0.5, 1 + 0.1 * share) * when((F.length(asked) >= 12) & low.contains(asked), 1.12) * (1 + F.least(0.05 * F.coalesce(shared, F.lit(0)), F.lit(0.15)))
    factor = factor * when(after["preference"] & ((kind == "preference") | contains_any(low, LOCAL_ANSWER["preference"])), 1.08)
    factor = factor * when(after["temporal"] & (key.contains("__t") | contains_any(low, LOCAL_ANSWER["temporal"])), 1.06)
    factor = factor * when(after["user_turn"] & lead.startswith("user:"), 1.07) * when(after["assistant_turn"] & lead.startswith("assistant:"), 1.07)
    return F.least(factor * when(after["update"] & contains_any(low, LOCAL_ANSWER["update"]), 1.07), F.lit(1.35))


def entities_in_common(rows: DataFrame, queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, id, shared): how many reliable entities a question and a row have in common, whatever their kinds."""
    own = G.entities(queries.select(F.col("query").alias("id"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("content")))
    told = own.filter(F.col("kind").isin(*RELIABLE)).select(F.col("id").alias("query"), F.lower("value").alias("value")).distinct()
    there = entities.filter(F.col("kind").isin(*RELIABLE)).join(rows.select("query", "id"), "id").select("query", "id", F.lower("value").alias("value")).distinct()
    return there.join(told, ["query", "value"]).groupBy("query", "id").agg(F.count(F.lit(1)).alias("shared"))


def reranked(rows: DataFrame, queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Local rerank of (query, id, kind, content, score, ...) by local_factor; four digits."""
    x = rows.join(queries.select("query", F.coalesce("text", F.lit("")).alias("asked")), "query").join(entities_in_common(rows, queries, entities), ["query", "id"], "left")
    return x.withColumn("score", F.round(F.col("score") * local_factor(F.col("asked"), F.col("kind"), F.col("id"), F.col("content"), F.col("shared")), 4)).drop("asked", "shared")


def session_terms(text: Column) -> Column:
    """Longer words of a question, and the other words for days and numbers in it."""
    low = F.lower(text)
    long = F.filter(F.split(low, "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*SESSION_STOP))
    other = F.filter(F.array(*(F.when(low.contains(w), F.lit(x)) for w, x in ALIASES.items())), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(long, other))


def session_fused(rows: DataFrame, limit: int, queries: DataFrame | None = None, *, least_rows: int = 8) -> DataFrame:
    """(query, id, score, place) of the final rows: where at least eight look like turns of sessions, the best of every session first.

    A session's value is 0.82 of its best score, 0.18 of the mean of its best three, a little for every further
    hit and for the terms of the question (queries, with rows' content) that one of its best three holds.
    Leftovers follow by score. Without enough sessions it is the plain best `limit`.
    """
    key = F.regexp_extract("id", r"(?s)^(.+?)__t", 1)
    hits = F.lit(0)
    if queries is not None:
        rows = rows.join(queries.select("query", session_terms(F.coalesce("text", F.lit(""))).alias("terms")), "query")
        low = F.lower("content")
        hits = F.size(F.filter("terms", lambda t: low.contains(t)))
    x = rows.withColumn("session", F.when(key != "", key)).withColumn("hits", hits)
    q = Window.partitionBy("query")
    s = Window.partitionBy("query", F.coalesce("session", F.concat(F.lit("\u0001"), "id")))
    order = [F.desc("score"), F.asc("id")]
    x = x.withColumn("rank", F.row_number().over(q.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(q)).withColumn("turns", F.count("session").over(q))
    x = x.withColumn("sessions", F.size(F.collect_set("session").over(q))).withColumn("in_session", F.row_number().over(s.orderBy(*order)))
    three = F.avg(F.when(F.col("in_session") <= 3, F.col("score"))).over(s)
    count = F.count(F.lit(1)).over(s)
    value = 0.82 * F.max("score").over(s) + 0.18 * three + 0.012 * F.greatest(F.least(count, F.lit(4)) - 1, F.lit(0)) + 0.008 * F.max(F.when(F.col("in_session") <= 3, F.col("hits"))).over(s)
    diverse = (F.col("n") > limit) & (F.col("turns") >= least_rows) & (F.col("sessions") >= F.least(F.lit(limit), F.lit(5)))
    x = x.withColumn("value", value).withColumn("group", F.when(diverse & ((F.col("in_session") > 1) | F.col("session").isNull()), 1).otherwise(0))
    final = Window.partitionBy("query").orderBy("group", F.when(diverse & (F.col("group") == 0), -F.col("value")).otherwise(-F.col("score")), "rank")
    return x.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= limit).select("query", "id", "score", "place")


def search(queries: DataFrame, memories: DataFrame, options: Options, *, vectors: DataFrame, links: DataFrame, triples: DataFrame, entities: DataFrame, index: L.Index | None = None) -> DataFrame:
    """(query, place, id, score, sources): the whole search, for all queries at once."""
    wide = max(options.limit, min(3 * options.limit, WIDE))
    top = best(fused(queries, memories, options, vectors=vectors, links=links, triples=triples, entities=entities, index=index), wide)
    # more candidates only for questions after time or liking
    top = top.filter((F.col("rank") <= options.limit) | contains_any(F.lower("asked"), WIDER))
    # the few rows of each query that are left are read several times: lineage ends here
    top = cut(top.select("query", "id", F.round("score", 4).alias("score"), "sources", "content", "kind", "session_id", "rank"))
    rows = cut(with_neighbours(top, memories, links, options))
    topics = entities.filter(F.col("kind").isin("topic", "file", "component"))
    pairs = G.adjacency(links, topics, rows.select("query", "id").distinct())
    ordered = greedy(rows, pairs)
    full = ordered.join(rows.drop("score"), ["query", "id"])
    final = session_fused(reranked(full, queries, entities), options.limit, queries)
    return final.join(rows.select("query", "id", "sources"), ["query", "id"]).select("query", "place", "id", "score", "sources")


def accesses(results: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """(memory_id, project, client, accessed_at, received_at): the accesses that a search's results are, one a memory, to append to the access log."""
    at = F.lit(as_of).cast("timestamp_ntz")
    found = results.select("id").distinct().join(memories.select("id", "project"), "id")
    return found.select(F.col("id").alias("memory_id"), "project", F.lit("search").alias("client"), at.alias("accessed_at"), at.alias("received_at"))


# --- interfaces for a cross-encoder -------------------------------------------------------------------------


def hard_query(text: Column) -> Column:
    """Whether a query deserves the slower model: it asks after time, preference or change, or is not English."""
    after = asks(text, INTENT)
    foreign = text.rlike("[àâçéèêëîïôùûœäöüß]|[\\u3040-\\u30ff\\u4e00-\\u9fff]|\\b(?:le|la|les|quand|quel|der|die|das|wann)\\b")
    return after["temporal"] | after["preference"] | after["update"] | foreign


def cross_encoded(rows: DataFrame, queries: DataFrame, model, *, top: int = 12, gate: float = 0.25, weight: float = 0.55, most: int = 1400) -> DataFrame:
    """Rows with the scores of the best `top` of hard queries mixed with a model's; the tail keeps its own.

    model: a picklable factory of a function from (query, text) pairs to scores, made once a worker. A query
    whose first row leads the third by the gate is left as it is. Texts are given to the model up to its window
    (`most` characters); nothing else is cut.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    x = rows.withColumn("rank", F.row_number().over(w)).join(F.broadcast(queries.select("query", "text", hard_query(F.col("text")).alias("hard"))), "query")
    q = Window.partitionBy("query")
    lead = (F.max(F.when(F.col("rank") == 1, F.col("score"))).over(q) - F.max(F.when(F.col("rank") == 3, F.col("score"))).over(q)) / F.max("score").over(q)
    x = x.withColumn("take", F.col("hard") & (F.col("rank") <= top) & (F.coalesce(lead, F.lit(0.0)) < gate))

    @F.pandas_udf("double")
    def scored(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = model()
        for a, b in it:
            yield pd.Series(run(list(zip(a, b.str.slice(0, most), strict=True))), dtype=float)

    y = x.filter("take").withColumn("m", scored("text", "content"))
    scale = lambda c: (F.col(c) - F.min(c).over(q)) / F.nullif(F.max(c).over(q) - F.min(c).over(q), F.lit(0.0))
    mixed = weight * F.coalesce(scale("m"), F.lit(0.5)) + (1 - weight) * F.coalesce(scale("score"), F.lit(0.5))
    low, high = F.min("score").over(q), F.max("score").over(q)
    head = y.withColumn("score", low + (high - low) * mixed).drop("m")
    return head.unionByName(x.filter("not take")).select(*rows.columns)


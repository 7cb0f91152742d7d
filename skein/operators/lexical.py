"""Inverted index as a DataFrame, and what is asked of it: prefixes, phrases, nearness, BM25."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.stem import stems
from skein.functions.text import terms
from skein.session import stored

#: Weight of a hit by field; a field that is not named weighs 1.
WEIGHTS = {"content": 8.0, "tags": 5.0, "kind": 2.0, "project": 4.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Most terms of a query table that is broadcast.
MOST_ASKED = 100_000
# Words that tell a French query.
FRENCH_WORDS = "le la les des une est dans pour avec sur qui que quand quel quelle nous vous ou pas du et au aux ce cette".split()


def small(asked: DataFrame) -> DataFrame:
    """A query table, broadcast if it is small: beyond MOST_ASKED terms the join shuffles."""
    return F.broadcast(asked) if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else asked


def positions(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, term, pos) of every token, positions from 0 in each field."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), terms(c).alias("ts")) for n, c in fields.items())))
    return df.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", F.posexplode("f.ts").alias("pos", "term"))


def postings(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, term, tf). Counted before the shuffle too, so common terms of a document travel once."""
    return positions(df, key, fields).groupBy("key", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, len): tokens over all fields, straight from the rows."""
    total = sum((F.size(terms(c)) for c in fields.values()), F.lit(0))
    return df.select(F.col(key).alias("key"), total.alias("len"))


class Index(NamedTuple):
    """A store's tokens (key, field, term, pos) and sizes (key, len), as a deployment keeps them."""

    places: DataFrame
    sizes: DataFrame
    words: DataFrame | None = None

    def vocabulary(self) -> DataFrame:
        """(term) of all texts, once each."""
        return self.words.select("term") if self.words is not None else self.places.select("term").distinct()

    def stems(self) -> DataFrame:
        """(term, form): each word with its stems of either language, so that texts need no stemmed copy."""
        if self.words is not None:
            return self.words.select("term", F.explode("forms").alias("form"))
        return stem_forms(self.vocabulary()).select("term", F.explode("forms").alias("form"))


def stem_forms(vocabulary: DataFrame) -> DataFrame:
    """(term, forms): a word and its English and French stems."""
    return vocabulary.select("term", F.array_distinct(F.concat(F.array("term"), stems(F.array("term"), F.lit("both")))).alias("forms"))


def stemmed(asked: DataFrame) -> DataFrame:
    """(query, n, term): the words of a query as stems: French where its text looks French, else English; words of two letters stay."""
    french = asked.groupBy("query").agg(F.when(F.max(F.col("term").isin(*FRENCH_WORDS).cast("int")) == 1, "fr").otherwise("en").alias("lang"))
    return asked.join(F.broadcast(french), "query").select("query", "n", F.coalesce(F.get(stems(F.array("term"), F.col("lang")), F.lit(0)), "term").alias("term"))


def matched_terms(index: DataFrame, asked: DataFrame, *, prefix: bool) -> DataFrame:
    """(query, n, term): the terms of the index that the query's n-th term stands for: itself, or with prefix=True all it begins.

    Prefixes are looked up in the vocabulary only, by equality on the prefixes of the query terms' lengths; an
    index with a column "form" is matched by that instead of by its terms. The query table is checked: it has to
    be smaller than MOST_ASKED terms to be broadcast.
    """
    if not prefix:
        return small(asked)
    form = "form" if "form" in index.columns else "term"
    sized = asked.withColumn("size", F.length("term"))
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]  # lengths of words, a few
    heads = F.filter(F.array(*(F.struct(F.lit(x).alias("size"), F.substring(form, 1, x).alias("head")) for x in sizes or [1])), lambda h: F.length(form) >= h["size"])
    vocabulary = index.select("term", *[form] * (form != "term")).distinct().select("term", F.explode(heads).alias("h")).select("term", "h.size", "h.head")
    return vocabulary.join(small(sized.withColumnRenamed("term", "head")), ["head", "size"]).select("query", "n", "term").distinct()


def counted(tokens: DataFrame) -> DataFrame:
    """(query, n, key, field, tf) of matched tokens or postings."""
    total = F.sum("tf") if "tf" in tokens.columns else F.count(F.lit(1))
    return tokens.groupBy("query", "n", "key", "field").agg(total.alias("tf"))


def match_terms(index: DataFrame, asked: DataFrame, *, prefix: bool) -> DataFrame:
    """(query, n, key, field, tf): hits of the query's n-th term.

    index: postings, or positions, which are met by the few terms before anything is counted or shuffled.
    asked: (query, n, term), a query table of checked size.
    """
    return counted(index.join(matched_terms(index, asked, prefix=prefix), "term"))


def all_terms(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """The hits of rows that match every term of their query."""
    need = asked.groupBy("query").agg(F.count_distinct("n").alias("need"))
    full = hits.groupBy("query", "key").agg(F.count_distinct("n").alias("have")).join(need, "query").filter("have = need")
    return hits.join(full.select("query", "key"), ["query", "key"])


def weight_of(weights: dict[str, float]) -> Column:
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    return weight


def side_by_side(places: Column, need: Column) -> Column:
    """Whether the terms 0 to need - 1 stand side by side in a field; places: array of (n, at: array of (field, pos)) of one row."""
    starts = F.transform(F.filter(places, lambda x: x["n"] < need), lambda x: F.transform(x["at"], lambda a: F.struct(a["field"], (a["pos"] - x["n"]).alias("pos"))))
    common = F.aggregate(starts, F.get(starts, F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return (F.size(starts) == need) & (F.size(F.coalesce(common, F.array().cast("array<struct<field:string,pos:int>>"))) > 0)


def clumped(places: Column, need: Column, distance: int = 8) -> Column:
    """Whether the terms 0 to need - 1 stand in a field with at most `distance` tokens between the first and the last; as for side_by_side."""
    mine = F.filter(places, lambda x: x["n"] < need)
    every = F.array_sort(F.flatten(F.transform(mine, lambda x: F.transform(x["at"], lambda a: F.struct(a["field"], a["pos"], x["n"].cast("int").alias("n"))))))
    start = F.struct(F.lit("").alias("field"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("last"), F.lit(False).alias("ok"))

    def step(acc, x):
        known = F.map_filter(acc["last"], lambda k, v: (k != x["n"]) & (acc["field"] == x["field"]))
        last = F.map_concat(known, F.create_map(x["n"], x["pos"]))
        return F.struct(x["field"].alias("field"), last.alias("last"), (acc["ok"] | ((F.size(last) == need) & (x["pos"] - F.array_min(F.map_values(last)) - 1 <= distance))).alias("ok"))

    return (F.size(mine) == need) & F.aggregate(every, start, step, lambda a: a["ok"])


def bm25(hits: DataFrame, sizes: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query, key, score), larger is better: one phrase a query term, hits weighted by field.

    Document frequency counts the rows with a hit of the phrase, whatever the field; lengths are over all
    fields; the idf is not below LEAST_IDF.
    """
    stats = sizes.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("mean"))
    weight = weight_of(weights)
    per = hits.groupBy("query", "n", "key").agg(F.sum(weight * F.col("tf")).alias("freq"))
    df_of = per.groupBy("query", "n").agg(F.count(F.lit(1)).alias("df"))
    x = per.join(df_of, ["query", "n"]).join(sizes, "key").crossJoin(F.broadcast(stats))  # one row
    return x.groupBy("query", "key").agg(F.sum(bm25_term()).alias("score"))


def bm25_by_term(places: DataFrame, asked: DataFrame, sizes: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """What bm25() gives for whole terms, for many queries: a term is scored once for each row, whoever asks for it, and then summed by query.

    places: (key, field, term, pos); asked: (query, n, term).
    """
    terms_asked = small(asked.select("term").distinct())
    per = places.join(terms_asked, "term").groupBy("term", "key").agg(F.sum(weight_of(weights)).alias("freq"))
    per = stored(per)
    known = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = sizes.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("mean"))
    one = per.join(small(known), "term").join(sizes, "key").crossJoin(F.broadcast(stats)).select("term", "key", bm25_term().alias("s"))  # one row
    times = asked.groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    return one.join(small(times), "term").groupBy("query", "key").agg(F.sum(F.col("s") * F.col("times")).alias("score"))


def bm25_term() -> Column:
    """What one term gives, from the columns freq, df, len, rows and mean."""
    idf = F.greatest(F.ln((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    return idf * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("len") / F.col("mean")))


def phrase(places: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, key, field, n): how often the terms of a query stand side by side in a field.

    Every token takes its position less its place in the phrase; a phrase is where that is the same for all
    terms, a plain grouped count instead of a self-join.
    """
    need = asked.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    hit = places.join(small(asked), "term").select("query", "key", "field", (F.col("pos") - F.col("n")).alias("at"), "n").distinct()
    full = hit.groupBy("query", "key", "field", "at").agg(F.count(F.lit(1)).alias("have")).join(need, "query").filter("have = need")
    return full.groupBy("query", "key", "field").agg(F.count(F.lit(1)).alias("n"))


def near(places: DataFrame, asked: DataFrame, distance: int = 8) -> DataFrame:
    """(query, key, field): fields in which all terms stand in a clump with at most `distance` tokens between the first and the last.

    For every occurrence, the latest position of each other term up to there is known by a running maximum, so
    one sorted pass over the hits of a row decides.
    """
    need = asked.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    hit = places.join(small(asked), "term").select("query", "key", "field", "pos", "n")
    lists = hit.groupBy("query", "key", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("h"), F.count_distinct("n").alias("have"))
    ready = lists.join(need, "query").filter("have = need")
    # fold over the occurrences: last position by term, and whether a clump was found
    start = F.struct(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("last"), F.lit(False).alias("ok"))

    def step(acc, x):
        last = F.map_concat(F.map_filter(acc["last"], lambda k, v: k != x["n"]), F.create_map(x["n"].cast("int"), x["pos"].cast("int")))
        span = x["pos"] - F.array_min(F.map_values(last)) - 1
        return F.struct(last.alias("last"), (acc["ok"] | ((F.size(last) == F.col("need")) & (span <= distance))).alias("ok"))

    return ready.filter(F.aggregate("h", start, step, lambda a: a["ok"])).select("query", "key", "field")


def rank(scores: DataFrame, limit: int) -> DataFrame:
    """Best first within a query, ties by key; rank from 1."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)

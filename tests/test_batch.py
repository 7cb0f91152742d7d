"""Many queries at once against one at a time, and the retrieval metrics without the whole store."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import batch
from skein.operators import lexical as L
from skein.queries import search

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sample", [16, 2])
def test_best_rows_are_those_of_full_scores(spark, monkeypatch, sample):
    monkeypatch.setattr(batch, "SAMPLE", sample)
    monkeypatch.setattr(batch, "AT_ONCE", 25)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: rnd.choices(words, [1 / (i + 1) for i in range(60)], k=n)
    texts = [text(rnd.randint(0, 20)) for _ in range(300)]
    rows = [(f"k{i:03d}", t) for i, t in enumerate([*texts, *texts[:100]])] + [(None, ["w0", "w59"])]
    asks = [(f"q{i}", [*text(8), *["absent"] * (i % 3)]) for i in range(60)] + [("same", ["w1", "w1", "w5"]), ("again", ["w1", "w1", "w5"]), ("none", ["absent"]), ("empty", [])]
    df, asked = spark.createDataFrame(rows, "key string, ts array<string>"), spark.createDataFrame(asks, "query string, ts array<string>")
    places = df.select("key", F.lit("content").alias("field"), F.posexplode("ts").alias("pos", "term"))
    full = L.bm25_by_term(places, asked.select("query", F.posexplode("ts").alias("n", "term")), df.select("key", F.size("ts").alias("len")), {})
    want = {tuple(r) for r in L.rank(full.withColumn("score", F.round("score", 6)), 10).select("query", "key", "rank").collect()}
    got = [tuple(r) for r in batch.best_by_term(df, asked, 10).collect()]
    assert len(got) == len(want) > 300 and set(got) == want


def test_steps_are_those_of_round(spark):
    x = [0.1234565, 2.0000005, 1.0000015, 0.0000005, 3.1415925, 12.3456785, 0.3, 7.0]
    want = [round(r["v"] * 1e6) for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("v")).collect()]
    assert batch.rounded(batch.np.array(x)).tolist() == want


@pytest.mark.parametrize("name", ["ir_metrics", "ir_metrics_by_kind", "recall_quality", "session_match"])
def test_metrics_do_not_build_the_store(spark, monkeypatch, name):
    def parts(s, d):
        raise AssertionError("the store is built")

    monkeypatch.setattr(search, "parts", parts)
    monkeypatch.setattr("skein.queries.metrics.parts", parts, raising=False)
    assert entry.queries()[name](spark, DATA).count() > 0


def test_terms_that_find_no_rows_are_not_searched_for(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"k{i:03d}", [*rnd.choices(words, [1 / (i + 1) for i in range(40)], k=12), f"own{i % 20}"]) for i in range(400)]
    asked = batch._Asked([[*t[-6:], "w0"] for _, t in rows])
    lists = batch.pa.RecordBatch.from_pylist([{"key": k, "ts": t} for k, t in rows])
    df = batch.np.array([sum(w in t for _, t in rows) for w in asked.number], float)
    idf = batch.np.log((400 - df + 0.5) / (df + 0.5)).clip(1e-6)
    best = lambda bounds: sorted(tuple(r.values()) for b in batch._best(asked, idf, 13.0, bounds, 10)(iter([lists])) for r in b.to_pylist())
    every = best(batch.np.zeros(400, batch.np.int64))
    bounds = batch.np.array([min(s for q, _, s in every if q == n) for n in range(400)])
    calls, search = [], batch.np.searchsorted
    monkeypatch.setattr(batch.np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    for ready in (6_000_000, 4_000, 0):
        monkeypatch.setattr(batch, "READY", ready, raising=False)
        calls.clear()
        assert best(bounds) == every and len(every) == 4_000
        assert len(calls) == 1  # where the rows of each term begin, once a chunk; not once for each query and term

from pyspark.sql import functions as F

from skein.operators import metrics as E
from skein.operators import vectors as V
from skein.plans import search as P
from skein.streaming import streams as S


def test_quantised_error_is_at_most_half_a_step(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.013],), ([0.0, 0.0],), (None,)], "v array<double>")
    for r in rows.select("v", V.quantised(F.col("v")).alias("q")).collect():
        if r["v"] is None:
            assert r["q"] is None
        else:
            assert all(abs(a - b * r["q"]["scale"]) <= r["q"]["scale"] / 2 + 1e-12 for a, b in zip(r["v"], r["q"]["q"], strict=True))


def test_top_k_in_blocks_is_the_same(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("key"), F.array(*((F.sin(F.col("id") * k)).alias("x") for k in (1, 2, 3))).alias("v"))
    q = rows.filter("key < 20").toDF("query", "v")
    once = sorted(map(tuple, V.top_k(q, rows, 3).select("query", "key", "rank").collect()))
    monkeypatch.setattr(V, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, V.top_k(q, rows, 3).select("query", "key", "rank").collect())) == once


def test_mismatched_vectors_score_zero(spark):
    r = spark.createDataFrame([([1.0], [1.0, 2.0]), ([2.0], [3.0]), ([1.0], None)], "a array<double>, b array<double>").select(F.coalesce(V.dot(F.col("a"), F.col("b")), F.lit(0.0)).alias("d")).collect()
    assert [x["d"] for x in r] == [0.0, 6.0, 0.0]


def test_rrf_rises_with_rank(spark):
    r = spark.createDataFrame([(1, 1), (1, None), (2, 1), (None, None)], "a int, b int").select(P.rrf(F.col("a"), F.col("b")).alias("s")).collect()
    s = [x["s"] for x in r]
    assert s[0] > s[2] > s[1] > s[3]


def test_greedy_prefers_linked_rows(spark):
    rows = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("q", "c", 0.49)], "query string, id string, score double")
    pairs = spark.createDataFrame([("q", "a", "c")], "query string, a string, b string")
    got = sorted(P.greedy(rows, pairs).collect(), key=lambda r: r["place"])
    assert [r["id"] for r in got] == ["a", "c", "b"] and got[1]["score"] <= got[0]["score"]


def test_sessions_first_only_with_eight_turns(spark):
    rows = [("q", f"s{i % 5}__t{i}", 1.0 - i / 100) for i in range(10)]
    got = P.session_fused(spark.createDataFrame(rows, "query string, id string, score double"), 5)
    assert len({r["id"].split("__")[0] for r in got.collect()}) == 5
    plain = P.session_fused(spark.createDataFrame([("q", f"x{i}", float(i)) for i in range(10)], "query string, id string, score double"), 3)
    assert [r["id"] for r in sorted(plain.collect(), key=lambda r: r["place"])] == ["x9", "x8", "x7"]


def test_metrics_by_hand_and_sessions_by_equality(spark):
    res = spark.createDataFrame([("1", "a", 1), ("2", "b", 4), ("3", "z", 1)], "query string, id string, rank int")
    gold = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "query string, id string")
    m = E.ranking_metrics(res, gold).first()
    assert (m["n_queries"], m["r_at_1"], m["r_at_5"]) == (3, round(1 / 3, 6), round(2 / 3, 6)) and abs(m["mrr"] - 1.25 / 3) < 1e-6
    turns = E.by_session(spark.createDataFrame([("1", "s10__t1", 1), ("1", "s1__t2", 2)], "query string, id string, rank int"))
    assert {(r["id"], r["rank"]) for r in turns.collect()} == {("s10", 1), ("s1", 2)}


def test_latency_counts_values(spark):
    rows = spark.createDataFrame([("k", v) for v in [1, 2, 3, 4, 100]] + [("k", None)], "k string, v int")
    r = E.latency(rows, "k", "v").first()
    assert (r["n"], r["p50"], r["p95"], r["p99"], r["mean"]) == (5, 3, 100, 100, 22.0)


def access(spark, path, rows):
    spark.createDataFrame(rows, "memory_id string, at string, client string").select("memory_id", F.to_timestamp_ntz("at").alias("accessed_at"), "client").write.mode("append").parquet(path)


def test_access_fold_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "a")
    access(spark, path, [("a", "2024-01-01 00:00:00", "c"), ("a", "2024-01-01 00:00:01", "c"), ("a", "2024-01-01 00:00:02", "c"), (None, "2024-01-01 00:00:02", "c")])
    access(spark, path, [("a", "2024-01-01 00:00:01", "d"), ("b", "2024-01-01 05:00:00", "c")])
    batch = {tuple(r) for r in S.access_counts(S.access_fold(spark.read.parquet(path))).select("memory_id", "added").collect()}
    stream = S.drain(S.access_fold(S.replay(spark, path), late="1 day"), str(tmp_path / "s"))
    assert batch == {("a", 2), ("b", 1)} == {tuple(r) for r in S.access_counts(stream).select("memory_id", "added").collect()}


def test_ring_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "a")
    access(spark, path, [(f"m{i}", f"2024-01-01 00:00:{i:02d}", "c") for i in range(30)] + [("m0", "2024-01-02 00:00:00", "c")])
    out = S.drain(S.recent_ring(S.replay(spark, path), "client", "memory_id", "accessed_at", size=3), str(tmp_path / "s"), mode="update").collect()
    assert max(out, key=lambda r: r["batch"])["items"] == ["m0", "m29", "m28"]

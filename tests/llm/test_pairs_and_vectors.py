import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import neardup as N
from skein.llm import vectors as V


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            t = list(rnd.choice(out).split())
            for _ in range(rnd.randint(0, max(1, len(t) // 6))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rnd.shuffle(t)
        else:
            t = rnd.sample(words, rnd.choice([1, 2, 3, 8, 9, 30, 33, 120, 140]))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("shard", [20_000, 5])
def test_pairs_equal_brute_force(spark, shard):
    texts = corpus(1) + ["", None, "  ...", "w1 w2 w3", "W1, w2; W3!"]
    rows = [(f"id{i:03d}", t, None if i % 3 == 0 else f"g{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "id string, content string, project string").withColumn("cls", F.lit(1))
    got = sorted(map(tuple, N.similar_pairs(df, "id", "content", F.col("project"), shard=shard).collect()))
    sets = [(i, g, frozenset(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t, g in rows]
    want = sorted((a, b) for x, (a, g, u) in enumerate(sets) for b, h, v in sets[x + 1 :] if g == h and u and v and 5 * len(u & v) >= 4 * len(u | v))
    assert got == want and len(want) > 20


def test_many_copies_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame([(f"c{i:02d}", "same words here now") for i in range(40)] + [("x", "same words here now too")], "id string, content string")
    pairs = [tuple(r) for r in N.similar_pairs(df, "id", "content").collect()]
    assert len(pairs) == len(set(pairs)) == 40 * 39 // 2 + 40
    groups = N.similar_groups(df, "id", "content").collect()
    assert len({r["group_id"] for r in groups}) == 1 and {r["n_links"] for r in groups} == {1} and len({r["class_id"] for r in groups}) == 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert N.similar_pairs(df, "id", "content").count() == 0 and N.similar_groups(df, "id", "content").count() == 0


def test_fingerprints_never_differ_more_than_the_sets():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**62), 2**62, 50)
    b = np.concatenate([a[:-5], rng.integers(-(2**62), 2**62, 4)])
    for parts in (1, 2, 8):
        sa, wa = N.fingerprints(a, np.zeros(len(a), int), 1, np.array([parts]))
        sb, wb = N.fingerprints(b, np.zeros(len(b), int), 1, np.array([parts]))
        d = N.distance(sa, sb)
        assert d.sum() <= 9 and d.min() <= 9 // parts and N.distance(wa, wb)[0] <= 9


def test_chi_square():
    assert abs(V.chi_square_quantile(0.95, 10) - 18.307) < 1e-3 and abs(V.chi_square_cdf(2.0, 2) - (1 - np.exp(-1))) < 1e-12


def vectors(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return [(f"h{i:03d}", (centres[i % 20] + 0.25 * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("cell,least", [(10_000, None), (60, None), (60, 0.8)])
def test_recall_against_brute_force(spark, cell, least):
    rows = vectors()
    bad = [("n", None), ("z", [0.0] * 16), ("s", [1.0, 2.0]), (None, rows[0][1]), rows[3], ("nan", [float("nan")] * 16)]
    df = spark.createDataFrame(rows + bad, "h string, v array<double>").withColumn("key", F.lit(1))
    got = V.nearest(df, "h", "v", dim=16, dimensions=8, cell=cell, least=least).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(rows[i][0], rows[j][0]) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:10] if least is None or s[i, j] >= least}
    found = {(r["h"], r["other"]) for r in got}
    assert len(found & want) / len(want) >= 0.97 and max(r["rank"] for r in got) <= 10 and len(found) == len(got)


def test_copies_take_the_smallest_keys(spark):
    df = spark.createDataFrame([(f"c{i:02d}", [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [("x", [4.0, -1.0, 0.0, 1.0])], "h string, v array<double>")
    got = V.nearest(df, "h", "v", k=3, dim=4, dimensions=4).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["h"], []).append(r["other"])
    assert by["c00"] == ["c01", "c02", "c03"] and by["c01"] == ["c00", "c02", "c03"] and by["c20"] == ["c00", "c01", "c02"] and by["x"] == ["c00", "c01", "c02"]


def test_empty_vectors(spark):
    assert V.nearest(spark.createDataFrame([], "h string, v array<float>"), "h", "v").count() == 0


def test_one_group_of_two_hundred_thousand(spark):
    """A hot group is routed to shards; planted pairs are all that is found."""
    rng = np.random.default_rng(1)
    n = 200_000
    words = (30_000 * rng.random((n, 60)) ** 3).astype(int)
    planted = np.arange(0, n, 100)
    words[planted + 1] = words[planted]
    words[planted + 1, :2] = 40_000 + rng.integers(0, 10**6, (len(planted), 2))
    df = spark.createDataFrame([(f"k{i:06d}", " ".join(f"w{x}" for x in row)) for i, row in enumerate(words.tolist())], "id string, content string")
    top = N.top_levels(N.keyed(df, "id", "content"))
    assert max(top.depth.values()) >= 3
    sets = [set(words[i].tolist()) for i in range(n)]
    want = {(f"k{i:06d}", f"k{i + 1:06d}") for i in planted if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {tuple(r) for r in N.similar_pairs(df, "id", "content").collect()}
    assert len(want) > 1_500 and got == want

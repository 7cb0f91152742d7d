"""Candidates of alike sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import lifecycle, prefixes
from skein.tables import memories, once_per_id, one_per_id
from skein.operators.prefixes import candidates


def test_candidates_hold_all_alike_pairs(spark):
    rnd = random.Random(11)
    words = [rnd.getrandbits(64) - 2**63 for _ in range(300)]
    base = [rnd.sample(words, rnd.randint(1, 60)) for _ in range(40)]
    sets = [set(w for w in rnd.choice(base) if rnd.random() > 0.1) | set(rnd.sample(words, rnd.randint(0, 4))) for _ in range(300)]
    sets = [x or {words[0]} for x in sets]
    df = spark.createDataFrame([(i, list(x)) for i, x in enumerate(sets)], "id long, h array<long>")
    got = [tuple(r) for r in candidates(df, 300, 0.7).collect()]
    alike = {(i, j) for j in range(300) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert len(alike) > 100 and alike <= set(got) and len(got) == len(set(got)) < 4_000


def sized(rnd, sizes, share):
    """Sets of those sizes from few words, and versions of some of them."""
    words = [rnd.getrandbits(64) - 2**63 for _ in range(3 * max(sizes))]
    base = [set(rnd.sample(words, n)) for n in sizes]
    return base + [set(rnd.sample(sorted(x), int(len(x) * rnd.uniform(0.6, 1)) or 1)) | set(rnd.sample(words, len(x) // 20)) for x in base if rnd.random() < share]


def all_alike(sets, threshold):
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-12}


def test_long_rows_that_are_not_alike_are_no_candidates(spark):
    """256 bits of parity let all pairs of rows of several hundred words through, and the words of each pair were moved."""
    sets = sized(random.Random(7), [700] * 80, 0.2)
    df = spark.createDataFrame([(i, list(x)) for i, x in enumerate(sets)], "id long, h array<long>")
    got = {tuple(r) for r in candidates(df, len(sets), 0.7).collect()}
    alike = all_alike(sets, 0.7)
    assert alike and alike <= got and len(got) < 2 * len(sets)


@pytest.mark.parametrize(("hot", "threshold"), [(300, 0.7), (1_500, 0.85), (8_000_000, 0.7), (8_000_000, 0.4)])
def test_candidates_of_all_sizes_and_split_groups(spark, monkeypatch, hot, threshold):
    monkeypatch.setattr(prefixes, "HOT", hot)
    monkeypatch.setattr(prefixes, "BLOCK", 500)
    monkeypatch.setattr(prefixes, "LOOKED_UP", 1_000)
    monkeypatch.setattr(prefixes, "PIECE", 1_000)
    rnd = random.Random(hot)
    sets = sized(rnd, [*range(1, 80), *(rnd.choice([31, 32, 33, 63, 64, 91, 128, 300]) for _ in range(80))], 0.9)
    df = spark.createDataFrame([(i, i % 2, list(x)) for i, x in enumerate(sets)], "id long, bucket long, h array<long>").repartition(3)
    got = [tuple(r) for r in candidates(df, len(sets), threshold).collect()]
    alike = {(i, j) for i, j in all_alike(sets, threshold) if i % 2 == j % 2}
    assert len(alike) > 10 and alike <= set(got) and len(got) == len(set(got))
    left = {tuple(r) for r in candidates(df, len(sets), threshold, df.filter("id < 20").select("id")).collect()}
    assert left >= {(i, j) for i, j in alike if i >= 20} and all(i >= 20 for i, _ in left)


def test_once_per_id_keeps_one_row_an_id(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), ("c", 4), ("c", 5)], "id string, x int")
    for _ in range(2):
        got = once_per_id(df).collect()
        assert sorted(str(r["id"]) for r in got) == ["None", "a", "b", "c"] and {(r["id"], r["x"]) for r in got} <= {tuple(r) for r in df.collect()}
        monkeypatch.setattr("skein.tables.MANY", 1)
    one = lambda how: sorted(map(str, memories(spark, "/root/testdata/sf0.001", how).select("id", F.md5("content")).collect()))
    assert one(once_per_id) == one(one_per_id)


def test_further_rows_are_the_copies(spark):
    df = spark.createDataFrame([("b", "one two", "p"), ("a", "two, one!", "p"), ("c", "one two", "q"), ("d", "two", "p one"), ("e", "", "p"), ("f", "?", "p"), (None, "one two", "p")], "id string, t string, p string")
    rows = lifecycle.worded(df, "id", "t", ["p"])
    assert [tuple(r) for r in lifecycle.further(rows).collect()] == [("a", "b")] == [tuple(r) for r in lifecycle.copies(df, "id", "t", ["p"]).collect()]

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stem import english, french
from skein.operators import chunk as C
from skein.operators import classify as K
from skein.operators import graph as G
from skein.operators import lexical as L
from skein.operators import lifecycle as Y
from skein.operators.folds import never_rising, within_budget


def test_english_stems_of_the_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "consistency": "consist", "knightly": "knight", "generally": "general", "rate": "rate", "controlling": "control"}
    assert {w: english(w) for w in pairs} == pairs


def test_inflected_forms_share_stems():
    assert english("deploy") == english("deployed") == english("deploying") and french("migration") == french("migrations")


def test_classify_order_and_null(spark):
    texts = ["the api_key is here, we decided", "we decided on a convention", "TODO: fix", "USER: hi", "plain", None, ""]
    got = [r["c"]["kind"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(K.classified(F.col("t")).alias("c")).collect()]
    assert got == ["credential", "decision", "todo", "transcript", "fact", "fact", "fact"]


def test_budget_skips_or_stops(spark):
    rows = spark.createDataFrame([("r", 1, "a", 5), ("r", 2, "b", 100), ("r", 3, "c", 4), ("q", 1, "d", 11)], "k string, o int, id string, size int")
    skip = within_budget(rows, ["k"], ["o"], "size", 10)
    stop = within_budget(rows, ["k"], ["o"], "size", 10, stop=True)
    assert sorted(r["id"] for r in skip.collect()) == ["a", "c"] and sorted(r["id"] for r in stop.collect()) == ["a"]


def test_budgets_of_long_lists(spark):
    rnd = random.Random(3)
    size = lambda i: rnd.choice([0, None, 1, 400, 700, 900] if i > 2_300 else [600, 700, 900])
    rows = [(k, i, size(i)) for k in ("a", None) for i in range(2_600)] + [("b", i, 1) for i in range(1_600)]
    df = spark.createDataFrame(rows, "k string, o int, size int")
    for stop in (False, True):
        want, used, shut = set(), {}, set()
        for k, o, n in rows:
            if k not in shut and n is not None and used.get(k, 0) + n <= 1_500:
                want.add((k, o, n))
                used[k] = used.get(k, 0) + n
            elif stop:
                shut.add(k)
        got = [tuple(r) for r in within_budget(df, ["k"], ["o"], "size", 1_500, stop=stop).collect()]
        assert len(got) == len(want) and set(got) == want


def test_never_rising(spark):
    v = spark.createDataFrame([([1.0, 2.0, 0.5, 0.9],)], "s array<double>").select(never_rising(F.col("s")).alias("s")).first()["s"]
    assert [round(x, 6) for x in v] == [1.0, 0.99, 0.5, 0.495]


def test_link_boost_is_the_fold_whatever_the_order(spark):
    rel = ["deprecates", "deprecates", "resolves", "resolves", "resolves", "resolves", "shares_topic", "x"]
    random.Random(1).shuffle(rel)
    got = G.link_boosts(spark.createDataFrame([("s", "t", r) for r in rel], "source_id string, target_id string, relation string")).first()["boost"]
    acc = 0.0
    for b in sorted(G.BOOSTS.get(r, G.OTHER) for r in rel):
        acc = min(max(acc + b, -0.8), 0.25)
    assert abs(got - acc) < 1e-9


def test_phrase_and_near(spark):
    rows = spark.createDataFrame([("a", "x big red dog"), ("b", "big dog red"), ("c", "big 1 2 3 4 5 6 7 8 red"), ("d", "big 1 2 3 4 5 6 7 8 9 red"), ("e", None)], "id string, t string")
    q = spark.createDataFrame([("q", 0, "big"), ("q", 1, "red")], "query string, n int, term string")
    places = L.positions(rows, "id", {"t": F.col("t")})
    assert [r["key"] for r in L.phrase(places, q).collect()] == ["a"]
    assert sorted(r["key"] for r in L.near(places, q, 8).collect()) == ["a", "b", "c"]


def test_bm25_by_hand(spark):
    import math

    rows = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", "bird bird bird bird")], "id string, t string")
    q = spark.createDataFrame([("q", 0, "cat")], "query string, n int, term string")
    f = {"t": F.col("t")}
    got = L.bm25(L.match_terms(L.postings(rows, "id", f), q, prefix=False), L.lengths(rows, "id", f), {}).first()["score"]
    idf = max(math.log((3 - 1 + 0.5) / 1.5), 1e-6)
    assert abs(got - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (8 / 3)))) < 1e-9


def test_prefix_counts_each_term_once(spark):
    rows = spark.createDataFrame([("a", "cache caches cap")], "id string, t string")
    q = spark.createDataFrame([("q", 0, "cach"), ("q", 1, "ca")], "query string, n int, term string")
    got = {r["n"]: r["tf"] for r in L.match_terms(L.postings(rows, "id", {"t": F.col("t")}), q, prefix=True).collect()}
    assert got == {0: 2, 1: 3}


def test_similar_sets_against_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices("a b c d e f g h i j k l m n o p".split(), k=12)) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame([(f"k{i:02d}", t, "g" if i % 3 else None) for i, t in enumerate(base)], "id string, t string, g string")
    got = {(r["a"], r["b"]) for r in Y.similar_word_sets(rows, "id", "t", ["g"], 0.7).collect()}
    sets = {}
    for r in rows.collect():
        if r["t"]:
            sets.setdefault((r["g"], frozenset(r["t"].split())), r["id"])
    reps = [(g, w, k) for (g, w), k in sets.items()]
    exp = {tuple(sorted((k1, k2))) for i, (g1, w1, k1) in enumerate(reps) for g2, w2, k2 in reps[i + 1 :] if g1 == g2 and len(w1 & w2) / len(w1 | w2) >= 0.7}
    assert got == exp


def test_seed_groups_are_greedy_not_transitive(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r["member"]: r["seed"] for r in Y.seed_groups(pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_capsule_places_follow_time(spark):
    rows = spark.createDataFrame([("p", f"i{n:02d}", f"2024-01-{1 + n % 9:02d} 00:00:00") for n in range(30)] + [(None, "z", None)], "project string, id string, u string").withColumn("updated_at", F.to_timestamp("u"))
    got = sorted((r["place"], r["u"], r["id"]) for r in Y.in_order(rows, ["project"], "updated_at", "id").filter("project = 'p'").collect())
    assert [g[0] for g in got] == list(range(30)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([*"ab .\n#`", "```\n", "\r\n", "é", "漢", "word " * 30]), max_size=400).map("".join))
def test_chunks_stay_in_bounds(text):
    parts = C.chunked(text, 600)
    assert all(t.strip() for t, _, _ in parts) and all(a <= b for _, a, b in parts)


def test_code_is_cut_at_definitions():
    text = "import os\n\n" + "\n".join(f"def f{i}():\n    " + "\n    ".join(f"x{j} = {j}" for j in range(40)) for i in range(3))
    units = C.code_units(text)
    assert len(units) == 3 and all("def f" in u for u, _, _ in units)


def test_preview_and_name_words(spark):
    r = spark.createDataFrame([("a\n b" + "x" * 200, "src/fieldStateFrame_v2.py")], "t string, p string").select(X.preview(F.col("t")).alias("v"), X.name_words(F.col("p")).alias("w")).first()
    assert len(r["v"]) == 120 and r["v"].endswith("…") and r["w"] == ["field", "state", "frame"]


def test_a_list_of_many_rows_stops_in_its_place(spark):
    rows = spark.createDataFrame([("p", i, 0 if i < 2_500 else 500) for i in range(2_600)], "k string, o int, size int")
    got = [r["o"] for r in within_budget(rows, ["k"], ["o"], "size", 1_500, stop=True).collect()]
    assert sorted(got) == list(range(2_503))

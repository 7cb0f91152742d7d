import pytest
from pyspark.sql import functions as F

from skein.operators import knowledge as K
from skein.operators import relational as R
from skein.operators.components import components
from skein.tables import slug, tags_of


def memories(spark, rows):
    schema = "id string, content string, kind string, project string, tags array<string>, importance int, expires_at timestamp, updated_at timestamp, created_at timestamp, access_count int, session_id string, thread_id string, window_id string"
    keys = [x.split(" ")[0] for x in schema.split(", ")]
    base = {"content": "", "kind": "fact", "tags": [], "importance": 3}
    frame = spark.createDataFrame([tuple({**base, **r}.get(k) for k in keys[:6]) + (None,) * 7 for r in rows], schema) if rows else spark.createDataFrame([], schema)
    times = spark.createDataFrame([(r["id"], r.get("expires"), r.get("updated")) for r in rows] or [("", None, None)], "id string, e string, u string")
    return frame.join(times, "id").withColumns({"expires_at": F.to_timestamp("e"), "updated_at": F.to_timestamp("u")}).drop("e", "u")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_slug_and_tags(spark):
    rows = spark.createDataFrame([("  Onyx Nest ", '["a","b"]'), ("--", '["open'), ("Été_x/", "null"), (None, None), ("", "a,b"), ("A", "[]")], "n string, t string")
    got = rows.select(slug(F.col("n")).alias("s"), tags_of(F.col("t")).alias("t")).collect()
    assert [r["s"] for r in got] == ["onyx-nest", None, "t-x", None, None, "a"]
    assert [r["t"] for r in got] == [["a", "b"], [], [], [], [], []]


def test_page_orders_ties_by_id_and_nulls_last(spark):
    m = memories(spark, [{"id": "b", "updated": "2024-01-01"}, {"id": "a", "updated": "2024-01-01"}, {"id": "z"}, {"id": "n", "updated": "2025-01-01"}])
    assert [r["id"] for r in R.page(m, limit=10).collect()] == ["n", "a", "b", "z"]
    assert [r["id"] for r in R.page(m, limit=1, offset=1).collect()] == ["a"]


def test_visibility_scope_expiry(spark):
    m = memories(spark, [{"id": "c", "kind": "credential"}, {"id": "n", "kind": None}, {"id": "e", "expires": "2024-01-01"}])
    assert ids(R.visible(m)) == ["e", "n"] and ids(R.visible(m, "full")) == ["c", "e", "n"]
    with pytest.raises(ValueError):
        R.visible(m, "odd")
    assert ids(m.filter(R.expired("2024-01-02"))) == ["e"] and ids(m.filter(R.expired("2024-01-01"))) == []


def test_bulk_delete_never_takes_pins_and_needs_a_filter(spark):
    m = memories(spark, [{"id": "p", "tags": ["pinned"], "importance": 1}, {"id": "u", "tags": ["unpinned"], "importance": 1}])
    assert ids(R.bulk_delete_matches(m, "2025-01-01", importance_max=2)) == ["u"]
    with pytest.raises(ValueError):
        R.bulk_delete_matches(m, "2025-01-01")


def test_age_is_whole_periods(spark):
    m = memories(spark, [{"id": "a", "updated": "2024-01-01 12:00:00"}])
    assert m.select(R.age_days("updated_at", "2024-01-02 11:59:59").alias("d")).first()["d"] == 0


def test_empty_tables(spark):
    m = memories(spark, [])
    links = spark.createDataFrame([], "source_id string, target_id string")
    assert R.hygiene(m, links, spark.createDataFrame([], "slug string"), "2024-01-01").first()["total"] == 0
    assert components(links, "source_id", "target_id").count() == 0


def test_project_of_path_takes_the_longest_and_no_sibling(spark):
    p = spark.createDataFrame([("/w/a", "a"), ("/w/a/b", "b"), ("", "none")], "path string, slug string")
    q = spark.createDataFrame([("/w/a/b/c.py",), ("/w/ab/x",), ("/w/a",)], "path string")
    assert {r["path"]: r["project"] for r in R.project_of_path(q, p).collect()} == {"/w/a/b/c.py": "b", "/w/ab/x": None, "/w/a": "a"}


def test_triples_boundaries_and_readding(spark):
    t = spark.createDataFrame([("1", "s", "p", "o", "2024-01-01", "2024-02-01"), ("2", "s", "p", "o2", None, None)], "id string, subject string, predicate string, object string, f string, t string")
    t = t.withColumns({"valid_from": F.to_date("f"), "valid_to": F.to_date("t")})
    assert ids(K.as_of(t, "2024-02-01")) == ["1", "2"] and ids(K.as_of(t, "2024-02-02")) == ["2"] and ids(K.as_of(t, "2023-12-31")) == ["2"]
    batch = spark.createDataFrame([("S", "P", "O"), ("s", "p", "o2"), (None, "p", "x")], "subject string, predicate string, object string")
    assert [r["object"] for r in K.to_add(batch, t).collect()] == ["o"]


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(5)
    pairs = [(f"n{rnd.randint(0, 60)}", f"n{rnd.randint(0, 60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("n1", None), ("h", "h")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}

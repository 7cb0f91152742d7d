"""Results over all rows: copies in groups, crowds of an entity, all kinds of entities, and so on, against brute force."""

import random

from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import lifecycle as Y
from skein.operators.components import components
from skein.queries import graph as QG

COLUMNS = "id string, content string, project string, kind string, importance int, tags array<string>, created_at timestamp, session_id string, thread_id string, window_id string"


def store(spark, rows):
    """rows: (id, content, importance, tags), created in the order of their ids."""
    return spark.createDataFrame([(i, c, "p", "note", n, tags, None, None, None, None) for i, c, n, tags in rows], COLUMNS)


def test_copies_are_in_the_groups_of_their_representative(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=7)) for _ in range(30)]
    texts = base + [rnd.choice(base) for _ in range(30)] + ["only copies here", "here only copies", "alone in this", "", "", "!?"]
    rnd.shuffle(texts)
    rows = [(f"k{i:02d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, t string")
    sets = {k: frozenset(w for w in t.split() if len(w) >= 3 and w.isalpha()) for k, t in rows}
    near = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-12
    want = {}
    for i, (a, _) in enumerate(rows):
        if a not in want:
            free = [b for b, _ in rows[i + 1 :] if b not in want and near(a, b)]
            want |= dict.fromkeys([a, *free], a) if free else {}
    pairs = Y.similar_word_sets(df, "id", "t", [], 0.7, 3)
    got = Y.with_copies(Y.seed_groups(pairs).toDF("group", "id"), Y.copies(df, "id", "t", [], 3)).collect()
    assert len(got) == len(want) and {r["id"]: r["group"] for r in got} == want


def test_merge_takes_all_copies(spark):
    m = store(spark, [("a", "one two three four five six seven", 1, ["x"]), ("b", "seven six five four three two one!", 5, ["y"]), ("c", "one two three four five six seven eight", 2, ["z"]), ("d", "quite alone", 1, ["u"]), ("e", "quite alone", 4, ["v"]), ("f", "?!", 1, []), ("g", "?!", 1, []), ("h", "!?", 1, []), ("i", "nothing like it", 3, [])])
    groups = components(Y.similar_word_sets(m, "id", "content", ["project", "kind"], Y.MERGE), "a", "b").toDF("id", "group")
    got = {r["group"]: (r["n"], r["importance"], r["tags"]) for r in Y.merged(m, Y.with_copies(groups, Y.copies(m, "id", "content", ["project", "kind"], wordless=True))).collect()}
    assert got == {"a": (3, 5, ["x", "y", "z"]), "d": (2, 4, ["u", "v"]), "f": (2, 1, [])}


def next_partners(entities, project, kinds):
    """Links of shared_entities, one row at a time: by the entity's relation or else the memories' kinds, from both sides."""

    def named(a, b):
        return next((n for x, y, n in G.BY_KINDS if x in (None, kinds[a]) and y in (None, kinds[b])), "relates_to")

    want = {}
    groups = {}
    for i, kind, value in entities:
        groups.setdefault((kind, value), []).append(i)
    for (kind, _), ids in groups.items():
        if kind not in G.LINKING:
            continue
        for a in ids:
            may = sorted(b for b in ids if b != a and (kind == "topic" or None in (project[a], project[b]) or project[a] == project[b]))
            ring = [b for b in may if b > a] + [b for b in may if b < a]
            for b in ring[: G.PARTNERS.get(kind, G.MANY)]:
                for x, y in ((a, b), (b, a)):
                    name = G.RELATION.get(kind) or named(x, y)
                    want[x, y] = min(want.get((x, y), name), name)
    return want


def test_partners_of_an_entity_do_not_depend_on_its_size(spark):
    rnd = random.Random(7)
    ids = [f"m{i:04d}" for i in range(900)]
    project = {i: rnd.choice([None, "x", "x", "y", "y", "z"]) for i in ids} | {"m0100": "rare", "m0899": "rare"}
    kinds = {i: rnd.choice(["bug", "decision", "snippet", "todo", "note"]) for i in ids}
    entities = [(i, "tech", "sql") for i in ids] + [(i, "component", "sql-cli") for i in ids] + [(i, "topic", "storage") for i in ids if rnd.random() < 0.6] + [(i, "agent", f"a{rnd.randrange(60)}") for i in ids] + [(i, "person", f"P{rnd.randrange(400)}") for i in ids] + [(i, "file", "f.py") for i in ids if project[i]]
    m, e = spark.createDataFrame([(i, project[i], kinds[i]) for i in ids], "id string, project string, kind string"), spark.createDataFrame(entities, "id string, kind string, value string")
    want = next_partners(entities, project, kinds)
    for block, merge in ((G.BLOCK, "true"), (16, "false")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)  # without it ids are in several ranges
        try:
            got = G.shared_entities(e, m.repartition(3), block).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(want) and {(r["source_id"], r["target_id"]): r["relation"] for r in got} == want


def test_pairs_and_cooccurrence_over_all_kinds(spark, monkeypatch):
    texts = {"a": "written in sql by Cursor", "b": "SQL again", "c": "see src/app/main.py", "d": "src/app/main.py fails", "e": "the auth-service", "f": "auth-service of Cursor", "g": "Spoke with Ada Byron", "h": "Thanks Ada Byron", "i": "nothing"}
    m = spark.createDataFrame([(i, t, "p" if i < "f" else "q", None) for i, t in texts.items()], "id string, content string, project string, source string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    none = spark.createDataFrame([], "source_id string, target_id string, relation string")
    monkeypatch.setattr(QG, "memories", lambda s, d: m)
    monkeypatch.setattr(QG, "links", lambda s, d: none)
    own = {}
    for r in G.entities(m).collect():
        own.setdefault(r["id"], set()).add((r["kind"], r["value"]))
    assert {k for e in own.values() for k, _ in e} == {"project", "origin", "platform", "tech", "agent", "file", "component", "person"}
    project = {r["id"]: r["project"] for r in m.collect()}
    for name, n in (("coherence_pairs_all", 5), ("adjacency_pairs_all", 20)):
        top = {p: sorted(i for i in own if project[i] == p)[:n] for p in "pq"}
        want = {(p, a, b) for p, ids in top.items() for a in ids for b in ids if a < b and own[a] & own[b]}
        got = QG.QUERIES[name](spark, "").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = {(r["word"], r["value"]): r["n"] for r in QG.entity_cooccurrence_all(spark, "").collect()}
    for word in ("notes", "sql", "cursor"):
        n = {}
        for e in own.values():
            if any(v.lower() == word for _, v in e):
                for v in {v for _, v in e if v.lower() != word}:
                    n[v] = n.get(v, 0) + 1
        assert {v: c for (w, v), c in got.items() if w == word} == dict(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4])


def test_seed_groups_of_a_long_chain(spark):
    keys = [f"t{i:03d}" for i in range(130)]
    pairs = spark.createDataFrame(list(zip(keys, keys[1:], strict=False)), "a string, b string")
    assert {r["member"]: r["seed"] for r in Y.seed_groups(pairs).collect()} == {k: keys[i - i % 2] for i, k in enumerate(keys)}


def test_code_is_chunked_whatever_its_kind(spark, monkeypatch):
    from skein.queries import text as QT

    code = "import os\n\n" + "\n".join(f"def f{i}():\n    " + "\n    ".join(f"x{j} = {j}" for j in range(40)) for i in range(3))
    monkeypatch.setattr(QT, "memories", lambda s, d: spark.createDataFrame([("a", code, "snippet"), ("b", code, "note")], "id string, content string, kind string"))
    n = {r["id"]: r["count"] for r in QT.chunk_code(spark, "").groupBy("id").count().collect()}
    assert n == {"a": 3, "b": 3}

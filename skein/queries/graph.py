"""Links, traversal, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators.components import components
from skein.session import cut
from skein.tables import L, M, links, memories


def clean_links(s, d):
    return links(s, d).select("source_id", "target_id", "relation")


def roots(s, d):
    """The five memories with most links."""
    e = G.neighbours(links(s, d))
    return e.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(5).select(F.col("node").alias("root"))


def bfs_depth1(s, d):
    return G.reachable(links(s, d), roots(s, d), 1)


def bfs_depth2(s, d):
    return G.reachable(links(s, d), roots(s, d), 2)


def bfs_depth3(s, d):
    return G.reachable(links(s, d), roots(s, d), 3)


def find_related(s, d):
    from skein.functions.text import preview

    near = G.reachable(links(s, d), roots(s, d), 2).filter("depth > 0")
    return near.join(memories(s, d).select(F.col("id").alias("node"), "kind", F.length(preview(F.col("content"), 150)).alias("shown")), "node").select("root", "node", "depth", "kind", "shown")


def link_boost_clamped(s, d):
    return G.link_boosts(links(s, d)).select("id", F.round("boost", 6).alias("boost"))


def link_components(s, d):
    return components(links(s, d), "source_id", "target_id")


def entity_counts(s, d):
    return G.entities(memories(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def entity_topics(s, d):
    return G.entities(memories(s, d)).filter("kind in ('topic', 'origin', 'project')").select("id", "kind", "value")


def entity_links(s, d):
    return G.shared_entities(G.entities(memories(s, d)), memories(s, d))


WORDS = ("storage", "incident", "notes", "nimbus-relay")


def entity_cooccurrence(s, d):
    """Over the kinds that the SQL names; entity_cooccurrence_all is over all."""
    words = s.createDataFrame([(w,) for w in WORDS], "word string")
    e = G.entities(memories(s, d)).filter("kind in ('topic', 'origin', 'project')")
    return G.cooccurring(e, words)


def entity_cooccurrence_all(s, d):
    """Over all kinds of entities, which SQL does not express."""
    words = s.createDataFrame([(w,) for w in (*WORDS, "sql", "cursor")], "word string")
    return G.cooccurring(G.entities(memories(s, d)), words)


def project_entities(s, d):
    """Entities of a project's memories, by kind, the most common fifteen."""
    from pyspark.sql import Window

    e = G.entities(memories(s, d)).join(memories(s, d).filter("project = 'nimbus-relay'").select("id"), "id", "left_semi")
    counts = e.filter("kind in ('tech', 'component', 'file', 'person')").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).filter("r <= 15").drop("r")


def newest(m, n):
    """(query, id): the n newest of each project."""
    from skein.operators.relational import newest_per

    return newest_per(m.filter("project is not null"), ["project"], "updated_at", "id", n).select(F.col("project").alias("query"), "id")


def coherence_pairs(s, d):
    """Pairs that share a topic among the five newest of each project; coherence_pairs_all is over all kinds of entities."""
    m = memories(s, d)
    return G.adjacency(links(s, d).limit(0), G.entities(m).filter("kind = 'topic'"), newest(m, 5))


def coherence_pairs_all(s, d):
    """Pairs that share an entity of any kind among the five newest of each project; the project is one, so these are all pairs of it."""
    m = memories(s, d)
    top = cut(newest(m, 5))
    return G.adjacency(links(s, d).limit(0), G.entities(m.join(top, "id", "left_semi")), top)


def adjacency_pairs(s, d):
    """Linked or sharing a topic, among the twenty newest of each project; adjacency_pairs_all is over all kinds of entities."""
    m = memories(s, d)
    return G.adjacency(links(s, d), G.entities(m).filter("kind = 'topic'"), newest(m, 20))


def adjacency_pairs_all(s, d):
    """Linked or sharing an entity of any kind, among the twenty newest of each project."""
    m = memories(s, d)
    top = cut(newest(m, 20))
    return G.adjacency(links(s, d), G.entities(m.join(top, "id", "left_semi")), top)


def corpus_profile(s, d):
    return G.corpus_analysis(memories(s, d)).groupBy("origin", "confidence").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (clean_links, bfs_depth1, bfs_depth2, bfs_depth3, find_related, link_boost_clamped, link_components, entity_counts, entity_topics, entity_links, entity_cooccurrence, entity_cooccurrence_all, project_entities, coherence_pairs, coherence_pairs_all, adjacency_pairs, adjacency_pairs_all, corpus_profile)}

E2 = "e2 AS (SELECT source_id AS node, target_id AS next FROM l UNION SELECT target_id, source_id FROM l), r0 AS (SELECT node AS root FROM e2 GROUP BY node ORDER BY count(*) DESC, node LIMIT 5)"
BFS = """WITH RECURSIVE {L}, {E2}, b AS (SELECT root, root AS node, 0 AS depth FROM r0 UNION SELECT root, next, depth + 1 FROM b JOIN e2 USING (node) WHERE depth < {n}), seen AS (SELECT root, node, min(depth) AS depth FROM b GROUP BY 1, 2)"""
TOPICS = " UNION ALL ".join(f"SELECT id, 'topic' AS kind, '{t}' AS value FROM ws WHERE list_has_any(w, {ws.split()!r})" for t, ws in G.TOPIC.items())
FOLD = "translate(lower(content), 'àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž', 'aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz')"
quoted = lambda p: "'" + p.replace("'", "''") + "'"
ENT = f"""ws AS (SELECT id, project, string_split_regex({FOLD}, '[^a-z0-9]+') AS w, content FROM m), topics AS ({TOPICS}),
  files AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, {quoted(G.FILE)})) AS value FROM m),
  said AS (SELECT id, lower(content) AS low, string_split_regex(trim(content), '\\s+') AS xs FROM m), cores AS (SELECT id, low, xs, list_transform(xs, lambda w: regexp_replace(w, {quoted(G.PERSON_ENDS)}, '', 'g')) AS cs, list_transform(xs, lambda w: regexp_matches(lower(w), '{"|".join(G.PERSON_ROLES)}')) AS fl,
    list_distinct(list_transform(xs, lambda w: regexp_replace(w, {quoted(G.COMPONENT_ENDS)}, '', 'g'))) AS ks, list_filter([{", ".join(f"instr(low, '{h}')" for h in G.HINTS)}], lambda p: p > 0) AS ps FROM said),
  parts AS (SELECT id, unnest(list_filter(ks, lambda c: length(c) > 2 AND regexp_matches(c, {quoted(G.COMPONENT)}) AND len(list_filter(ps, lambda p: abs(p - instr(low, lower(c))) <= {G.NEARBY})) > 0)) AS value FROM cores),
  people AS (SELECT id, list_transform(list_filter(range(1, len(xs) + 1), lambda i: length(cs[i]) BETWEEN 2 AND 20 AND regexp_matches(cs[i], '^\\p{{Lu}}') AND NOT list_contains({G.NOT_PERSONS + G.TECH + G.HINTS!r}, lower(cs[i])) AND NOT regexp_matches(lower(cs[i]), '{"|".join(G.AGENT)}')
    AND (starts_with(xs[i], '@') OR (i > 1 AND list_contains({G.GREETINGS!r}, lower(xs[i - 1]))) OR coalesce(regexp_matches(lower(xs[i + 1]), '^(?:{"|".join(G.PERSON_VERBS)})'), false) OR list_contains(fl[greatest(i - 3, 1):greatest(i - 3, 1) + 6], true))), lambda i: cs[i]) AS ns FROM cores),
  persons AS (SELECT id, unnest(list_filter(ns, lambda n, i: list_position(list_transform(ns, lambda m: lower(m)), lower(n)) = i)) AS value FROM people),
  plats AS (SELECT id, CASE {" ".join(f"WHEN contains(low, '{v}') THEN '{k}'" for k, v in G.PLATFORMS.items())} END AS value FROM said),
  named AS (SELECT id, 'tech' AS kind, unnest(list_intersect(w, {G.TECH!r})) AS value FROM ws UNION ALL SELECT id, 'agent', unnest(list_intersect(w, {G.AGENT!r})) FROM ws UNION ALL SELECT id, 'file', value FROM files UNION ALL SELECT id, 'component', value FROM parts UNION ALL SELECT id, 'person', value FROM persons UNION ALL SELECT id, 'platform', value FROM plats WHERE value IS NOT NULL),
  ent AS (SELECT * FROM topics UNION ALL SELECT id, 'project', project FROM m WHERE project IS NOT NULL UNION ALL
  SELECT id, 'origin', CASE WHEN regexp_matches(content, '(?m)^(?:USER|ASSISTANT):') THEN 'ai_transcript' WHEN regexp_matches(content, '(?m)^(?:```|~~~)') THEN 'codebase' ELSE 'notes' END FROM m)"""
TOP = "top AS (SELECT project AS query, id FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY updated_at DESC NULLS LAST, id) AS r FROM m WHERE project IS NOT NULL) WHERE r <= {0})"
ALL_ENT = "every AS (SELECT DISTINCT id, kind, value FROM ent UNION SELECT DISTINCT id, kind, value FROM named)"
SHARED_ALL = "SELECT DISTINCT a.query, a.id AS a, b.id AS b FROM top a JOIN every x ON x.id = a.id JOIN every y ON x.value = y.value AND x.kind = y.kind JOIN top b ON b.id = y.id AND b.query = a.query AND a.id < b.id"
LINKED = "SELECT a.query, least(a.id, b.id), greatest(a.id, b.id) FROM l JOIN top a ON a.id = source_id JOIN top b ON b.id = target_id AND a.query = b.query"
COOCCUR = """, n AS (SELECT word, b.value, count(DISTINCT b.id) AS n FROM words JOIN {0} a ON lower(a.value) = word JOIN {0} b ON a.id = b.id AND lower(b.value) <> lower(a.value) GROUP BY 1, 2)
        SELECT word, value, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, value) AS r FROM n) WHERE r <= 4"""
LINES = r"string_split(content, chr(10))"
SHARED = "SELECT DISTINCT a.query, a.id AS a, b.id AS b FROM top a JOIN topics x ON x.id = a.id JOIN topics y ON x.value = y.value JOIN top b ON b.id = y.id AND b.query = a.query AND a.id < b.id"

SQL = {
    "clean_links": f"WITH {L} SELECT source_id, target_id, relation FROM l",
    **{f"bfs_depth{n}": BFS.format(L=L, E2=E2, n=n) + " SELECT * FROM seen" for n in (1, 2, 3)},
    "link_boost_clamped": f"""WITH RECURSIVE {L}, b AS (SELECT target_id AS id, CASE relation {' '.join(f"WHEN '{k}' THEN {v}" for k, v in G.BOOSTS.items())} ELSE {G.OTHER} END AS b FROM l),
        o AS (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY b) AS n FROM b), f AS (SELECT id, 0 AS n, 0.0::DOUBLE AS acc FROM (SELECT DISTINCT id FROM b)
        UNION ALL SELECT f.id, o.n, least(greatest(f.acc + o.b, -0.8), 0.25) FROM f JOIN o ON o.id = f.id AND o.n = f.n + 1) SELECT id, round(arg_max(acc, n), 6) AS boost FROM f GROUP BY id""",
    "link_components": f"""WITH RECURSIVE {L}, e2 AS (SELECT source_id AS node, target_id AS next FROM l UNION SELECT target_id, source_id FROM l), c AS (SELECT node, node AS component FROM e2 UNION SELECT e2.next, c.component FROM c JOIN e2 USING (node)) SELECT node, min(component) AS component FROM c GROUP BY node""",
    "entity_topics": f"WITH {M}, {ENT} SELECT DISTINCT id, kind, value FROM ent",
    "entity_cooccurrence": f"""WITH {M}, {ENT}, words AS (SELECT unnest(['storage', 'incident', 'notes', 'nimbus-relay']) AS word), n AS (SELECT word, b.value, count(DISTINCT b.id) AS n FROM words JOIN ent a ON lower(a.value) = word JOIN ent b ON a.id = b.id AND lower(b.value) <> lower(a.value) GROUP BY 1, 2)
        SELECT word, value, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, value) AS r FROM n) WHERE r <= 4""",
    "find_related": BFS.format(L=L, E2=E2, n=2) + rf""", {M.replace("WITH ", "")} SELECT root, node, depth, kind, least(length(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 150) AS shown FROM seen JOIN m ON m.id = node WHERE depth > 0""",
    "entity_counts": f"WITH {M}, {ENT}, {ALL_ENT} SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM every GROUP BY 1",
    "project_entities": f"""WITH {M}, {ENT}, {ALL_ENT}, c AS (SELECT kind, value, count(*) AS n FROM every WHERE id IN (SELECT id FROM m WHERE project = 'nimbus-relay') AND kind IN ('tech', 'component', 'file', 'person') GROUP BY 1, 2)
        SELECT kind, value, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 15""",
    "entity_cooccurrence_all": f"WITH {M}, {ENT}, {ALL_ENT}, words AS (SELECT unnest(['storage', 'incident', 'notes', 'nimbus-relay', 'sql', 'cursor']) AS word)" + COOCCUR.format("every"),
    "coherence_pairs_all": f"WITH {M}, {ENT}, {ALL_ENT}, {TOP.format(5)} {SHARED_ALL}",
    "adjacency_pairs_all": f"WITH {M}, {L}, {ENT}, {ALL_ENT}, {TOP.format(20)} {SHARED_ALL} UNION {LINKED}",
    "corpus_profile": rf"""WITH {M}, x AS (SELECT len({LINES}) AS n, len(list_filter({LINES}, lambda s: regexp_matches(s, '^(?:USER|ASSISTANT):'))) AS marks, len(list_filter({LINES}, lambda s: regexp_matches(s, '^(?:```|~~~|    |\t)'))) AS code FROM m)
        SELECT CASE WHEN marks > 0 THEN 'ai_transcript' WHEN code * 3 >= n THEN 'codebase' WHEN n > 3 THEN 'notes' ELSE 'memory' END AS origin, CASE WHEN marks >= 3 THEN 0.95 WHEN marks > 0 THEN 0.8 WHEN code * 2 >= n THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, count(*) AS n FROM x GROUP BY 1, 2""",
    "coherence_pairs": f"WITH {M}, {ENT}, {TOP.format(5)} {SHARED}",
    "adjacency_pairs": f"WITH {M}, {L}, {ENT}, {TOP.format(20)} {SHARED} UNION SELECT a.query, least(a.id, b.id), greatest(a.id, b.id) FROM l JOIN top a ON a.id = source_id JOIN top b ON b.id = target_id AND a.query = b.query",
}

"""Knowledge triples: adding, invalidating, asking as of a day, timelines, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import knowledge as K
from skein.tables import AS_OF, T, triples

DAY = AS_OF[:10]
day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


def kg_as_of(s, d):
    return K.as_of(triples(s, d), "2025-01-15").select("id", "subject", "predicate", "object")


def kg_current(s, d):
    return triples(s, d).filter(K.current()).select("id", "subject", "predicate", "object")


def kg_add(s, d):
    """New triples of a batch: every triple again with another object, and the ones there are already."""
    old = triples(s, d)
    batch = old.select("subject", "predicate", "object").unionByName(old.filter("predicate = 'uses'").select("subject", "predicate", F.concat("object", F.lit(" two")).alias("object")))
    return K.to_add(batch, old)


def kg_invalidate(s, d):
    gone = triples(s, d).filter("predicate = 'owned_by'").select("subject", "predicate", "object").distinct()
    return K.invalidate(triples(s, d), gone, DAY).filter("changed").select("id", day("valid_to"))


def kg_query_entity(s, d):
    return K.about(triples(s, d), "nimbus-relay").select("direction", "id", "predicate", "other", "current")


def kg_query_entity_as_of(s, d):
    return K.about(K.as_of(triples(s, d), "2025-03-01"), "nimbus-relay").select("direction", "id", "predicate", "other", "current")


def kg_timeline(s, d):
    return K.timeline(triples(s, d), None, 100).select("id", day("valid_from"), "subject")


def kg_timeline_entity(s, d):
    return K.timeline(triples(s, d), "onyx-nest", None).select("id", day("valid_from"), "predicate")


def kg_stats(s, d):
    return K.statistics(triples(s, d))


def kg_entities(s, d):
    t = triples(s, d)
    return t.select(F.col("subject").alias("entity")).union(t.select("object")).distinct()


def triple_support(s, d):
    return K.support(triples(s, d), DAY)


def triple_penalty(s, d):
    return K.support(triples(s, d), DAY).select("memory_id", F.round(K.penalty(F.col("active"), F.col("expired")), 6).alias("factor"))


QUERIES = {f.__name__: f for f in (kg_as_of, kg_current, kg_add, kg_invalidate, kg_query_entity, kg_query_entity_as_of, kg_timeline, kg_timeline_entity, kg_stats, kg_entities, triple_support, triple_penalty)}

ASOF = "(valid_from IS NULL OR valid_from <= DATE '{0}') AND (valid_to IS NULL OR valid_to >= DATE '{0}')"
ABOUT = """SELECT 'outgoing' AS direction, id, predicate, object AS other, valid_to IS NULL AS current FROM {0} WHERE subject = 'nimbus-relay'
  UNION ALL SELECT 'incoming', id, predicate, subject, valid_to IS NULL FROM {0} WHERE object = 'nimbus-relay'"""
SUPPORT = f"""s AS (SELECT source_memory_id AS memory_id, count(*) FILTER (WHERE valid_to IS NULL OR valid_to >= DATE '{DAY}') AS active, count(*) FILTER (WHERE valid_to < DATE '{DAY}') AS expired FROM t WHERE source_memory_id IS NOT NULL GROUP BY 1)"""

SQL = {
    "kg_as_of": f"WITH {T} SELECT id, subject, predicate, object FROM t WHERE {ASOF.format('2025-01-15')}",
    "kg_current": f"WITH {T} SELECT id, subject, predicate, object FROM t WHERE valid_to IS NULL",
    "kg_add": f"""WITH {T}, b AS (SELECT DISTINCT subject, predicate, object FROM (SELECT subject, predicate, object FROM t UNION ALL SELECT subject, predicate, object || '_two' FROM t WHERE predicate = 'uses'))
        SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE valid_to IS NULL AND t.subject = b.subject AND t.predicate = b.predicate AND t.object = b.object)""",
    "kg_invalidate": f"WITH {T} SELECT id, '{DAY}' AS valid_to FROM t WHERE valid_to IS NULL AND predicate = 'owned_by'",
    "kg_query_entity": f"WITH {T} {ABOUT.format('t')}",
    "kg_query_entity_as_of": f"WITH {T}, u AS (SELECT * FROM t WHERE {ASOF.format('2025-03-01')}) {ABOUT.format('u')}",
    "kg_timeline": f"WITH {T} SELECT id, strftime(v, '%Y-%m-%d') AS valid_from, subject FROM (SELECT id, valid_from AS v, subject FROM t ORDER BY valid_from NULLS LAST, id LIMIT 100)",
    "kg_timeline_entity": f"WITH {T} SELECT id, strftime(valid_from, '%Y-%m-%d') AS valid_from, predicate FROM t WHERE subject = 'onyx-nest' OR object = 'onyx-nest'",
    "kg_stats": f"""WITH {T} SELECT count(*) AS total, count(*) FILTER (WHERE valid_to IS NULL) AS current, count(*) FILTER (WHERE valid_to IS NOT NULL) AS expired, list_sort(list(DISTINCT predicate)) AS predicates,
        (SELECT count(*) FROM (SELECT subject FROM t UNION SELECT object FROM t)) AS entities FROM t""",
    "kg_entities": f"WITH {T} SELECT subject AS entity FROM t UNION SELECT object FROM t",
    "triple_support": f"WITH {T}, {SUPPORT} SELECT * FROM s",
    "triple_penalty": f"WITH {T}, {SUPPORT} SELECT memory_id, round(CASE WHEN expired = 0 THEN 1.0 WHEN active = 0 THEN 0.3 ELSE 0.5 + 0.5 * active / (active + expired) END, 6) AS factor FROM s",
}

"""Links between memories: traversal, boosts, shared entities, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import folded
from skein.session import cut

#: Boost of a link by its relation; others count OTHER. The running sum stays within BOUNDS.
BOOSTS = {"deprecates": -0.6, "resolves": 0.08, "resolved_by": 0.08, "implements": 0.08, "implemented_by": 0.08, "depends_on": 0.08, "required_by": 0.08, "shares_topic": 0.06, "same_agent": 0.05, "same_origin": 0.02}
OTHER, BOUNDS = 0.03, (-0.8, 0.25)
#: Most partners of a memory by entity kind, and the relation that a shared entity stands for.
PARTNERS = {"topic": 8, "agent": 6, "platform": 4, "origin": 4}
MANY = 10
RELATION = {"topic": "shares_topic", "agent": "same_agent", "platform": "same_origin", "origin": "same_origin"}
# What any other shared entity makes of two memories by their kinds, the first that holds; null stands for any kind.
BY_KINDS = [
    ("bug", "decision", "resolved_by"),
    ("bug", "architecture", "resolved_by"),
    ("decision", "bug", "resolves"),
    ("bug", "snippet", "fixed_by"),
    ("snippet", "bug", "fixes"),
    ("decision", "architecture", "implements"),
    ("decision", "pattern", "implements"),
    ("architecture", "decision", "decided_by"),
    ("todo", None, "depends_on"),
    (None, "todo", "blocks"),
]
#: Kinds of entities that link; a project or a technology alone does not.
LINKING = ("file", "component", "person", "agent", "topic", "platform", "origin")
#: Rows of a run of an entity that one task goes through when it looks for the next ones.
BLOCK = 4096



def neighbours(links: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """(node, next) in both directions, distinct."""
    return links.select(F.col(a).alias("node"), F.col(b).alias("next")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("next"))).filter("node <> next").distinct()


def reachable(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) within depth steps over links in both directions, the roots at 0.

    Each step joins the frontier only and takes away what a root has seen; the lineage is cut every step.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth has to be 0 to 6")
    edges = neighbours(links)
    seen = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.join(edges, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def boost_of(relation: Column) -> Column:
    out = F.lit(OTHER)
    for name, value in BOOSTS.items():
        out = F.when(relation == name, value).otherwise(out)
    return out


def link_boosts(links: DataFrame, target: str = "target_id") -> DataFrame:
    """(id, boost): the boosts of a memory's links, summed from the smallest up and kept within BOUNDS after every one.

    The order makes the result the same however rows are spread. Equal boosts are counted before the shuffle,
    so a hub brings one row a distinct boost.
    """
    counts = links.select(F.col(target).alias("id"), boost_of(F.col("relation")).alias("b")).groupBy("id", "b").agg(F.count(F.lit(1)).alias("n"))
    low, high = BOUNDS
    # n equal steps within bounds end where one step n times as long does: they never turn back
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("b", "n"))), F.lit(0.0), lambda acc, x: F.least(F.greatest(acc + x["b"] * x["n"], F.lit(low)), F.lit(high)))
    return counts.groupBy("id").agg(fold.alias("boost"))


def following(rows: DataFrame, run: list[str], n: int, block: int) -> DataFrame:
    """rows with "next": the ids of the n rows that follow in a run, after the last the first ones; none twice, never the row itself.

    rows: id, "rank" (from 0 by id) and "size" of the run. A block of a run is one task, so a run of any
    length is many; the first rows of what follows a block are copied to its end.
    """
    last = F.floor((F.col("size") - 1) / block)
    at = lambda b, rank, own: F.struct(b.cast("long").alias("block"), rank.cast("long").alias("at"), F.lit(own).alias("own"))
    home, wrapped = F.floor(F.col("rank") / block), F.col("rank") + F.col("size")
    places = F.array(
        at(home, F.col("rank"), True),
        F.when((F.col("rank") >= block) & (F.col("rank") % block < n), at(home - 1, F.col("rank"), False)),
        F.when(F.col("rank") < n, at(last, wrapped, False)),
        F.when((last > 0) & (wrapped < last * block + n), at(last - 1, wrapped, False)),
    )
    placed = rows.withColumn("p", F.explode(F.filter(places, lambda x: x.isNotNull()))).select(*rows.columns, "p.*")
    ids = F.collect_list("id").over(Window.partitionBy(*run, "block").orderBy("at").rowsBetween(1, n))
    return placed.withColumn("next", ids).filter("own").withColumn("next", F.slice("next", F.lit(1), F.least(F.lit(n), F.col("size") - 1).cast("int"))).drop("block", "at", "own")


def shared_entities(entities: DataFrame, memories: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_id, target_id, relation) by a shared entity, in both directions: same project, or one side global; topics across projects too.

    The relation is that of the entity's kind, or else of the memories' kinds, seen from either side; of several the smallest.

    entities: (id, kind, value). Of an entity every memory keeps its next PARTNERS in id order among the rows
    that it may be linked to, after the last the first ones, so an entity that a third of all rows mention
    gives a bounded number of links a row and no pairs of all. The rows are ranked by id in ranges of ids with
    offsets, in runs: all rows ("a"), those of a project ("p") and the global ones ("g"); how runs are cut
    into ranges and blocks does not alter the result.
    """
    # a range of ids is a partition of the sorted ids
    entities = entities.filter(F.col("kind").isin(*LINKING))
    ranges = cut(memories.select("id", "project").filter("id is not null").orderBy("id")).withColumn("range", F.spark_partition_id())
    topic, everywhere = F.col("kind") == "topic", F.col("project").isNull()
    names = F.when(topic, F.array(F.lit("a"))).when(everywhere, F.array(F.lit("a"), F.lit("g"))).otherwise(F.array(F.lit("a"), F.concat(F.lit("p"), F.col("project"))))
    e = cut(entities.distinct().join(ranges, "id")).select("kind", "value", "id", "project", "range", F.explode(names).alias("run"))
    run = ["kind", "value", "run"]
    counts = e.groupBy(*run, "range").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(everywhere, 1)).alias("n_global"))
    w = Window.partitionBy(*run)
    earlier = lambda c: F.coalesce(F.sum(c).over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*run, "range", earlier("n").alias("before"), earlier("n_global").alias("before_global"), F.sum("n").over(w).alias("size"), F.sum("n_global").over(w).alias("size_global"))
    inside = Window.partitionBy(*run, "range").orderBy("id")
    numbered = e.withColumn("i", F.row_number().over(inside) - 1).withColumn("g", F.count(F.when(everywhere, 1)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = cut(numbered.join(offsets, [*run, "range"]).select(*run, "id", "project", (F.col("i") + F.col("before")).alias("rank"), "size", (F.col("g") + F.col("before_global")).alias("place"), "size_global"))
    # all rows are needed only where a row may be linked to all of them
    lists = following(ranked.filter((F.col("run") != "a") | topic | (F.col("size_global") > 0)), run, max(MANY, *PARTNERS.values()), block)
    own = lists.filter((F.col("run").startswith("p")) | ((F.col("run") == "a") & (topic | everywhere))).select("kind", "value", "id", "next")
    # a row of a project stands before the global row at its place, which is the first of its next global rows
    heads = lists.filter("run = 'g'").select("kind", "value", F.col("rank").alias("place"), F.concat(F.array("id"), "next").alias("next"))
    seeking = ranked.filter((F.col("run") == "a") & ~topic & ~everywhere & (F.col("size_global") > 0)).select("kind", "value", "id", (F.col("place") % F.col("size_global")).alias("place"))
    both = own.unionByName(seeking.join(heads, ["kind", "value", "place"]).select("kind", "value", "id", "next")).groupBy("kind", "value", "id").agg(F.flatten(F.collect_list("next")).alias("next"))
    limit = F.lit(MANY)
    for kind, n in PARTNERS.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    # from the row on, then from the first one on
    order = F.transform(F.array_sort(F.transform("next", lambda x: F.struct((x < F.col("id")).alias("again"), x.alias("id")))), lambda x: x["id"])
    hint = F.lit(None).cast("string")
    for kind, name in RELATION.items():
        hint = F.when(F.col("kind") == kind, name).otherwise(hint)
    one = both.select(F.col("id").alias("source_id"), F.explode(F.slice(order, F.lit(1), limit)).alias("target_id"), hint.alias("hint"))
    kinds = memories.select("id", F.col("kind").alias("k"))
    x = one.join(kinds.toDF("source_id", "a"), "source_id").join(kinds.toDF("target_id", "b"), "target_id")
    there = x.select("source_id", "target_id", F.coalesce("hint", relation_of(F.col("a"), F.col("b"))).alias("relation"))
    back = x.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.coalesce("hint", relation_of(F.col("b"), F.col("a"))).alias("relation"))
    return there.unionByName(back).groupBy("source_id", "target_id").agg(F.min("relation").alias("relation"))


def relation_of(source: Column, target: Column) -> Column:
    """What two memories that share something are to each other, by their kinds."""
    out = F.lit("relates_to")
    for a, b, name in reversed(BY_KINDS):
        out = F.when((source == a if a else F.lit(True)) & (target == b if b else F.lit(True)), name).otherwise(out)
    return out


def cooccurring(entities: DataFrame, words: DataFrame, limit: int = 4) -> DataFrame:
    """(word, value, n): values that stand with an entity named by the word, most common first, ties by value.

    Counted by memory: an equality join of an entity's memories with their other entities.
    """
    e = entities.distinct()
    hit = e.join(F.broadcast(words), F.lower(F.col("value")) == F.col("word")).select("word", "id", F.col("value").alias("own"))
    both = hit.join(e.select("id", F.col("value")), "id").filter("lower(value) <> lower(own)")
    counts = both.groupBy("word", "value").agg(F.count_distinct("id").alias("n"))
    w = Window.partitionBy("word").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")


def adjacency(links: DataFrame, entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query, a, b), a < b: linked or sharing an entity, both among the chosen (query, id) of a query."""
    left, right = chosen.select("query", F.col("id").alias("x")), chosen.select("query", F.col("id").alias("y"))
    linked = links.select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y")).distinct().join(left, "x").join(right, ["query", "y"])
    own = entities.distinct().join(chosen, "id")  # the chosen few of each query only
    shared = own.select("query", "kind", "value", F.col("id").alias("x")).join(own.select("query", "kind", "value", F.col("id").alias("y")), ["query", "kind", "value"]).filter("x < y")
    return linked.select("query", F.col("x").alias("a"), F.col("y").alias("b")).unionByName(shared.select("query", F.col("x").alias("a"), F.col("y").alias("b"))).distinct()


# --- entities ------------------------------------------------------------------------------------------

# Fixed values, authored for this library: what names a technology, a topic, an agent, a component.
TECH = "python rust typescript javascript java kotlin swift go golang sql postgres postgresql mysql sqlite redis kafka spark docker kubernetes terraform react svelte django fastapi graphql grpc parquet onnx".split()
TOPIC = {"search": "search retrieval recall query", "storage": "cache store index database lease", "deployment": "deploy deployed release shipped rollout rollback", "testing": "test tests benchmark regression", "performance": "latency slow p95 throughput load", "incident": "outage deadlock deadlocks crash failure panne", "security": "password token secret credential vault", "migration": "migration schema upgrade backfill"}
AGENT = "claude copilot cursor gemini codex chatgpt windsurf aider".split()
FILE = r"[\w.\-]+(?:/[\w.\-]+)+\.[A-Za-z]{1,7}|\b[\w\-]+\.(?:py|rs|ts|js|go|md)\b"
# What a component stands near to, and what makes a capital word a person.
HINTS = "component page layout modal button form input header footer sidebar nav card table dialog dashboard settings profile auth login signup".split()
NEARBY = 50
PERSON_VERBS = "said asked decided recommended pushed wrote built created designed fixed reported suggested mentioned reviewed approved deployed assigned committed merged".split()
PERSON_ROLES = "lead manager developer dev designer architect engineer cto ceo founder cofounder intern qa frontend backend fullstack devops pm product".split()
GREETINGS = "hey hi thanks merci salut cc bonjour".split()
NOT_PERSONS = "the this that then they there their these not you your has have had was were are will can could would should may might all any some for from with into over true false null none self todo note error warning info".split()
#: Words that name a platform, the first that a text holds.
PLATFORMS = {"claude": "claude code", "cursor": "cursor", "chatgpt": "chatgpt", "codex": "codex", "gemini": "gemini"}
# The marks at the ends of a word, which are no part of a person's or a component's name; what a component looks like.
PERSON_ENDS, COMPONENT_ENDS, COMPONENT = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", r"^\p{Lu}|[-_]"


def told_words(df: DataFrame) -> DataFrame:
    """df (id, content, low ...) with persons and components, arrays of names.

    Persons: capital words of 2 to 20 characters that are mentioned (@), greeted, followed by a person's verb, or
    within three words of a role; each once, as first written. Components: words with a capital, a dash or an
    underscore whose first place in the text is within NEARBY characters of a hint's first place.

    What a condition on each word reads is made column by column before, and read there twice: the optimizer
    would else put its making into the condition, once a word.
    """
    said = df.withColumn("said", F.split(F.trim("content"), "\\s+"))
    x = said.withColumns({
        "cores": F.transform("said", lambda w: F.regexp_replace(w, PERSON_ENDS, "")),
        "roles": F.transform("said", lambda w: F.lower(w).rlike("|".join(PERSON_ROLES))),
        "named": F.array_distinct(F.transform("said", lambda w: F.regexp_replace(w, COMPONENT_ENDS, ""))),
        "places": F.filter(F.array(*(F.instr("low", h) for h in HINTS)), lambda p: p > 0),
    })

    def person(i: Column) -> Column:
        core, word = F.get("cores", i), F.get("said", i)
        low = F.lower(core)
        known = low.isin(*NOT_PERSONS, *TECH, *HINTS) | low.rlike("|".join(AGENT))
        greeted = F.lower(F.get("said", i - 1)).isin(*GREETINGS)
        acts = F.lower(F.get("said", i + 1)).rlike("^(?:" + "|".join(PERSON_VERBS) + ")")
        role = (i < F.size("roles")) & F.exists(F.slice("roles", F.greatest(i - 3, F.lit(0)) + 1, F.lit(7)), lambda r: r)
        return core.rlike(r"^\p{Lu}") & F.length(core).between(2, 20) & ~known & (word.startswith("@") | F.coalesce((i > 0) & greeted, F.lit(False)) | F.coalesce(acts, F.lit(False)) | role)

    where = F.filter(F.sequence(F.lit(0), F.size("said") - 1), person)
    near = F.filter("named", lambda c: c.rlike(COMPONENT) & (F.length(c) > 2) & F.exists("places", lambda p: F.abs(p - F.position(F.lower(c), F.col("low"))) <= NEARBY))
    y = x.withColumns({"where": where, "components": F.when(F.size("places") > 0, near).otherwise(F.array().cast("array<string>"))})
    z = y.withColumn("people", F.transform("where", lambda i: F.get("cores", i))).withColumn("lowered", F.transform("people", lambda n: F.lower(n)))
    once = F.filter("people", lambda n, i: (i < F.size("lowered")) & (F.array_position(F.col("lowered"), F.lower(n)) == i + 1))
    return z.withColumn("persons", once).select(*df.columns, "persons", "components")


def entities(df: DataFrame) -> DataFrame:
    """(id, kind, value) of every memory, distinct: project, origin, platform, topics, technologies, agents, files, components, persons.

    Values are lower case but for files, components and persons; texts are searched whole, by built-in functions only.
    """
    words = F.array_distinct(F.filter(F.split(folded(F.col("content")), "[^a-z0-9]+"), lambda w: w != ""))
    row = df.select("id", "project", "source", "content", words.alias("w"), F.lower("content").alias("low"))
    row = told_words(row)
    listed = lambda kind, values: F.transform(F.array_intersect(F.col("w"), F.array(*(F.lit(v) for v in values))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    topics = F.filter(F.array(*(F.when(F.arrays_overlap("w", F.array(*(F.lit(x) for x in ws.split()))), F.struct(F.lit("topic").alias("kind"), F.lit(t).alias("value"))) for t, ws in TOPIC.items())), lambda x: x.isNotNull())
    found = lambda kind, values: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    single = lambda kind, value: F.filter(F.array(F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))), lambda x: x.isNotNull())
    transcript = F.col("content").rlike(r"(?m)^(?:USER|ASSISTANT):")
    origin = F.when(transcript, F.lit("ai_transcript")).when(F.col("content").rlike(r"(?m)^(?:```|~~~)"), F.lit("codebase")).otherwise(F.lit("notes"))
    files = F.regexp_extract_all("content", F.lit(FILE), F.lit(0))
    platform = F.lit(None).cast("string")
    for name, mark in reversed(PLATFORMS.items()):
        platform = F.when(F.col("low").contains(mark), name).otherwise(platform)
    everything = F.concat(single("project", F.col("project")), single("origin", origin), single("platform", platform), topics, listed("tech", TECH), listed("agent", AGENT), found("file", files), found("component", F.col("components")), found("person", F.col("persons")))
    return row.select("id", F.explode(everything).alias("e")).select("id", "e.kind", "e.value").distinct()


def corpus_analysis(df: DataFrame) -> DataFrame:
    """(id, origin, personas, topics, confidence): what a text is; personas are the names before a colon at line starts."""
    lines = F.split("content", "\n")
    names = F.array_distinct(F.filter(F.transform(lines, lambda line: F.regexp_extract(line, r"^\s*([A-Z][A-Za-z]{1,19}):\s", 1)), lambda n: n != ""))
    marks = F.size(F.filter(lines, lambda line: line.rlike(r"^(?:USER|ASSISTANT):")))
    code = F.size(F.filter(lines, lambda line: line.rlike(r"^(?:```|~~~|    |\t)")))
    origin = F.when(marks > 0, "ai_transcript").when(code * 3 >= F.size(lines), "codebase").when(F.size(lines) > 3, "notes").otherwise("memory")
    sure = F.when(marks >= 3, 0.95).when(marks > 0, 0.8).when(code * 2 >= F.size(lines), 0.9).otherwise(0.6)
    w = F.split(folded(F.col("content")), "[^a-z0-9]+")
    topics = F.filter(F.array(*(F.when(F.arrays_overlap(w, F.array(*(F.lit(x) for x in ws.split()))), F.lit(t)) for t, ws in TOPIC.items())), lambda x: x.isNotNull())
    return df.select("id", origin.alias("origin"), F.array_sort(names).alias("personas"), F.array_sort(topics).alias("topics"), sure.alias("confidence"))

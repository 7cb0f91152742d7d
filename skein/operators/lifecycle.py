"""Duplicates on insert, duplicate report, ageing, merging, capsules, expiry: plans as tables, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import first_sentence, normalised
from skein.operators.prefixes import candidates
from skein.operators.relational import age_days, expired, protected
from skein.session import MANY, cut, stored

#: Thresholds of the merge on insert and of the report.
MERGE, REPORT = 0.85, 0.7
#: Rows of a shared word that meet in one group.
HOT = 2_000
#: Open links that the driver takes over in seed_groups.
FEW = 100_000
#: How strongly a kind asks to be condensed; 0.5 for others. Kinds outside COMPRESSIBLE are never condensed by age.
KIND_WEIGHT = {"note": 0.8, "snippet": 0.7, "bug": 0.6, "todo": 0.9}
COMPRESSIBLE = ("bug", "snippet", "note", "todo")
PROTECTED_KINDS = ("credential", "architecture", "preference")
STOP = "the and for with that this from are was were not you has have its into only then when after before under over than one two les des une est pour dans avec sur pas que qui par plus".split()


def word_sets(df: DataFrame, key: str, text: str, bucket: list[str], least_length: int) -> DataFrame:
    """(key, bucket, w, text): the sorted words of a row, and its bucket as one value; null buckets are equal to each other."""
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+")
    words = F.array_distinct(F.filter(split, lambda w: F.length(w) >= max(least_length, 1)))
    return df.select(F.col(key).alias("key"), F.concat_ws("\u0001", *(F.coalesce(F.col(b).cast("string"), F.lit("\u0002")) for b in bucket)).alias("bucket"), F.sort_array(words).alias("w"), F.col(text).alias("text"))


def similar_word_sets(df: DataFrame, key: str, text: str, bucket: list[str], threshold: float, least_length: int = 1) -> DataFrame:
    """(a, b, similarity) of rows of one bucket whose word sets have at least the threshold; exact, without all pairs.

    Pairs are those of the classes of equal word sets, shown by their representatives (smallest key); the other rows of a class
    are found by copies().
    """
    rows = worded(df, key, text, bucket, least_length)
    return alike(rows, further(rows), threshold)


def worded(df: DataFrame, key: str, text: str, bucket: list[str], least_length: int = 1) -> DataFrame:
    """(key, bucket, w) of the rows with a key and words, as a table: what further() and alike() read."""
    return stored(word_sets(df, key, text, bucket, least_length).filter("key is not null and size(w) > 0").select("key", "bucket", "w"))


def further(rows: DataFrame) -> DataFrame:
    """(representative, member), as a table, of worded rows: every further row of a class of equal word sets, beside the class's smallest key.

    Sets are told by digests, and only classes of several rows are looked up.
    """
    each = rows.select("key", F.unhex(F.sha2(F.concat_ws("\u0003", "bucket", F.concat_ws(" ", "w")), 256)).alias("class"))
    several = few(stored(each.groupBy("class").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")))
    return stored(each.join(several, "class").filter("key <> representative").select("representative", F.col("key").alias("member")).distinct())


def alike(rows: DataFrame, further: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of worded rows without the further ones.

    A row shows the words of its prefix, rarest first, that any partner must share (prefix filter, as numbers), so only rows
    with a rare word in common meet; the words themselves are moved only for rows in pairs that their sizes and parities
    allow. Rows are numbered by a hash of their key: equal numbers of unlike keys are told apart when words are compared.
    """
    number = F.xxhash64("key")
    hashes = F.array_distinct(F.transform("w", lambda x: F.xxhash64("bucket", x)))
    sets = rows.select(number.alias("id"), hashes.alias("h"), F.xxhash64("bucket").alias("bucket"))
    near = stored(candidates(sets, rows.count(), threshold, few(further.select(F.xxhash64("member").alias("id")), MANY)))
    ids = few(stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()), MANY)
    said = rows.select(number.alias("id"), "key", "bucket", "w").join(ids, "id", "left_semi")
    end = lambda c: said.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("key", "bucket", "w")))
    both = end("a").join(near, "a").join(end("b"), "b").filter("bucket_a = bucket_b")
    common = F.size(F.array_intersect("w_a", "w_b"))
    value = common / (F.size("w_a") + F.size("w_b") - common)
    return both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), value.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A stored table, broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def meeting(prefix: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b, na, nb) of rows that share a word of a bucket, each pair once or twice a word.

    The rows of a word are dealt into blocks by hash, and every two blocks meet in a group of their own, so that
    a word that many rows share is many tasks.
    """
    blocks = F.ceil(F.col("df") / (block or HOT)).cast("int")
    x = prefix.withColumn("of", blocks).withColumn("own", F.pmod(F.xxhash64("key"), "of").cast("int"))
    left = x.select("bucket", "t", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("of") - 1)).alias("j"), F.col("key").alias("x"), F.col("n").alias("nx"))
    right = x.select("bucket", "t", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("key").alias("y"), F.col("n").alias("ny"))
    met = left.join(right, ["bucket", "t", "i", "j"]).filter("x <> y")
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"))


def copies(df: DataFrame, key: str, text: str, bucket: list[str], least_length: int = 1, *, wordless: bool = False) -> DataFrame:
    """(representative, member): every further row of a class of similar_word_sets, beside the class's smallest key.

    With wordless, equal texts without any word are classes too; they have no similar ones.
    """
    said = F.when(F.size("w") > 0, F.concat_ws(" ", F.lit("w"), F.concat_ws(" ", "w")))
    if wordless:
        said = F.coalesce(said, F.concat(F.lit("t "), F.coalesce("text", F.lit(""))))
    rows = word_sets(df, key, text, bucket, least_length).select("key", "bucket", F.sha2(said, 256).alias("class")).filter("class is not null")
    first = rows.groupBy("bucket", "class").agg(F.min("key").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, ["bucket", "class"]).filter("key <> representative").select("representative", F.col("key").alias("member")).distinct()


def with_copies(groups: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, group) of the representatives' groups and all copies: a copy is in its representative's group.

    A class without similar ones is a group of its own. Copies are similar to whatever their representative is
    similar to, and come after it, so this is what grouping all rows gives; linking copies to representatives
    before a greedy grouping would let the copies of a taken row open groups.
    """
    alone = copies.select(F.col("representative").alias("id")).distinct().join(groups, "id", "left_anti").select("id", F.col("id").alias("group"))
    known = groups.select("id", "group").unionByName(alone)
    return known.unionByName(copies.join(known.withColumnRenamed("id", "representative"), "representative").select(F.col("member").alias("id"), "group"))


def exact_groups(df: DataFrame, key: str, text: str, bucket: list[str]) -> DataFrame:
    """(digest, n, keep) of equal texts of one bucket; null buckets are equal to each other."""
    return df.groupBy(*bucket, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("keep")).filter("n > 1")


def merged(df: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group: the longest text, the largest importance, all tags in first-seen order, the latest scope that is known.

    groups: (id, group). Rows of one group are folded by creation, ties by id.
    """
    order = F.struct("created_at", "id")
    g = df.join(groups, "id")
    rows = g.groupBy("group").agg(
        F.max_by("content", F.struct(F.length("content"), F.col("id"))).alias("content"),
        F.max("importance").alias("importance"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("tags").alias("t")))), lambda x: x["t"]))).alias("tags"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("session_id", "thread_id", "window_id")),
        F.count(F.lit(1)).alias("n"),
    )
    return rows


def seed_groups(pairs: DataFrame) -> DataFrame:
    """(seed, member) of greedy groups: rows in order of their key; a row not yet in a group opens one and takes its free neighbours.

    In rounds: every free row whose smaller neighbours are all decided and none of them a seed becomes a seed,
    and takes its larger free neighbours. That is what going through the rows one by one gives. A row in reach of
    two seeds goes to the smaller. Each round decides at least the smallest free row, so the rounds end; once at most FEW
    links are open, as of a long chain of ascending keys, the driver goes through their rows.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    state = cut(edges.select(F.explode(F.array("u", "v")).alias("k")).distinct().select("k", F.lit(None).cast(edges.schema["u"].dataType).alias("seed")))
    while True:
        free = state.filter("seed is null").select("k")
        waiting = edges.join(free.select(F.col("k").alias("u")), "u").join(free.select(F.col("k").alias("v")), "v").select(F.col("v").alias("k")).distinct()
        seeds = free.join(waiting, "k", "left_anti")
        taken = edges.join(seeds.select(F.col("k").alias("u")), "u").join(free.select(F.col("k").alias("v")), "v").groupBy(F.col("v").alias("k")).agg(F.min("u").alias("s"))
        new = seeds.select("k", F.col("k").alias("s")).unionByName(taken)
        state = cut(state.join(new, "k", "left").select("k", F.coalesce("seed", "s").alias("seed")))
        if not state.filter("seed is null").limit(1).count():
            return state.select("seed", F.col("k").alias("member"))
        free = state.filter("seed is null").select("k")
        edges = cut(edges.join(free.select(F.col("k").alias("u")), "u", "left_semi").join(free.select(F.col("k").alias("v")), "v", "left_semi"))
        if edges.limit(FEW + 1).count() <= FEW:
            larger: dict = {}
            for u, v in edges.select("u", "v").collect():
                larger.setdefault(u, []).append(v)
            seed: dict = {}
            for u in sorted(larger):
                if u not in seed:
                    seed |= {v: u for v in larger[u] if v not in seed}
                    seed[u] = u
            last = state.sparkSession.createDataFrame(list(seed.items()), state.select("k", F.col("seed").alias("s")).schema)
            return state.join(last, "k", "left").select(F.coalesce("seed", "s", "k").alias("seed"), F.col("k").alias("member"))


def gc_score(as_of: str) -> Column:
    """0 to 1: 0.4 for low importance, 0.3 for an age up to a year, 0.3 for the kind."""
    weight = F.lit(0.5)
    for kind, w in KIND_WEIGHT.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    age = F.least(F.greatest(F.coalesce(age_days("updated_at", as_of), F.lit(0)), F.lit(0)) / 365, F.lit(1.0))
    return F.least(0.4 * (1 - (F.col("importance") - 1) / 4) + 0.3 * age + 0.3 * weight, F.lit(1.0))


def gc_candidates(df: DataFrame, as_of: str, *, days: int = 30, importance: int = 3, score: float = 0.6, group: int = 10) -> DataFrame:
    """(id, kind, project, score, place): what a collection would merge, at most `group` rows a kind and project, oldest first."""
    chosen = df.filter(F.col("kind").isin(*COMPRESSIBLE) & ~protected() & ~expired(as_of) & (F.col("importance") < importance) & (age_days("updated_at", as_of) >= days)).withColumn("score", gc_score(as_of)).filter(F.col("score") > score)
    w = Window.partitionBy("kind", "project").orderBy(F.desc("score"), "id")
    return chosen.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= group)


def gc_groups(candidates: DataFrame, as_of: str) -> DataFrame:
    """Statistics of each kind and project with more than one candidate."""
    age = age_days("updated_at", as_of)
    return (
        candidates.groupBy("kind", "project")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("score"), F.min(age).alias("youngest"), F.max(age).alias("oldest"), F.min("importance").alias("low"), F.max("importance").alias("high"), F.array_sort(F.collect_list("id")).alias("ids"))
        .filter("n > 1")
    )


def keywords(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """(keys, keywords): the terms that most rows of a group hold, ties by term, without stop words and short ones."""
    t = F.explode(F.array_distinct(F.filter(F.split(normalised(F.col(text)), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP)))).alias("term")
    counts = df.select(*keys, t).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy(*keys).orderBy(F.desc("df"), "term")
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("keywords"))


def summaries(df: DataFrame, keys: list[str], label: Column, *, n_keywords: int = 5, bullets: int = 8) -> DataFrame:
    """(keys, n, summary): a heading, the group's keywords and the first sentences of its most important rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("updated_at"), "id")
    rows = df.withColumn("r", F.row_number().over(w))
    lines = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= bullets, F.struct("r", first_sentence(F.col("content")).alias("s"))))), lambda x: F.concat(F.lit("- "), x["s"])).alias("bullets"))
    join = [F.col(f"l.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    words = keywords(df, keys, "content", n_keywords)
    both = lines.alias("l").join(words.alias("k"), join, "left").select(*(F.col(f"l.{k}") for k in keys), "l.n", "l.bullets", F.col("k.keywords").alias("keywords"))
    text = F.concat_ws("\n", F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ")), F.array_join("bullets", "\n"))
    return both.select(*keys, "n", text.alias("summary"))


def in_order(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """df with "place", from 0, in the order of time and tie within the keys, null times first.

    Rows are numbered within a day, and days by the counts before them, so a hot key is many tasks.
    """
    dated = df.withColumn("day", F.coalesce(F.to_date(time), F.lit("0001-01-01").cast("date")))
    counts = dated.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).select(*(F.col(k).alias(f"{k}__o") for k in keys), F.col("day").alias("day__o"), "before")
    inside = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(F.asc_nulls_first(time), tie)) - 1
    same = F.col("day") == F.col("day__o")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__o"))
    return dated.withColumn("inside", inside).join(offsets, same).withColumn("place", F.col("inside") + F.col("before")).select(*df.columns, "place")


def capsule_groups(df: DataFrame, as_of: str, *, days: int = 14, importance: int = 3, chunk: int = 10, least: int = 3) -> DataFrame:
    """(project, chunk, id): unprotected old rows of a project in chunks of ten, oldest first; a project needs `least` rows, a chunk two."""
    chosen = df.filter(~F.col("kind").isin(*PROTECTED_KINDS) & ~protected() & (F.col("importance") <= importance) & (age_days("updated_at", as_of) >= days))
    placed = in_order(chosen, ["project"], "updated_at", "id").withColumn("chunk", F.floor(F.col("place") / chunk))
    counts = placed.groupBy("project", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("project")))
    good = counts.filter((F.col("all") >= least) & (F.col("n") >= 2)).select(F.col("project").alias("p"), F.col("chunk").alias("c"))
    return placed.join(good, F.col("project").eqNullSafe(F.col("p")) & (F.col("chunk") == F.col("c")), "left_semi")


def compaction_due(rows: int, minutes_since: float | None) -> str | None:
    """What a store of that size should run now: "capsules" from 750 rows, "gc" from 500, nothing below or within five minutes of the last run."""
    if rows < 500 or (minutes_since is not None and minutes_since < 5):
        return None
    return "capsules" if rows >= 750 else "gc"


def session_capsules(df: DataFrame, *, top: int = 6) -> DataFrame:
    """(session_id, n, capsule) of sessions with two memories and more: the best first sentences by kind, importance and order."""
    weight = F.when(F.col("kind") == "decision", 5).when(F.col("kind").isin("architecture", "preference"), 4).when(F.col("kind").isin("bug", "milestone"), 3).otherwise(1)
    rows = df.filter("session_id is not null and kind <> 'credential'").withColumn("s", first_sentence(F.col("content"))).withColumn("v", weight + F.col("importance"))
    w = Window.partitionBy("session_id").orderBy(F.desc("v"), "created_at", "id")
    placed = rows.withColumn("r", F.row_number().over(w))
    out = placed.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "s")))).alias("x"))
    return out.filter("n >= 2").select("session_id", "n", F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["s"])), "\n").alias("capsule"))


def gc_plan(df: DataFrame, as_of: str, **options) -> DataFrame:
    """(id, action): expire, merge (into the group's summary) or keep, for every row; a dry run of a collection."""
    candidates = gc_candidates(df.filter(~expired(as_of)), as_of, **options)
    groups = candidates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("kind", "project"))).filter("n > 1").select("id", F.lit(True).alias("hit"))
    return df.join(groups, "id", "left").select("id", F.when(expired(as_of), "expire").when(F.col("hit"), "merge").otherwise("keep").alias("action"))



def inserted(df: DataFrame, key: str, text: str, bucket: list[str], time: str, threshold: float = MERGE) -> DataFrame:
    """(id, group) of every row as if the rows were inserted one by one, by time and key: a row joins an equal or similar one that stands, else it stands itself.

    A row that was merged is no row of its own any more, so what is similar to it alone stands; of several
    similar ones the earliest takes the row. Similarity is that of the texts as they came: a merged row keeps
    the words of the first, so that the result does not depend on how rows are spread. Equal word sets are one
    class, which comes in with its earliest row; classes are grouped greedily in the order of coming in. Rows
    without words join equal texts of their bucket.
    """
    placed = df.withColumn("o", F.concat(F.coalesce(F.date_format(F.col(time).cast("timestamp"), "yyyyMMddHHmmssSSSSSS"), F.lit("")), F.lit("\u0001"), F.col(key).cast("string")))
    pairs = similar_word_sets(placed, "o", text, bucket, threshold)
    groups = seed_groups(pairs).toDF("group", "id")
    named = with_copies(groups, cut(copies(placed, "o", text, bucket, wordless=True)))
    name = lambda c: F.substring_index(F.col(c), "\u0001", -1)
    known = named.select(name("id").alias("id"), name("group").alias("group"))
    return df.select(F.col(key).alias("id")).distinct().join(known, "id", "left").select("id", F.coalesce("group", "id").alias("group"))

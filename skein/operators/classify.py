"""Ordered rules over lower-cased text: kind, importance and time to live; transcripts' sentences; the language of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import count_any, normalised

# Fixed values, authored for this library: (kind, importance, days to live, pattern over lower-cased text); the first that matches wins.
RULES: list[tuple[str, int, int | None, str]] = [
    ("credential", 5, None, r"api[ _-]?key|passwor[dt]|passphrase|mot de passe|client[ _]secret|private[ _]key|access[ _]token|bearer "),
    ("architecture", 5, None, r"architectur|system design|data model|breaking change|event[- ]driven|monolith|microservice"),
    ("decision", 4, None, r"\bdecided?\b|\bdecision\b|\bd[ée]cid|choix retenu|we chose|agreed to|\bopted\b"),
    ("preference", 4, None, r"\bprefer|pr[ée]f[èe]re|would rather|always use|never use|toujours utiliser|favou?rite"),
    ("pattern", 4, None, r"\bpattern|best practice|guideline|\bconvention\b|rule of thumb"),
    ("bug", 3, 90, r"\bbugs?\b|root cause|crash|exception|deadlock|regression|\bfails?\b|\bpanne\b|cause de|outage"),
    ("todo", 2, 30, r"\btodo\b|to-do|à faire|\bneeds? to\b|il faut|follow[- ]up|remaining work"),
    ("snippet", 2, None, r"```|~~~|\bdef \w+\(|\bfn \w+\(|\bfunction \w+\(|select .+ from "),
    ("milestone", 4, None, r"shipped|released?\b|launched|deployed|livr[ée]|went live|milestone"),
    ("transcript", 2, 180, r"^\s*(?:user|assistant|system)\s?:"),
]
DEFAULT = ("fact", 3, None)


def classified(text: Column) -> Column:
    """struct<kind, importance, ttl_days>; null counts as empty, which is a plain fact."""
    low = F.lower(F.coalesce(text, F.lit("")))
    make = lambda k, i, t: F.struct(F.lit(k).alias("kind"), F.lit(i).alias("importance"), F.lit(t).cast("int").alias("ttl_days"))
    out = make(*DEFAULT)
    for kind, importance, ttl, pattern in reversed(RULES):
        out = F.when(low.rlike(pattern), make(kind, importance, ttl)).otherwise(out)
    return out


def with_expiry(df: DataFrame, created: str, explicit: Column | None = None) -> DataFrame:
    """Kind, importance and expiry of new rows; an explicit kind takes its own time to live, not the inferred one's."""
    inferred = classified(F.col("content"))
    kind = F.coalesce(explicit, inferred["kind"]) if explicit is not None else inferred["kind"]
    ttl = F.lit(None).cast("int")
    for name, _, days, _ in RULES:
        if days:
            ttl = F.when(kind == name, days).otherwise(ttl)
    return df.withColumns({"kind": kind, "importance": inferred["importance"], "expires": F.when(ttl.isNotNull(), F.timestamp_seconds(F.col(created).cast("double") + ttl * 86400))})


# Markers of French and English.
FRENCH = " le | la | les | des | une | est | pour | dans | avec | sur | pas | que ".split("|")
ENGLISH = " the | and | of | to | is | for | with | not | that | from | are | was ".split("|")


def language(text: Column) -> Column:
    """"fr", "en" or "both" by markers and accents of the whole text."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    fr = count_any(low, [f" {w.strip()} " for w in FRENCH]) + F.when(low.rlike("[àâçéèêëîïôùûœ]"), 2).otherwise(0)
    en = count_any(low, [f" {w.strip()} " for w in ENGLISH])
    return F.when(fr > 2 * en, "fr").when(en > 2 * fr, "en").otherwise("both")


# --- transcripts -------------------------------------------------------------------------------------------

#: (kind, importance, base score, pattern); the first that matches a sentence wins.
MARKERS: list[tuple[str, int, int, str]] = [
    ("decision", 4, 16, r"\bdecided\b|\bwe chose\b|on a décidé|choix retenu|agreed"),
    ("preference", 4, 15, r"\bprefer|préfère|rather use|always use"),
    ("bug", 3, 14, r"root cause|deadlock|outage|\bfails?\b|panne|cause de"),
    ("architecture", 5, 13, r"architecture|reads from|writes to|design"),
    ("pattern", 4, 12, r"pattern|convention|must not|ne pas|toujours|always run"),
    ("milestone", 4, 11, r"shipped|deployed|livré|released"),
    ("todo", 2, 9, r"todo|à faire|next step|follow up"),
]
CAPS = {"decision": 3, "preference": 3, "bug": 2, "architecture": 2, "pattern": 2, "milestone": 3, "todo": 1}
LEAST_SCORE, SELECTED = 9, 10


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn, role, at, sentence) of a transcript: lines with a role start a turn, sentences end at a mark before a blank."""
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "raw"))
    role = F.lower(F.regexp_extract("raw", r"^\s*(USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:\s*", 1))
    w = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    turns = lines.withColumn("role", F.nullif(role, F.lit(""))).withColumn("turn", F.count("role").over(w)).withColumn("role", F.last("role", ignorenulls=True).over(w))
    body = F.trim(F.regexp_replace("raw", r"^\s*(?:USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:\s*|^\s*[-*]\s+", ""))
    cut = F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return turns.select("key", "turn", "role", (F.col("line") * 1000).alias("base"), F.posexplode(cut).alias("n", "sentence")).select("key", "turn", "role", (F.col("base") + F.col("n")).alias("at"), F.trim("sentence").alias("sentence")).filter("sentence <> ''")


def clean_segment(s: Column) -> Column:
    """Whether a sentence can stand alone: 24 to 260 characters, no address, no fence, mostly letters."""
    marks = F.length(F.regexp_replace(s, r"[\p{L}\p{N}\s]", ""))
    return F.length(s).between(24, 260) & ~s.rlike(r"https?://|```|~~~|^\s*[{}<$>]|^\d{4}-\d\d-\d\d") & (marks * 3 <= F.length(s))


def distilled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, importance, score, sentence, place): the statements worth keeping of each transcript.

    Questions and scores below LEAST_SCORE fall out; equal statements count once (the first); at most CAPS of a
    kind and SELECTED in all, by score, importance, length and place.
    """
    s = F.lower("sentence")
    make = lambda k, i, b: F.struct(F.lit(k).alias("kind"), F.lit(i).alias("importance"), F.lit(b).alias("base"))
    best = F.lit(None)
    for kind, importance, base, pattern in reversed(MARKERS):
        best = F.when(s.rlike(pattern), make(kind, importance, base)).otherwise(best)
    bonus = F.when(s.rlike(r"\d"), 1).otherwise(0) + F.when(s.rlike(r"because|car |since|parce"), 2).otherwise(0) + F.when(F.col("role") == "user", 1).otherwise(0)
    rows = segments(df, key, text).filter(clean_segment(F.col("sentence")) & ~F.col("sentence").endswith("?")).withColumn("m", best).filter("m is not null")
    scored = rows.select("key", "at", "sentence", "m.kind", "m.importance", (F.col("m.base") + bonus).alias("score")).filter(F.col("score") >= LEAST_SCORE)
    first = Window.partitionBy("key", normalised(F.col("sentence"))).orderBy("at")
    once = scored.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    order = [F.desc("score"), F.desc("importance"), F.desc(F.length("sentence")), F.asc("at")]
    cap = F.lit(1)
    for kind, n in CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    kept = once.withColumn("r", F.row_number().over(Window.partitionBy("key", "kind").orderBy(*order))).filter(F.col("r") <= cap).drop("r")
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return placed.filter(F.col("place") <= SELECTED).select("key", "kind", "importance", "score", "sentence", "place")

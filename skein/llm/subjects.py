"""Problem 8: the subject areas of documents.

Method: weak labels and an accuracy-learning latent model. Four labelling functions vote on every sentence,
or abstain: a lexicon (words whose sentences belong to one subject), addresses (words inside web addresses,
paths and mail hosts), sections (the heading above) and the source (what its labelled documents are about);
hand labels vote where a document has a single one. An EM fit over the counts of vote patterns learns how
often each function errs and abstains; the posteriors of its sentences are summed up, and a document has the
subjects that make up enough of the sum. Texts are tokenized once; all passes read the stored words.

The lexicon is learned from all hand-labelled documents and then again from the sentences of all documents
under the first lexicon, in every language of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread, stored

#: Part of the sentences that makes a subject of a document.
SHARE = 0.25
#: Sentences that the sum of posteriors may lack, since no function is quite sure.
SLACK = 0.1
#: Most words of a lexicon, the most frequent ones; this bounds what is broadcast.
WORDS = 100_000
#: A word tells a subject if it has this part of the word's sentences, odds this many times its usual ones, and this many sentences.
PURE, LIFT, SEEN = 0.5, 2.5, 3
#: How often the lexicon is learned again from the sentences of all documents.
ROUNDS = 2
FUNCTIONS = ("lexicon", "address", "section", "source", "label")
#: How often a function may vote on a sentence without a subject. Votes of one function alone do not tell this from how common
#: the subjects are, so it is bounded: words of a lexicon hardly ever, a source or a document's label as often as not.
LOUD = (0.02, 0.05, 0.1, 0.9, 0.9)

FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
LEAD = re.compile(r"\s*(?:(?:[-*>•]|\d+[.)])\s+|(?:USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:\s+|\[[A-Z_]+:\d+\]\s*)+")
BREAK = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+")
WORD = regex.compile(r"\p{L}{3,}")
ADDRESS = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+|\S+@[\w-]+(?:\.[\w-]+)+|(?<!\w)(?:[\w.-]+/){1,}[\w.-]+")
HIDDEN = re.compile("[​‌‍⁠﻿­]")


def sentences(text: str | None) -> list[tuple[str, str]]:
    """(sentence, heading above it) of a text; code, headings and marks of lists and turns are no sentences."""
    if not text:
        return []
    if not text.isascii():
        text = HIDDEN.sub("", text)
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    out, heading = [], ""
    for line in text.split("\n"):
        lead = LEAD.match(line)
        line = (line[lead.end() :] if lead else line).strip()
        if line.startswith("#"):
            heading = line.lstrip("# ")
        elif line:
            out += [(s, heading) for s in BREAK.split(line) if s.strip()]
    return out


def words(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


#: Between the words of a sentence, those of its addresses, and the number of its heading.
FIELD = "\x1f"


def told(text: str | None) -> tuple[str, str]:
    """(sentences, headings) of a text as words: a line for each, a sentence's with FIELDs."""
    lines, headings = [], {"": 0}
    for s, heading in sentences(text):
        found = words(s)
        inside = {w for a in ADDRESS.findall(s) for w in words(a)} if "/" in s or "@" in s or "www." in s else set()
        lines.append(f"{' '.join(sorted(found - inside))}{FIELD}{' '.join(sorted(inside))}{FIELD}{headings.setdefault(heading, len(headings))}")
    return "\n".join(lines), "\n".join(" ".join(sorted(words(h))) for h in headings)


class Lexicon:
    """Words with their log odds by subject."""

    def __init__(self, odds: dict[str, np.ndarray], subjects: int) -> None:
        self.number = {w: i for i, w in enumerate(odds)}
        self.odds = np.array([*odds.values()], np.float64).reshape(len(odds), subjects) if odds else np.zeros((0, subjects))

    def votes(self, lines: list[list[str]]) -> np.ndarray:
        """The subject that the known words of each line speak for, by summed log odds; -1: none."""
        get = self.number.get
        at = [[i for w in line if (i := get(w)) is not None] for line in lines]
        size = np.fromiter(map(len, at), np.int64, len(at))
        out = np.full(len(at), -1, np.int64)
        some = np.flatnonzero(size)
        if len(some):
            flat = np.fromiter((i for x in at for i in x), np.int64, int(size.sum()))
            score = np.add.reduceat(self.odds[flat], np.cumsum(size[some]) - size[some], axis=0)
            best = score.argmax(axis=1)
            out[some] = np.where(score[np.arange(len(some)), best] > 0.7, best, -1)
        return out


def _counted(parts: DataFrame, subjects: int) -> dict[str, np.ndarray]:
    """The lexicon of (word, subject, n): log odds against the usual ones, by subject, of the telling words. Subject number `subjects` is none."""
    total = {r["subject"]: r["n"] for r in parts.groupBy("subject").agg(F.sum("n").alias("n")).collect()}  # at most subjects + 1 rows
    prior = np.array([total.get(k, 0.0) + 1e-6 for k in range(subjects + 1)])
    prior /= prior.sum()
    wide = parts.groupBy("word").agg(F.sum("n").alias("seen"), *(F.sum(F.when(F.col("subject") == k, F.col("n")).otherwise(0.0)).alias(f"s{k}") for k in range(subjects + 1)))
    part = [(F.col(f"s{k}") + F.lit(float(prior[k]))) / (F.col("seen") + 1) for k in range(subjects)]
    telling = F.lit(False)
    for k in range(subjects):
        odds = LIFT * float(prior[k] / max(1 - prior[k], 1e-9))
        telling = telling | ((part[k] >= PURE) & (part[k] >= F.lit(odds / (1 + odds))))
    rows = wide.filter((F.col("seen") >= SEEN) & telling).orderBy(F.desc("seen"), "word").limit(WORDS).collect()
    out = {}
    for r in rows:
        q = (np.array([r[f"s{k}"] for k in range(subjects)]) + prior[:subjects]) / (r["seen"] + 1)
        q, usual = np.clip(q, 1e-2, 0.99), np.clip(prior[:subjects], 1e-6, 0.99)
        out[r["word"]] = np.log(q / (1 - q)) - np.log(usual / (1 - usual))
    return out


def _merge(parts: dict[int, Counter]) -> pa.RecordBatch:
    """Counts of words by subject, as rows."""
    return pa.RecordBatch.from_arrays(
        [pa.array([w for c in parts.values() for w in c], pa.string()), pa.array([k for k, c in parts.items() for _ in range(len(c))], pa.int32()), pa.array([n for c in parts.values() for n in c.values()], pa.float64())],
        ["word", "subject", "n"],
    )


def latent(patterns: list[tuple[tuple[int, ...], float]], subjects: int, rounds: int = 100) -> dict[tuple[int, ...], np.ndarray]:
    """Posterior over the subjects and none of every vote pattern, by EM.

    A function has, of sentences with a subject, a chance to abstain and one to be right (errors spread evenly),
    and of sentences without one a chance to vote at all.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], np.float64)
    m, j = votes.shape
    silent, right, loud = np.full(j, 0.3), np.full(j, 0.85), np.array(LOUD[:j])
    right[3] = 0.4  # a source says little
    prior = np.full(subjects + 1, 0.6 / subjects)
    prior[subjects] = 0.4
    post = np.zeros((m, subjects + 1))
    for _ in range(rounds):
        log = np.tile(np.log(prior), (m, 1))
        for f in range(j):
            v = votes[:, f]
            some = v >= 0
            for y in range(subjects):
                log[:, y] += np.log(np.where(some, (1 - silent[f]) * np.where(v == y, right[f], (1 - right[f]) / max(1, subjects - 1)), silent[f]))
            log[:, subjects] += np.log(np.where(some, loud[f] / subjects, 1 - loud[f]))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        w = post * n[:, None]
        with_subject, without = w[:, :subjects].sum() + 1, w[:, subjects].sum() + 1
        prior = (w.sum(axis=0) + 1) / (w.sum() + subjects + 1)
        for f in range(j):
            v = votes[:, f]
            some = v >= 0
            hit = w[np.flatnonzero(some), v[some]].sum()
            said = w[some][:, :subjects].sum()
            # Beta priors keep what the data do not tell near the start; a lexicon vote is taken for right more often than not
            right[f] = np.clip((hit + 8) / (said + 10), 1.5 / subjects, 0.995)
            silent[f] = np.clip(1 - said / with_subject, 0.01, 0.99)
            loud[f] = np.clip((w[some, subjects].sum() + 0.5) / without, 0.001, LOUD[f])
    return {p: post[i] for i, (p, _) in enumerate(patterns)}


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, *, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share) of every document's subjects; documents without one give no row.

    labels: (doc_id, subject), codes in any case and with blanks; unknown codes, none and null stand for no
    subject. Null, empty and blank texts have no sentences and so no subject; repeated rows count once; labels
    of documents that do not exist count for nothing. Without labels the lexicon starts from the titles and
    descriptions of the areas alone.
    """
    spark = documents.sparkSession
    rows = areas.select(F.lower(F.trim("subject")).alias("s"), F.concat_ws(" ", "title", "description").alias("d")).filter("s is not null and s <> ''").groupBy("s").agg(F.min("d").alias("d")).orderBy("s").collect()  # the codes to assign, a fixed few
    codes = [r["s"] for r in rows]
    count = len(codes)
    docs = documents.select("doc_id", "text", "source")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # then the texts need not be shuffled
        unique = docs
    else:
        unique = docs.dropDuplicates(["doc_id"])
    kind = documents.schema["doc_id"].dataType.simpleString()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, heads = zip(*map(told, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(lines, pa.string()), pa.array(heads, pa.string())], ["doc_id", "source", "lines", "heads"])

    docs = stored(spread(unique).mapInArrow(tokenized, f"doc_id {kind}, source string, lines string, heads string"))
    known = F.create_map(*(x for k, s in enumerate(codes) for x in (F.lit(s), F.lit(k)))) if codes else F.lit(None)
    marked = labels.select("doc_id", F.coalesce(known[F.lower(F.trim("subject"))] if codes else F.lit(None).cast("int"), F.lit(count)).alias("k"))
    per_doc = stored(marked.groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("ks")).select("doc_id", F.when(F.size("ks") > 1, F.array_remove("ks", count)).otherwise(F.col("ks")).alias("ks")))
    seeds: dict[str, np.ndarray] = {}
    for k, r in enumerate(rows):
        for w in (w for w in words(r["d"] or "") if len(w) > 5):
            seeds.setdefault(w, np.full(count, -1.0))[k] = 2.0
    seeds = {w: v for w, v in seeds.items() if (v > 0).sum() == 1}

    def split(lines: str) -> list[list[str]]:
        return [line.partition(FIELD) for line in lines.split("\n")] if lines else []

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, Counter] = defaultdict(Counter)
            for lines, ks in zip(batch.column("lines").to_pylist(), batch.column("ks").to_pylist(), strict=True):
                seen = Counter(w for line, _, rest in split(lines) for w in (line + " " + rest.partition(FIELD)[0]).split())
                for k in ks:
                    for w, n in seen.items():
                        parts[k][w] += n / len(ks)
            yield _merge(parts)

    def again(lexicon):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts: dict[int, Counter] = defaultdict(Counter)
                every = [(line + " " + rest.partition(FIELD)[0]).split() for lines in batch.column("lines").to_pylist() for line, _, rest in split(lines)]
                for line, k in zip(every, lexicon.value.votes(every), strict=True):
                    parts[int(k) if k >= 0 else count].update(line)
                yield _merge(parts)

        return run

    schema = "word string, subject int, n double"
    from_labels = docs.join(per_doc, "doc_id").select("lines", "ks").mapInArrow(first, schema).groupBy("word", "subject").agg(F.sum("n").alias("n"))
    lexicon = _counted(stored(from_labels), count) or seeds
    for _ in range(ROUNDS):
        everything = docs.select("lines").mapInArrow(again(spark.sparkContext.broadcast(Lexicon(lexicon, count))), schema).groupBy("word", "subject").agg(F.sum("n").alias("n"))
        lexicon = _counted(stored(everything), count) or lexicon
    # what the labelled documents of a source are about, if one subject stands out
    about = docs.join(per_doc, "doc_id").select(F.lower(F.trim("source")).alias("source"), F.explode("ks").alias("k")).filter("source is not null")
    ranked = about.groupBy("source", "k").count().groupBy("source").agg(F.max_by("k", "count").alias("k"), F.max("count").alias("most"), F.sum("count").alias("all"))
    source_vote = ranked.filter((F.col("all") >= 5) & (F.col("most") >= 0.5 * F.col("all")) & (F.col("k") < count)).select("source", F.col("k").alias("source_k"))

    shared = spark.sparkContext.broadcast(Lexicon(lexicon, count))  # at most WORDS words

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            docs, heads = batch.column("lines").to_pylist(), batch.column("heads").to_pylist()
            size = [len(split(x)) for x in docs]
            parts = [(a, *c.split(FIELD)) for x in docs for a, _, c in split(x)]
            word, address = lexicon.votes([a.split() for a, _, _ in parts]), lexicon.votes([b.split() for _, b, _ in parts])
            above = [h.split("\n") for h in heads]
            headings = lexicon.votes([h.split() for x in above for h in x])
            start, at = np.cumsum([0, *map(len, above)]), 0
            out: tuple[list, list, list] = ([], [], [])
            for i, (doc, source, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source_k", "label_k")), strict=True)):
                patterns = Counter((int(word[j]), int(address[j]), int(headings[start[i] + int(parts[j][2])]), source, label) for j in range(at, at + size[i]))
                at += size[i]
                for p, n in patterns.items():
                    out[0].append(doc)
                    out[1].append(list(p))
                    out[2].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_id").type), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.int64())], ["doc_id", "votes", "n"])

    single = per_doc.filter((F.size("ks") == 1) & (F.element_at("ks", 1) < count)).select("doc_id", F.element_at("ks", 1).alias("label_k"))
    ready = (
        docs.withColumn("source", F.lower(F.trim("source")))
        .join(source_vote, "source", "left")
        .join(single, "doc_id", "left")
        .select("doc_id", "lines", "heads", F.coalesce("source_k", F.lit(-1)).alias("source_k"), F.coalesce("label_k", F.lit(-1)).alias("label_k"))
    )
    voted = stored(ready.mapInArrow(votes, f"doc_id {kind}, votes array<int>, n long"))
    patterns = [(tuple(r["votes"]), float(r["n"])) for r in voted.groupBy("votes").agg(F.sum("n").alias("n")).collect()]  # at most (subjects + 1)^5, whatever the corpus
    posterior = latent(sorted(patterns), count)
    table = spark.createDataFrame([(list(p), k, float(x)) for p, q in sorted(posterior.items()) for k, x in enumerate(q[:count]) if x > 1e-4], "votes array<int>, k int, q double")
    summed = voted.join(F.broadcast(table), "votes").groupBy("doc_id", "k").agg(F.sum(F.col("n") * F.col("q")).alias("n"))
    whole = voted.groupBy("doc_id").agg(F.sum("n").alias("total"))
    found = summed.join(whole, "doc_id").withColumn("share", F.col("n") / F.col("total")).filter(F.col("n") + SLACK >= F.col("total") * share)
    names = F.array(*(F.lit(s) for s in codes)) if codes else F.array().cast("array<string>")
    return found.select("doc_id", F.element_at(names, F.col("k") + 1).alias("subject"), "share")

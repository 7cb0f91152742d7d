"""Problem 5: pieces of at most a given size, cut at natural boundaries, with overlap.

Method: one pass over the text gives the token offsets with the prefix sums of their sizes, and a sorted
array of boundaries for each strength. A cut is the last boundary under the limit, found by binary search,
of the strongest kind that leaves a piece of useful size; without any, a hard cut. The next piece steps back
by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

#: Largest piece and overlap, in characters.
LIMIT, OVERLAP = 2000, 200
#: A natural cut has to leave at least this part of the limit, else the next weaker kind is taken.
LEAST = 0.4

TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
SENTENCE = re.compile(r"[.!?…。！？]+[)\]\"'»”’]*\s+")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}\s")
TURN = re.compile(r"[ \t]*(?:[A-Z][A-Z_]{2,15}|User|Assistant|System|Human)\s?:\s")


class Line(NamedTuple):
    start: int  # offset of its first character
    end: int  # offset behind its last character, without carriage returns and the newline
    fence: str  # the three characters that make it a fence, or ""
    blank: bool


def lines_of(text: str) -> list[Line]:
    out, start = [], 0
    for raw in text.split("\n"):
        body = raw.rstrip("\r")
        bare = body.lstrip(" \t")
        mark = bare[:3]
        out.append(Line(start, start + len(body), mark if mark in ("```", "~~~") else "", not bare))
        start += len(raw) + 1
    return out


def blocks_of(lines: list[Line]) -> list[tuple[int, int, int]]:
    """(first line, last line, size) of each block, lines counted from 0.

    A fence opens a block that runs to the next fence of the same characters or to the end; elsewhere a block
    is a run of lines that are neither blank nor fences. The size is that of the lines and the newlines between.
    """
    out, first, size, fence = [], -1, 0, ""
    for n, line in enumerate(lines):
        length = line.end - line.start
        if fence:
            size += 1 + length
            if line.fence == fence:
                out.append((first, n, size))
                first, fence = -1, ""
        elif line.blank or line.fence:
            if first >= 0:
                out.append((first, n - 1, size))
                first = -1
            if line.fence:
                first, size, fence = n, length, line.fence
        elif first < 0:
            first, size = n, length
        else:
            size += 1 + length
    if first >= 0:
        out.append((first, len(lines) - 1, size))
    return out


class Boundaries:
    """The sorted offsets at which a text may be cut, strongest kind first, and its token prefix sums."""

    def __init__(self, text: str) -> None:
        self.lines = lines_of(text)
        self.blocks = blocks_of(self.lines)
        strong, inside = {self.lines[a].start for a, _, _ in self.blocks}, set()
        fenced = [(a, b) for a, b, _ in self.blocks if self.lines[a].fence]
        at, k = {x.start for x in self.lines}, 0
        for n, line in enumerate(self.lines):
            while k < len(fenced) and fenced[k][1] < n:
                k += 1
            code = k < len(fenced) and fenced[k][0] < n
            if not code and (HEADING.match(text, line.start) or TURN.match(text, line.start)):
                strong.add(line.start)
            if code:
                inside.add(line.start)
        #: Ends of tokens are the prefix sums of the token sizes.
        self.ends = [m.end() for m in TOKEN.finditer(text)]
        self.kinds = [sorted(strong), sorted(at - inside), sorted(m.end() for m in SENTENCE.finditer(text)), sorted(at)]

    def cut(self, start: int, least: int, most: int) -> int:
        """The end of the piece that starts at start and may reach to most."""
        for kind in self.kinds:
            k = bisect_right(kind, most) - 1
            if k >= 0 and kind[k] >= least and kind[k] > start:
                return kind[k]
        k = bisect_right(self.ends, most) - 1
        return self.ends[k] if k >= 0 and self.ends[k] >= least and self.ends[k] > start else most

    def back(self, start: int, end: int, overlap: int) -> int:
        """Where the next piece starts: the first natural place within the overlap, never at or before start."""
        low = max(start + 1, end - overlap)
        for kind in (self.kinds[1], self.kinds[2], self.ends):
            k = bisect_left(kind, low)
            if k < len(kind) and kind[k] < end:
                return kind[k]
        return low if overlap else end


def _whole(text: str, at: int, start: int) -> int:
    """A hard cut never parts CR from LF or a mark or joiner from what it belongs to, if it can be helped."""
    k = at
    while start < k < len(text) and (text[k - 1 : k + 1] == "\r\n" or text[k] in "‍️" or text[k - 1] == "‍" or "̀" <= text[k] <= "ͯ"):
        k -= 1
    return k if k > start else at


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, marks: Boundaries | None = None) -> list[tuple[int, int]]:
    """(start, end) offsets of the pieces. A text within the limit is one piece; an empty text is none.

    Every piece but the first starts with up to overlap characters of the end of the one before, and the
    pieces without their overlaps are the text.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap has to be less than half of the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    marks, out, start, done = marks or Boundaries(text), [], 0, 0
    while len(text) - start > limit:
        most = start + limit
        end = marks.cut(start, max(done + 1, start + int(limit * LEAST)), most)
        if end == most:
            end = max(_whole(text, most, start), done + 1)
        out.append((start, end))
        done, start = end, min(end, marks.back(start, end, overlap))
    out.append((start, len(text)))
    return out


def _batches(df: DataFrame, key: str, text: str, first_line: str | None, schema: str, rows) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(df[key].alias("key"), df[text].alias("text"), (df[first_line] if first_line else F.lit(1)).cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, firsts = (batch.column(i).to_pylist() for i in range(3))
            out = [(k, *r) for k, t, f in zip(keys, texts, firsts, strict=True) for r in rows(t, 1 if f is None else f)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.types[0], *types], strict=True)], names)

    fields = [x.strip().split(" ") for x in schema.split(",")]
    names = ["key", *(n for n, _ in fields)]
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t] for _, t in fields]
    return chosen, run, f"key {kind}, {schema}"


def split_items(df: DataFrame, key: str, text: str, first_line: str | None = None, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, text, start_line, end_line) of every item over the limit, in characters.

    Items within the limit, empty and null ones give no row. Lines count from first_line (null: 1). Items of
    equal key stay apart only as far as their rows differ: give distinct rows if a key repeats.
    """

    def rows(t: str, first: int):
        starts = [x.start for x in lines_of(t)]
        line = lambda at: first + bisect_right(starts, at) - 1
        return [(n, t[a:b], line(a), line(b - 1)) for n, (a, b) in enumerate(pieces(t, limit, overlap))]

    long = df.filter(F.length(df[text]) > limit)
    chosen, run, schema = _batches(long, key, text, first_line, "piece_no int, text string, start_line bigint, end_line bigint", rows)
    return spread(chosen).mapInArrow(run, schema).withColumnRenamed("key", key)


def oversized_blocks(df: DataFrame, key: str, text: str, first_line: str | None = None, *, limit: int = LIMIT) -> DataFrame:
    """(key, line_no) of the first line of every block that split_items has to cut inside, because it alone is over the limit.

    The cuts of the pieces are looked up in the sorted blocks; a block may also be cut for want of a better
    place, so those within the limit are then left out. A block over the limit always holds a cut, since no
    piece reaches from its first to its last character.
    """

    def rows(t: str, first: int):
        marks = Boundaries(t)
        ends = [b for _, b in pieces(t, limit, min(OVERLAP, (limit - 1) // 2), marks)]
        for a, b, size in marks.blocks:
            k = bisect_right(ends, marks.lines[a].start)
            if k < len(ends) and ends[k] < marks.lines[b].end and size > limit:
                yield (first + a,)

    long = df.filter(F.length(df[text]) > limit)
    chosen, run, schema = _batches(long, key, text, first_line, "line_no bigint", rows)
    return spread(chosen).mapInArrow(run, schema).withColumnRenamed("key", key)

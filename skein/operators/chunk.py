"""Chunks of long texts for indexing: packed paragraphs, sentences of oversized ones, code at its definitions."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target size of a chunk, the size beyond which one paragraph is cut by sentences, and the size of these.
TARGET, OVERSIZED, SENTENCES = 2_000, 4_096, 1_200
CODE_LINE = re.compile(r"^\s*(?:def |class |fn |pub |func |function |import |from \w+ import|const |let |var |#include|package |export |async |@\w+|\}|return\b|if .*[:{]$|for .*[:{]$|SELECT |CREATE )")
DEFINITION = re.compile(r"^(?:async def |def |class |(?:pub )?(?:async )?fn |(?:pub )?(?:struct|enum|trait|impl)\b|func |(?:export )?(?:default )?(?:async )?function |(?:export )?class |(?:public|private|protected|internal) |interface |type )")


def overlap_of(target: int) -> int:
    return min(max(target // 6, 120), 400, target // 3)


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text), lines from 1: parted at blank lines and headings; a fence is one block."""
    out, buffer, first, fence = [], [], 1, ""
    lines = text.replace("\r\n", "\n").split("\n")

    def flush(last: int) -> None:
        if buffer and any(x.strip() for x in buffer):
            out.append((first, last, "\n".join(buffer)))
        buffer.clear()

    for n, line in enumerate(lines, 1):
        mark = line.lstrip()[:3]
        if fence:
            buffer.append(line)
            if mark == fence:
                flush(n)
                fence = ""
            continue
        if mark in ("```", "~~~"):
            flush(n - 1)
            first, fence = n, mark
            buffer.append(line)
        elif not line.strip():
            flush(n - 1)
        elif line.startswith("#"):
            flush(n - 1)
            first = n
            buffer.append(line)
        else:
            if not buffer:
                first = n
            buffer.append(line)
    flush(len(lines))
    return out


def by_sentences(text: str, size: int = SENTENCES) -> list[str]:
    """Pieces of at most size characters, cut behind sentences, else blanks, else hard."""
    out, at = [], 0
    while len(text) - at > size:
        window = text[at : at + size]
        cut = max((m.end() for m in re.finditer(r"[.!?;]\s+|\n", window)), default=0) or window.rfind(" ") + 1 or size
        out.append(text[at : at + cut])
        at += cut
    return [*out, text[at:]] if text[at:] else out


def chunked(text: str | None, target: int = TARGET) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of chunks near the target, each after the first with the end of the one before."""
    target = max(target, 512)
    if not text or not text.strip():
        return []
    if len(text) <= target:
        return [(text, 1, text.count("\n") + 1)]
    units: list[tuple[int, int, str]] = []
    for a, b, t in blocks(text):
        units += [(a, b, t)] if len(t) <= OVERSIZED else [(a, b, p) for p in by_sentences(t)]
    out: list[tuple[str, int, int]] = []
    held, first, last, fresh = "", 0, 0, False
    for a, b, t in units:
        if fresh and len(held) + 2 + len(t) > target:
            out.append((held, first, last))
            tail = held[-overlap_of(target) :]
            held = tail[tail.find(" ") + 1 :] if " " in tail else tail
            first, fresh = last, False
        held = held + "\n\n" + t if held else t
        first, last, fresh = (first or a) if held != t else a, b, True
    if fresh:
        out.append((held, first, last))
    return out


def looks_like_code(text: str) -> bool:
    return sum(bool(CODE_LINE.match(x)) for x in text.split("\n")[:80]) >= 2


#: What starts an item of a language at the outermost level, after modifiers.
ITEM = {
    "rust": r"(?:pub(?:\([^)]*\))? |async |unsafe |const |extern \"\w+\" |default )*(?:fn|impl|struct|enum|trait|mod|union|static|const|type|macro_rules!)[\s<!]",
    "go": r"(?:func|type|var|const)[\s(]",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp) )*(?:class|interface|enum|record|@interface) ",
    "kotlin": r"(?:(?:public|private|internal|protected|open|abstract|sealed|data|suspend|inline|override|enum|annotation|value|operator|infix|tailrec|const|lateinit|companion) )*(?:fun|class|object|interface|typealias|val|var)[\s<]",
    "swift": r"(?:(?:public|private|internal|fileprivate|open|final|static|mutating|override|indirect|@\w+) )*(?:func|class|struct|enum|protocol|extension|actor|typealias|let|var) ",
    "typescript": r"(?:export (?:default )?)?(?:declare )?(?:abstract )?(?:async )?(?:function\*?|class|interface|type|enum|namespace|const|let|var)[\s{]",
}
ITEM = {k: re.compile(v) for k, v in ITEM.items()}
#: What only that language has, in the order in which it is looked for; two marks of JavaScript tell it from prose.
TOLD = [
    ("svelte", re.compile(r"(?is)<script\b[^>]*>.*?</script>")),
    ("go", re.compile(r"(?ms)\A(?=.*^package \w+\s*$)(?=.*^(?:func |import \())")),
    ("kotlin", re.compile(r"(?m)^\s*(?:[a-z]+ )*fun (?:<\w+> ?)?[\w.]+\(|^\s*(?:data|sealed) class \w")),
    ("rust", re.compile(r"(?m)^\s*(?:pub(?:\([^)]*\))? )?(?:async )?fn \w+\s*[<(]|^impl\b|^use \w+(?:::\w+)+")),
    ("java", re.compile(r"(?m)^package [\w.]+;|^import (?:static )?[\w.]+(?:\.\*)?;|^(?:public |final |abstract )+(?:class|interface|enum|record) \w")),
    ("swift", re.compile(r"(?m)^import (?:Foundation|SwiftUI|UIKit|Combine)\b|^\s*(?:[a-z@A-Z]+ )*func \w+\s*[<(].*\{\s*$")),
    ("typescript", re.compile(r"(?m)^(?:export |async )*(?:function\*?|class|interface|type|enum|const|let|var) \w+.*[{=(;]\s*|^import .* from ['\"]")),
]
#: Comments, literals, brackets, ends of lines. A quote is a literal of one character where the language says so, else of one line.
LEXED = r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\\n])*\"|{quote}|`(?:\\.|[^`\\])*`|[{{}}()\[\]]|\n"
QUOTE = {"typescript": r"'(?:\\.|[^'\\\n])*'", "other": r"'(?:\\[^\n]{{1,8}}?|[^'\\\n])'"}
LEXED = {k: re.compile(LEXED.format(quote=q), re.S) for k, q in QUOTE.items()}
LEADING = re.compile(r"\s*(?://|/\*|\*|#\[|@\w)")


def code_language(text: str) -> str | None:
    """The language of a text of code: python if it parses so, else by marks that only one language has; None if nothing tells."""
    try:
        body = ast.parse(text).body
        if any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Import | ast.ImportFrom) for n in body):
            return "python"
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return next((name for name, mark in TOLD if mark.search(text)), None)


def braced_starts(text: str, language: str) -> list[int] | None:
    """Lines, from 1, at which the outermost items of a language with braces start, with the comments and attributes above them; None if brackets do not match."""
    open_ = {")": "(", "]": "[", "}": "{"}
    stack: list[str] = []
    lines, outer = text.split("\n"), [True]
    for m in LEXED["typescript" if language == "typescript" else "other"].finditer(text):
        token = m[0]
        if token in "([{":
            stack.append(token)
        elif token in open_:
            if not stack or stack.pop() != open_[token]:
                return None
        else:  # ends of lines, in literals and comments too
            inside = token != "\n"
            outer += [not stack and not inside] * token.count("\n")
    if stack:
        return None
    starts = []
    for n, line in enumerate(lines):
        if outer[n] and ITEM[language].match(line):
            while n and lines[n - 1].strip() and LEADING.match(lines[n - 1]) and n not in starts:
                n -= 1
            starts.append(n + 1)
    return starts


def item_starts(text: str) -> list[int]:
    """Lines, from 1, before which code is cut."""
    language = code_language(text)
    starts: list[int] | None = None
    if language == "python":
        starts = [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in ast.parse(text).body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    elif language == "svelte":  # the script is cut like the language it is in, the markup is an item
        starts = []
        for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script>[^\n]*\n?", text):
            first, inner = text.count("\n", 0, m.start(1)) + 1, m[1].strip("\n")
            lead = text.count("\n", m.start(1), m.start(1) + m[1].find(inner[:1])) if inner else 0
            starts += [1 + text.count("\n", 0, m.start()), *(first + lead - 1 + n for n in (braced_starts(inner, "typescript") or [])), 1 + text.count("\n", 0, m.end())]
    elif language:
        starts = braced_starts(text, language)
    return starts or [n for n, x in enumerate(text.split("\n"), 1) if DEFINITION.match(x)]


def code_units(text: str, least: int = 200) -> list[tuple[str, int, int]]:
    """Code cut before its outermost items, small units joined.

    Python is cut by its syntax tree; Rust, Go, Java, Kotlin, Swift, TypeScript, JavaScript and the scripts of
    Svelte by a lexer that knows strings, comments and brackets; what does not parse or match, by line starts.
    """
    lines = text.split("\n")
    starts = item_starts(text)
    out: list[tuple[str, int, int]] = []
    cuts = sorted({1, *(n for n in starts if 1 <= n <= len(lines))}) + [len(lines) + 1]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        piece = "\n".join(lines[a - 1 : b - 1])
        if out and (len(out[-1][0]) < least or len(piece) < least):
            out[-1] = (out[-1][0] + "\n" + piece, out[-1][1], b - 1)
        else:
            out.append((piece, a, b - 1))
    return [x for x in out if x[0].strip()]


def chunks(df: DataFrame, key: str, text: str, *, target: int = TARGET, code: bool = False) -> DataFrame:
    """(key, n, text, start_line, end_line) of every chunk; null and blank texts have none. code: cut code at definitions where a text looks like it."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, n, *c) for i, t in enumerate(texts) for n, c in enumerate(code_units(t) if code and t and looks_like_code(t) else chunked(t, target))]
            at, *rest = zip(*rows, strict=True) if rows else ((),) * 5
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(rest, types, strict=True))], ["key", "n", "text", "start_line", "end_line"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n int, text string, start_line int, end_line int").withColumnRenamed("key", key)

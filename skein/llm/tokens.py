"""Problem 6: the token ids of every text by a public byte-level BPE vocabulary.

Method: a bounded-lookahead streaming transducer. The merge list gives, once, (a) for every token the spine
of merges along its left and right edge, hence whether two tokens may stand side by side, and (b) the
lookahead after which no later byte can change an earlier boundary. Reading a piece byte by byte, the
transducer keeps the last token of every prefix within one window; the token chain behind the lookahead is
stable and is emitted, so memory does not grow with the piece. Decoding goes through an incremental
byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import io
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skein.session import spread

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces remembered per worker; the memory is emptied when full, so it is bounded.
MEMO = 1 << 18
#: Longer pieces are not remembered.
MEMO_BYTES = 64
#: Bytes of a piece that the transducer is given at once.
CHUNK = 4_096


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public vocabulary lies: folder, else SKEIN_TOKENIZERS, else the installed package."""
    return os.path.join(folder or os.environ.get("SKEIN_TOKENIZERS") or "/opt/tokenizers", name)


class Transducer:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.id_of = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {v: k for k, v in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        #: By last byte, the lengths of the tokens that end with it, longest first.
        lengths: dict[int, set[int]] = {}
        for token in self.id_of:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.id_of.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.halves[rank] = self._halves(token, rank)
        self.merge = {pair: rank for rank, pair in self.halves.items()}
        self.lookahead = self._lookahead()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what merging by all lower ranks leaves of it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.id_of.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                raise ValueError(f"token {rank} cannot be reached by merges")
            low = min(found)[0]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.id_of.get(parts[i] + parts[i + 1]) == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return self.id_of[parts[0]], self.id_of[parts[1]]

    def _lookahead(self) -> int:
        """Bytes after which an earlier boundary cannot change any more.

        A later byte reaches back only through a chain of merges of falling priority, each taking away the
        right operand of the next one to the left. The longest such chain, in bytes, is found over the merge
        list from the lowest priority up.
        """
        reach: dict[int, int] = {}
        most = self.longest
        for rank in sorted(self.halves, reverse=True):
            left, right = self.halves[rank]
            chain = len(self.bytes_of[left]) + reach.get(left, 0)
            most = max(most, chain + len(self.bytes_of[right]))
            reach[right] = max(reach.get(right, 0), chain)
        return most

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge, each with the rank of the merge that takes it up."""
        out, above = [], float("inf")
        while True:
            out.append((token, above))
            if token not in self.halves:
                return out
            above, token = token, self.halves[token][side]

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary comes before the merges that make the two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = True
            ends = self._spine(left, 1)
            for b, over_b in self._spine(right, 0):
                for a, over_a in ends:
                    rank = self.merge.get((a, b))
                    if rank is not None and rank < over_a and rank <= over_b:
                        known = False
            if len(self.fits) >= MEMO:
                self.fits.clear()
            self.fits[key] = known
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that arrives in chunks; each is given out as soon as it is stable."""
        window = bytearray()  # the bytes since the last stable boundary
        last: list[tuple[int, int]] = []  # of every prefix of the window: its last token and that token's length
        before = -1  # the token before the window
        id_of, hold = self.id_of, self.lookahead + self.longest
        for chunk in chunks:
            for byte in chunk:
                window.append(byte)
                end = len(window)
                for n in self.lengths[byte]:
                    if n > end:
                        continue
                    token = id_of.get(bytes(window[end - n : end]))
                    if token is None:
                        continue
                    left = last[end - n - 1][0] if n < end else before
                    if left < 0 or self.fit(left, token):
                        last.append((token, n))
                        break
                if end >= 2 * hold:
                    stable = self._agreed(last, end)
                    if stable:
                        ids = self._chain(last, stable)
                        yield from ids
                        before = ids[-1]
                        del window[:stable], last[:stable]
        if window:
            yield from self._chain(last, len(window))

    def _chain(self, last: list[tuple[int, int]], end: int) -> list[int]:
        out = []
        while end:
            token, n = last[end - 1]
            out.append(token)
            end -= n
        return out[::-1]

    def _agreed(self, last: list[tuple[int, int]], end: int) -> int:
        """The last boundary behind the lookahead that the chains of all prefixes that can still grow share; 0: none."""
        ends = set(range(end - self.longest + 1, end + 1))
        while len(ends) > 1 or max(ends) > end - self.lookahead:
            top = max(ends)
            if not top:
                return 0
            ends.remove(top)
            ends.add(top - last[top - 1][1])
        return ends.pop()

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.memo.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.id_of.get(raw)
            ids = (whole,) if whole is not None else tuple(self.stream(raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)))
            if len(raw) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; empty and null texts have none. Strings of special tokens are ordinary text."""
        return [*self.ids(text)]

    def ids(self, text: str | None) -> Iterator[int]:
        """Ids of a text as they become stable: nothing but the current piece's window is held, besides the memo of common pieces."""
        known, piece = self.memo, self.piece
        for m in PATTERN.finditer(text or ""):
            part = m[0]
            yield from known.get(part) or piece(part)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, through an incremental UTF-8 state machine; broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        out = io.StringIO(newline="")
        for i in ids:
            out.write(machine.decode(self.bytes_of[i]))
        out.write(machine.decode(b"", True))
        return out.getvalue()


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One per worker process."""
    return Transducer(path)


def encode_texts(df: DataFrame, key: str, text: str, *, path: str | None = None, lengths: bool = False) -> DataFrame:
    """(key, ids) of every row, or with lengths=True (key, n_tokens).

    Null and empty texts give an empty list (length 0); repeated rows give repeated rows; other columns are
    not read; an empty table gives an empty table.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = transducer(path)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            if lengths:
                result = pa.array(sizes)
            else:
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), result], ["key", "out"])

    out = spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind}, out {'int' if lengths else 'array<int>'}")
    return out.toDF(key, "n_tokens" if lengths else "ids")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", *, path: str | None = None) -> DataFrame:
    """(key, text) of every row; a null list gives null."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = transducer(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").toDF(key, "text")

import collections
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import pack as K
from skein.llm import split as S
from skein.llm import subjects as U
from skein.llm import tokens as T

BITS = ["a", "th", "ing", "é", "-", "=", " ", "  ", "\n", "\r\n", "你", "😀", "‍", "<|endoftext|>", "0", "12", "\t", "'s", "ß", "\x00", "́"]


@pytest.fixture(scope="module")
def encoder():
    return T.Transducer(T.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=60).map("".join))
def test_ids_equal_the_library_and_round_trip(encoder, library, text):
    assert encoder.encode(text) == library(text) and encoder.decode(encoder.encode(text)) == text


def test_long_pieces_in_any_chunks(encoder, library):
    rnd = random.Random(1)
    for text in ("a" * 5000, "-" * 3000, "thequickbrown" * 300, "=" * 700 + "-" * 300):
        raw, chunks = text.encode(), []
        while raw:
            n = rnd.randint(1, 400)
            chunks.append(raw[:n])
            raw = raw[n:]
        assert list(encoder.stream(chunks)) == library(text)


def test_ids_table(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in T.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert sorted(tuple(r) for r in T.encode_texts(df, "doc_id", "text", lengths=True).collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert T.encode_texts(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x" * 40, ". ", "\n", "\n\n", "```\n", "# h\n", "USER: ", "é", "\r\n", "‍"]), max_size=200).map("".join), st.sampled_from([(50, 5), (80, 0), (120, 30)]))
def test_pieces_cover_the_text(text, sizes):
    limit, overlap = sizes
    parts = S.pieces(text, limit, overlap)
    assert "".join(text[max(a, parts[i - 1][1] if i else 0) : b] for i, (a, b) in enumerate(parts)) == text
    assert all(0 < b - a <= limit for a, b in parts)
    assert all(a < c <= b < d and b - c <= overlap for (a, b), (c, d) in zip(parts[:-1], parts[1:], strict=True))


def test_cuts_prefer_blocks():
    text = ("para " * 60).strip() + "\n\n" + ("next " * 60).strip()
    (a, b), *rest = S.pieces(text, 400, 20)
    assert text[b - 2 : b] == "\n\n"


def test_blocks():
    text = "a\nb\r\n \t\n```py\nx\n\ny\n```\nz\n~~~\nopen\n```\n"
    found = [(a + 1, b + 1, n) for a, b, n in S.blocks_of(S.lines_of(text))]
    assert found == [(1, 2, 3), (4, 8, 14), (9, 9, 1), (10, 13, 13)]


def test_oversized_tables(spark):
    long = "l1\n\n" + "x" * 2001
    df = spark.createDataFrame([("a", long, 5), ("b", long, None), ("c", "short", 1), ("d", None, 1)], "id string, text string, first int")
    assert sorted(tuple(r) for r in S.oversized_blocks(df, "id", "text", "first").collect()) == [("a", 7), ("b", 3)]
    rows = S.split_items(df, "id", "text", "first").collect()
    assert {r["id"] for r in rows} == {"a", "b"} and all(len(r["text"]) <= 2000 for r in rows) and min(r["start_line"] for r in rows if r["id"] == "a") == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200), st.sampled_from([30, 37, 64]))
def test_sweep_is_best_fit_decreasing(sizes, capacity):
    import bisect

    runs, n = K.sweep(dict(collections.Counter(sizes)), capacity)
    load, seen = collections.Counter(), collections.Counter()
    for r in runs:
        for x in range(r.low, r.high):
            load[r.first + (x - r.low) // r.each] += r.size
            seen[r.size] += 1
    gaps, plain = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        plain += gap == capacity
        if gap - s:
            bisect.insort(gaps, gap - s)
    assert seen == collections.Counter(sizes) and all(v <= capacity for v in load.values()) and len(load) == n == plain


def test_pack_table(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 10)
    sizes = [(i, s) for i, s in enumerate([7] * 50 + [3, 0, None, 25, 10, 10, 1, -4])] + [(3, 7)]
    got = K.pack(spark.createDataFrame(sizes, "doc_id long, n int"), "doc_id", "n", 10).collect()
    load = collections.Counter()
    for r in got:
        load[r["container"]] += r["n"]
    assert all(v <= 10 for v in load.values()) and sum(load.values()) == sum(max(s or 0, 0) for _, s in sizes)
    assert len(got) == len(sizes) + 2 and sorted((r["piece_no"], r["n"], r["start"]) for r in got if r["doc_id"] == 53) == [(0, 10, 0), (1, 10, 10), (2, 5, 20)]
    assert K.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n", 10).count() == 0


def test_sentences_leave_code_and_headings():
    text = "# Head 1.8\n- One thing on 3.4. Two!\n```\nx = 1.\n```\nUSER: Why? Because."
    assert [s for s, _ in U.sentences(text)] == ["One thing on 3.4.", "Two!", "Why?", "Because."] and U.sentences(None) == []


def test_latent_model_learns_who_is_right():
    rnd = random.Random(0)
    counts = collections.Counter()
    for _ in range(4000):
        y = rnd.randrange(3)
        good = y if rnd.random() < 0.95 else rnd.randrange(3)
        poor = y if rnd.random() < 0.4 else rnd.randrange(3)
        third = y if rnd.random() < 0.9 else rnd.randrange(3)
        counts[good, -1, third, poor, -1] += 1
    post = U.latent([(p, float(n)) for p, n in counts.items()], 3)
    assert all(p[0] == post[p].argmax() for p in post if p[0] == p[2]) and post[0, -1, 1, 2, -1].argmax() == 0


def test_subjects_held_out(spark):
    rnd = random.Random(2)
    nouns = {"sport": "goal match racket coach stadium medal".split(), "music": "violin tempo opera chord sonata octave".split()}
    plain = ["Thanks, that helps, please remember it.", "We talked and agreed on the rest."]
    docs, labels, truth = [], [], {}
    for i in range(160):
        s = rnd.choice(["sport", "music", None])
        body = [f"The {rnd.choice(nouns[s])} and the {rnd.choice(nouns[s])} were discussed again." for _ in range(4)] if s else []
        text = " ".join(body + [rnd.choice(plain) for _ in range(4)] + ([f"A {rnd.choice(nouns['sport' if s == 'music' else 'music'])} was there."] if i % 5 == 0 and s else []))
        docs.append((i, text, "src"))
        truth[i] = {s} - {None}
        if i % 2:
            labels.append((i, f" {s.upper()} " if s else None))
    docs += [(900, None, "src"), (901, "", None), (902, "  ", "x"), docs[0]]
    areas = spark.createDataFrame([("sport", "Sport", "matches and teams"), ("music", "Music", "the instruments and the concerts")], "subject string, title string, description string")
    got = U.subjects_of(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([*labels, (12345, "sport"), (1, "odd code")], "doc_id long, subject string"), areas).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(r["subject"])
    held = [i for i in truth if i % 2 == 0]
    assert sum(found[i] == truth[i] for i in held) / len(held) > 0.95 and not found.keys() & {900, 901, 902}
    none = U.subjects_of(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, subject string"), areas)
    assert none.count() == 0


def test_queries_are_registered_with_their_columns():
    import __spark_entry__ as entry

    names = {re.match(r"p(\d)_", n)[1] for n in entry.queries() if re.match(r"p\d_", n)}
    assert names == set("12345678")


def test_pieces_one_by_one_and_in_chunks_are_alike(encoder, monkeypatch):
    text = "abc " * 50 + "=" * 9_001 + "é" * 700 + "\n" + "tail"
    whole = encoder.encode(text)
    monkeypatch.setattr(T, "CHUNK", 37)
    encoder.memo.clear()
    assert list(encoder.ids(text)) == whole and encoder.decode(iter(whole)) == text


def test_oversized_blocks_are_where_the_pieces_cut():
    rnd = random.Random(5)
    for _ in range(60):
        text = "\n".join(rnd.choice(["", "x" * rnd.randint(1, 90), "```", "word " * rnd.randint(1, 30)]) for _ in range(rnd.randint(1, 80)))
        marks = S.Boundaries(text)
        ends = [b for _, b in S.pieces(text, 100, 20, marks)]
        for a, b, size in marks.blocks:
            assert size <= 100 or any(marks.lines[a].start < e < marks.lines[b].end for e in ends)

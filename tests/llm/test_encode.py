"""Encoding against a public library on the same vocabulary, and round trips."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from halyard.llm.automaton import WORDS, Automaton, byte_symbols, compile_file
from halyard.llm.encode import VOCABULARIES, count_tokens, decode_column, encode_column, vocabulary

AUTOMATON = compile_file(vocabulary())


@pytest.fixture(scope="module")
def known():
    with open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def lists(texts):
    n, ids = AUTOMATON.ready().encode(texts)
    cut = np.r_[0, np.cumsum(n)]
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


def naive(word: bytes, merges: list[tuple[int, int, int]], of_byte: dict[int, int]) -> list[int]:
    rank = {(a, b): (n, c) for n, (a, b, c) in enumerate(merges)}
    out = [of_byte[x] for x in word]
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
        if best is None:
            return out
        pair = next(p for p, (n, _) in rank.items() if n == best[0])
        i, new = 0, []
        while i < len(out):
            if tuple(out[i : i + 2]) == pair:
                new.append(rank[pair][1])
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_merges_against_the_plain_algorithm(data):
    """Not only of one vocabulary: random merges over two or three letters."""
    letters = b"abc"[: data.draw(st.integers(1, 3))]
    tokens = [bytes([x]) for x in letters]
    merges, seen = [], set(tokens)
    for _ in range(data.draw(st.integers(0, 12))):
        a, b = (data.draw(st.integers(0, len(tokens) - 1)) for _ in range(2))
        if tokens[a] + tokens[b] not in seen:
            seen.add(tokens[a] + tokens[b])
            merges.append((a, b, len(tokens)))
            tokens.append(tokens[a] + tokens[b])
    enc = Automaton(tokens, merges).ready()
    words = [bytes(data.draw(st.lists(st.sampled_from(letters), min_size=1, max_size=24))) for _ in range(4)]
    n, flat = enc.encode_words(words)
    cut = np.r_[0, np.cumsum(n)]
    of_byte = {x: i for i, x in enumerate(letters)}
    assert [flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [naive(w, merges, of_byte) for w in words]
    # an arc leads from a token to another if and only if both together are encoded as the two
    made = [n for n, t in enumerate(tokens) if naive(t, merges, of_byte) == [n]]
    pairs = np.array([(a, b) for a in made for b in made])
    assert enc.a.has_arc(pairs[:, 0], pairs[:, 1]).tolist() == [naive(tokens[a] + tokens[b], merges, of_byte) == [a, b] for a, b in pairs.tolist()]


def test_table_of_arcs():
    """Every merge took an arc; rows are shared by states without the same arcs."""
    from halyard.llm.automaton import Automaton, read_merges

    tokens, merges = read_merges(f"{VOCABULARIES}/byte_bpe_50k.json")
    m = np.array(merges)
    assert not AUTOMATON.has_arc(m[:, 0], m[:, 1]).any()
    assert AUTOMATON.has_arc(m[:, 2], m[:, 2]).mean() > 0.9
    assert AUTOMATON.row.max() < len(tokens) / 2 and len(AUTOMATON.no_arc) < 10 * len(merges)
    with pytest.raises(ValueError):
        Automaton([None] * (1 << 20), [])


def test_lists_of_large_batches(monkeypatch):
    """More tokens than a list column holds come in several batches."""
    from halyard.llm import encode as E

    monkeypatch.setattr(E, "MOST_TOKENS", 10)
    n = np.array([3, 0, 8, 9, 1, 0, 12, 2])
    flat = np.arange(n.sum(), dtype=np.int32)
    parts = list(E.list_parts(n, flat))
    assert [x for a, b, part in parts for x in part.to_pylist()] == [flat[e - k : e].tolist() for e, k in zip(np.cumsum(n), n)]
    assert [(a, b) for a, b, _ in parts] == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)] and list(E.list_parts(n[:0], flat[:0]))[0][2].to_pylist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    with open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = test_any_text.__dict__.setdefault("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    enc = test_any_text.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}))
    assert lists(texts) == [enc.encode_ordinary(t) for t in texts]


def test_hard_texts(known):
    rnd = random.Random(1)
    texts = [None, "", " ", "<|endoftext|>", "\x00\x01", "  \n\n\t x", "don't we'll I'M", "a" * 20_000, " " * 9_000, "éé\U0001f600", "的是" * 3_000, "0123456789" * 500]
    for al in ("ab", "-=", "aA0 \n", "的是 a", "\r\n\t "):
        texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    assert lists(texts) == [known.encode_ordinary(t or "") for t in texts]


def test_long_text_in_pieces(known):
    enc = AUTOMATON.ready()
    texts = ["x1", "the cost of a bill, 12.5% é " * 900, None, "tail"]
    words = [p for p in enc.pieces(texts, chars=1000)]
    assert len(words) > 2 and any(goes_on for *_, goes_on in words)
    whole = enc.pieces
    enc.pieces = lambda t: whole(t, chars=1000)
    try:
        assert lists(texts) == [known.encode_ordinary(t or "") for t in texts]
    finally:
        del enc.pieces


def test_forgetting_words_changes_nothing(known):
    enc = AUTOMATON.ready()
    texts = [f"word{n} x{n * n}" for n in range(500)]
    was, enc.MOST_WORDS = enc.MOST_WORDS, 50
    try:
        assert lists(texts) == lists(texts) == [known.encode_ordinary(t) for t in texts]
    finally:
        enc.MOST_WORDS = was


def test_symbols_are_all_bytes():
    assert sorted(byte_symbols().values()) == list(range(256))


def test_columns(spark, known):
    rows = [(1, "A bill <|endoftext|>", "x", [9]), (2, None, "y", None), (3, "", "z", []), (None, "的 x", None, None), (1, "A bill <|endoftext|>", "x", [9])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __text string, ids array<int>")
    got = encode_column(df, {"doc_id": F.col("doc_id")}, "text")
    assert got.columns == ["doc_id", "ids"]
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, known.encode_ordinary(t or "")) for i, t, *_ in rows)
    n = count_tokens(df, {"doc_id": F.col("doc_id")}, "text")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in n.collect()) == sorted((i or 0, len(known.encode_ordinary(t or ""))) for i, t, *_ in rows)
    back = decode_column(got, {"doc_id": F.col("doc_id")}, "ids")
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, *_ in rows)
    assert encode_column(df.where("false"), {"doc_id": F.col("doc_id")}, "text").collect() == []


def test_decode_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 99_999_999, -1, 50256]), (4, [187])], "n int, ids array<int>")
    assert {r.n: r.text for r in decode_column(df, {"n": F.col("n")}, "ids").collect()} == {1: "", 2: "", 3: "", 4: "�"}


def test_queries(spark, known):
    from halyard.llm.queries import QUERIES

    want = {r.doc_id: known.encode_ordinary(r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    ids = QUERIES["p6_ids"](spark, DATA)
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert QUERIES["p6_round_trip"](spark, DATA).where("NOT same").count() == 0

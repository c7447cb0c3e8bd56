"""Shared spans against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA
from halyard.llm import spans as S
from halyard.llm import windows as W


def brute(texts: list[tuple[int, str | None]], length: int):
    """(pairs, positions of shared windows by document)."""
    at = defaultdict(list)
    for i, t in texts:
        if i is not None:
            for p in range(len(t or "") - length + 1):
                at[t[p : p + length]].append((i, p))
    pairs, places = set(), defaultdict(set)
    for rows in at.values():
        ids = sorted({i for i, _ in rows})
        if len(ids) > 1:
            pairs |= {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}
            for i, p in rows:
                places[i].update(range(p, p + length))
    return pairs, {i: len(x) for i, x in places.items()}


def run(spark, texts, length, cover=True, **more):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id bigint, text string, key int, h string, around string")
    s = S.SharedSpans(df, length, **more)
    rows = [(r.doc_a, r.doc_b) for r in s.pairs().collect()]
    assert len(rows) == len(set(rows))
    if not cover:
        return set(rows)
    reps, places = s.found()
    assert {tuple(r) for r in s._expanded(reps).collect()} == set(rows)
    others = Counter(x for r in set(rows) for x in r)
    assert {r.doc_id: r.n_others for r in s.links(reps).collect()} == others
    chars = {r.doc_id: r.shared_chars for r in s.shared_chars(places).collect()}
    copies = {r.doc_id for r in s.members.collect()}
    assert not copies & set(chars)
    return set(rows), chars | {i: len(t) for i, t in texts if i in copies and t is not None and len(t) >= length}


def corpus(seed: int, length: int, n: int = 120):
    """Texts with shared passages just as long as needed or one short, repeated
    characters, periods, copies and other scripts."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdefgh 的\U0001f600") for _ in range(k))
    bits = [word(rnd.randint(length - 2, 2 * length)) for _ in range(12)]
    bits += ["-" * rnd.randint(length // 2, 3 * length) for _ in range(3)] + ["-=" * rnd.randint(length // 4, 2 * length) for _ in range(2)] + ["abc" * length]
    out = []
    for i in range(n):
        parts = [rnd.choice(["", word(rnd.randint(1, 2 * length)), "-" * rnd.randint(1, 2 * length)])]
        for _ in range(rnd.randint(0, 3)):
            b = rnd.choice(bits)
            cut = rnd.choice([0, 0, 1, rnd.randint(0, len(b))])
            parts += [b[cut:] if rnd.random() < 0.5 else b[: len(b) - cut], rnd.choice(["", "x", word(rnd.randint(1, length))])]
        out.append((i, "".join(parts)))
    out += [(1000 + i, out[i % 7][1]) for i in range(20)]
    return out


@pytest.mark.parametrize("seed,length", [(1, 30), (3, 41), (4, 16)])
def test_against_brute_force(spark, seed, length):
    texts = corpus(seed, length)
    want = brute(texts, length)
    # hashes of the sketch far below the anchors, ranges of all sizes, and what parts know of frequent anchors
    for more in ({"width": 8}, {"ranges": 37}) if seed == 1 else ({"width": 64, "ranges": 1},) if seed == 3 else ({},):
        got = run(spark, texts, length, **more)
        assert got[0] == want[0], more
        assert got[1] == want[1], more


def anchors_of(texts, length, send_at, monkeypatch):
    monkeypatch.setattr(S, "SEND_AT", send_at)
    parts = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some])], names=["doc_id", "text"]) for some in (texts[::2], texts[1::2])]
    return [r for p in parts for r in pa.Table.from_batches(list(S._anchors(length)(iter([p])))).to_pylist()]


@pytest.mark.parametrize("width", [1, 16, 1 << 16])
@pytest.mark.parametrize("send_at", [50, 1 << 17])
def test_ranges_lose_no_repeated_anchor(width, send_at, monkeypatch):
    """Whatever the sketch's width, what comes out is what several texts have."""
    rnd = random.Random(9)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    bits = [word(n) for n in (29, 30, 31, 45, 90)]
    texts = [(i, word(rnd.randint(0, 40)) + rnd.choice(bits) + word(rnd.randint(0, 20)) + rnd.choice(bits)[rnd.choice([0, 0, 1]) :]) for i in range(60)]
    sent = anchors_of(texts, 30, send_at, monkeypatch)
    real = [r for r in sent if r["pos"] >= 0]
    docs, n = defaultdict(set), Counter(r["h"] for r in real)
    for r in real:
        docs[r["h"]].add(r["doc"])
    out = []
    for part in range(3):  # as the shuffle does
        mine = [r for r in sent if (r["h"] if r["n"] == 1 or r["pos"] < 0 else r["doc"]) % 3 == part]
        if mine:
            batches = pa.Table.from_pylist(mine, schema=pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])).to_batches(max_chunksize=19)
            out += pa.Table.from_batches(list(S._repeated(width)(iter(batches)))).to_pylist()
    got = Counter((r["h"], r["doc"], r["pos"]) for r in out)
    assert got == Counter((r["h"], r["doc"], r["pos"]) for r in real if len(docs[r["h"]]) > 1)
    assert all(r["n"] == min(W.TOP, n[r["h"]]) for r in out) and any(r["n"] == W.TOP for r in out) and any(r["n"] < W.TOP for r in out)


def test_frequent_anchor_is_told_once(monkeypatch):
    """A passage in all texts: its range gets few rows, the others are spread."""
    texts = [(i, "".join(chr(97 + (n * n * 7) % 23) for n in range(60))) for i in range(4000)]
    sent = anchors_of(texts, 30, 1000, monkeypatch)
    assert sum(r["n"] == 1 for r in sent) < 200 and sum(r["pos"] < 0 for r in sent) < 200 and len(sent) > 8000


def test_frequent_phrase_makes_no_pairs(spark):
    """A phrase of length // 2 and more in every text, and one long passage in many."""
    rnd = random.Random(6)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    phrase, passage = word(25), word(80)
    texts = [(i, word(60) + phrase + word(60) + (passage if i % 4 == 0 else "") + word(20)) for i in range(200)]
    assert run(spark, texts, 30) == brute(texts, 30)
    reps = S.SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"), 30)
    assert reps._near(False).count() < 100


@pytest.mark.parametrize("spread", [7, S.SPREAD])
def test_many_copies(spark, monkeypatch, spread):
    """A third of all texts is one text, and another passage is in all the rest."""
    monkeypatch.setattr(S, "SPREAD", spread)
    rnd = random.Random(11)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    passage = word(40)
    copy = word(30) + passage  # shares with the others as well
    texts = [(i, copy if i % 3 == 0 else word(30) + passage + word(20) if i % 3 == 1 else word(80)) for i in range(150)]
    texts += [(200 + i, t) for i, t in texts[:3]]
    assert run(spark, texts, 30) == brute(texts, 30)


def test_odd_cases(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400))
    texts = [(1, None), (2, ""), (3, " " * 20), (4, long), (4, long), (5, "x" + long), (None, long), (6, long[:29]), (7, long[100:130]), (8, "-" * 5000), (9, "-" * 31 + "z")]
    pairs, cover = brute(texts, 30)
    assert run(spark, texts, 30) == (pairs, cover)
    assert run(spark, [], 30) == (set(), {})
    # of several texts under one id one counts, with its own pairs
    both = [(1, long), (1, "y" * 40), (2, long), (3, "y" * 50), (3, "y" * 50)]
    assert run(spark, both, 30)[0] in ({(1, 2)}, {(1, 3)})
    assert run(spark, [(1, "a" * 100)], 30) == (set(), {})
    with pytest.raises(ValueError):
        S.SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), 8)


def test_very_long_texts(spark):
    rnd = random.Random(7)
    a = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(3 * W.SLICE))
    cuts = [W.SLICE - 40, 2 * W.SLICE - 149, W.SLICE // 2]
    texts = [(1, a)] + [(n + 2, "q" * 10 + a[c : c + 150] + "q" * 10) for n, c in enumerate(cuts)] + [(9, a[7 : 7 + 149])]
    assert run(spark, texts, 150)[0] == {(1, 2), (1, 3), (1, 4)}


def test_sketch_is_never_too_low():
    rnd = np.random.default_rng(8)
    keys = rnd.integers(0, 3000, 20_000).astype(np.uint64)
    u, n = np.unique(keys, return_counts=True)
    for width in (1, 1 << 8, 1 << 16):
        sketch = W.Sketch(width)
        for part in np.array_split(keys, 3):
            sketch.add(part)
        assert (sketch.estimate(u) >= np.minimum(n, W.TOP)).all()
    assert W.width_for(0) == W.LEAST_WIDTH and W.width_for(1 << 20) == 1 << 21


def test_queries(spark):
    from halyard.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    pairs, cover = brute(docs, 150)
    found = QUERIES["p8_found"](spark, DATA)
    assert dict(found.dtypes) == {"doc_a": "bigint", "doc_b": "bigint"}
    assert {tuple(r) for r in found.collect()} == pairs
    spans = {r.doc_id: r for r in QUERIES["p8_spans"](spark, DATA).collect()}
    assert {i: r.shared_chars for i, r in spans.items() if r.shared_chars} == cover
    assert all(spans[i].n_others == sum(i in p for p in pairs) for i, _ in docs)
    assert len(spans) == len(docs)

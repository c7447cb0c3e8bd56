"""Mixing to target weights."""

from __future__ import annotations

from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from halyard.llm.mixing import Mix, pfair, whole_units


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8).filter(any))
def test_schedule_is_never_a_block_off(units):
    slots = pfair(units)
    total, given_ = sum(units), Counter()
    assert Counter(slots) == Counter({s: u for s, u in enumerate(units) if u})
    for t, s in enumerate(slots, 1):
        given_[s] += 1
        assert all(abs(given_[x] - Fraction(u * t, total)) < 1 for x, u in enumerate(units))


def test_whole_units():
    assert whole_units([Decimal("0.2500"), Decimal("0.7500")]) == [1, 3]
    assert whole_units([Decimal("0.0500"), Decimal("0.9400")]) == [5, 94]


DOCS = "doc_id bigint, source string, text string, n_tokens int, slot int, h string"
TARGETS = "source string, target_share decimal(5,4), max_repeats int, total int"


def mix(spark, docs, targets, **more):
    d = spark.createDataFrame([(*x, 1, 2, "h") for x in docs], DOCS)
    t = spark.createDataFrame([(s, Decimal(w) if w is not None else None, m, 5) for s, w, m in targets], TARGETS)
    return Mix(d, t, **more)


def test_shares_and_repeats(spark):
    docs = [(n, "big" if n % 3 else "small", "word " * (5 + n % 7)) for n in range(900)] + [(1000, None, "x"), (1001, "other", "x"), (1002, "big", None), (1003, "big", ""), (None, "big", "x")]
    m = mix(spark, docs, [("big", "0.3", 1), ("small", "0.6", 2), ("absent", "0.1", 3)], block_tokens=50)
    rows = sorted(m.rows().collect(), key=lambda r: (r.slot, r.at_token))
    uses, size = defaultdict(set), Counter()
    for r in rows:
        uses[r.doc_id].add(r.repeat_no)
        size[r.doc_id, r.repeat_no] += r.n_tokens
    assert {r.source for r in rows} == {"big", "small"}
    assert max(len(uses[n]) for n in range(900) if n % 3) == 1 and max(len(uses[n]) for n in range(0, 900, 3)) == 2
    assert sum(len(uses[n]) == 2 for n in range(0, 900, 3)) > 280  # the source that bounds the whole is nearly used up
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["small"].reached_share - 2 / 3) < 1e-9 and abs(shares["big"].reached_share - 1 / 3) < 1e-9
    assert shares["absent"].used_tokens == 0 and shares["absent"].reached_share == 0
    check(m, rows, {"big": Fraction(1, 3), "small": Fraction(2, 3)})
    whole = {r.doc_id: r.n_tokens for r in m.counted.collect()}
    cut = [k for k, n in size.items() if n != whole[k[0]]]
    assert len(cut) <= 2  # the last of each source
    off = {r.source: r for r in m.deviation(m.rows()).collect()}
    assert all(0 <= r.ahead < 1 and 0 <= r.behind < 1 for r in off.values())
    assert {s: r.used_tokens for s, r in off.items()} == {s: shares[s].used_tokens for s in off}


def check(m, rows, shares):
    """Every prefix is within a block of the shares; streams and documents are gapless."""
    got, done, streams, docs = Counter(), 0, defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.at_token == streams[r.source] and r.from_token == docs[r.doc_id, r.repeat_no] and r.n_tokens > 0
        streams[r.source] += r.n_tokens
        docs[r.doc_id, r.repeat_no] += r.n_tokens
        got[r.source] += r.n_tokens
        done += r.n_tokens
        assert all(abs(got[s] - done * w) < m.block for s, w in shares.items())
    assert all(abs(got[s] - done * w) < 1 for s, w in shares.items())


def test_larger_than_it_can_be(spark):
    m = mix(spark, [(1, "a", "one two three"), (2, "b", "x " * 500)], [("a", "0.5", 2), ("b", "0.5", 1)], total_tokens=400)
    s = {r.source: r for r in m.shares().collect()}
    assert s["a"].used_tokens == 2 * s["a"].n_tokens and s["a"].most_uses == 2
    assert s["a"].reached_share < 0.5


def test_odd_cases(spark):
    assert mix(spark, [], [("a", "1.0", 1)]).rows().collect() == []
    assert mix(spark, [(1, "a", "x")], []).rows().collect() == []
    none = mix(spark, [(1, "a", "x")], [("a", "0.0", 1), ("b", None, None)])
    assert none.rows().collect() == [] and {r.reached_share for r in none.shares().collect()} == {0.0}
    with pytest.raises(ValueError):
        mix(spark, [(1, "a", "x")], [("a", "0.5", 1), ("a", "0.5", 1)])
    one = mix(spark, [(1, "a", "x"), (1, "a", "x")], [("a", "1.0", None)])
    assert one.rows().count() == 2  # repeated rows are documents of their own
    assert {(r.at_token, r.n_tokens) for r in one.rows().collect()} == {(0, 1), (1, 1)}


def test_queries(spark):
    import oracle
    from halyard.llm.queries import QUERIES, SQL

    rows = sorted(QUERIES["p7_mix"](spark, DATA).collect(), key=lambda r: (r.slot, r.at_token))
    shares = {r.source: r for r in QUERIES["p7_shares"](spark, DATA).collect()}
    limits = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    assert set(shares) == set(limits)
    for s, r in shares.items():
        assert r.most_uses <= limits[s].max_repeats
        assert r.used_tokens == sum(x.n_tokens for x in rows if x.source == s)
        assert r.most_uses == max((x.repeat_no for x in rows if x.source == s), default=0)
    assert any(r.most_uses == limits[s].max_repeats for s, r in shares.items())
    m = Mix(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/mix_targets.parquet"))
    check(m, rows, {s: Fraction(u, m.period) for s, u in zip(m.used, m.units)})
    assert oracle.compare(QUERIES["p7_within"](spark, DATA), SQL["p7_within"], DATA) == ""

"""The general problems on small fixtures: brute force and odd cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.operators import bloom, qdigest
from halyard.operators.orphans import orphan_references, orphans_per_period
from halyard.operators.sessions import session_kinds, sessions
from halyard.operators.snapshots import Snapshots, snapshot_changes, tree_levels
from halyard.operators.trailing import trailing_totals
from halyard.plans import problems

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 1, 1, tzinfo=UTC)


def at(days=0.0, **more):
    return T0 + dt.timedelta(days=days, **more)


# 1. trailing totals

BILLS = "id bigint, bill_id string, org_id string, bill_amount decimal(12,2), request_started_at timestamp, e string, d string, day int, run string"


def bills(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], BILLS)


def trailing(df, **more):
    return trailing_totals(df, "org_id", "bill_amount", "request_started_at", "bill_id", "id", **more)


def test_trailing_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for n in range(600):
        org = rnd.choice(["a", " A ", "b", "B", "c", None, ""])
        amount = rnd.choice([None, Decimal(rnd.randint(-500, 5000)) / 100])
        when = rnd.choice([None, *[at(rnd.randint(0, 60), seconds=rnd.randint(0, 86399))] * 9])
        rows.append((n, f"bill{rnd.randint(0, 400)}", org, amount, when))
    end = dt.date(2026, 2, 20)
    got = {(r.org_id, r.day): (r.total_7, r.total_30, r.day_no) for r in trailing(bills(spark, rows), end=end).collect()}
    newest = {}
    for r in rows:
        newest[r[1]] = max(newest.get(r[1], r), r, key=lambda x: x[0])
    day_sum, first = defaultdict(Decimal), {}
    for _, _, org, amount, when in newest.values():
        if org is not None and when is not None and when.date() <= end:
            k = org.strip(" ").lower()
            day_sum[k, when.date()] += amount or 0
            first[k] = min(first.get(k, when.date()), when.date())
    want = {}
    for org, d0 in first.items():
        for n in range((end - d0).days + 1):
            day = d0 + dt.timedelta(n)
            total = lambda k: sum((day_sum.get((org, day - dt.timedelta(x)), Decimal(0)) for x in range(k)), Decimal(0))  # noqa: B023, E731
            want[org, day] = (total(7), total(30), n + 1)
    assert got == want


def test_trailing_odd_cases(spark):
    assert trailing(bills(spark, [])).collect() == []
    same = [(1, "x", "o", Decimal(2), at(0))] * 3 + [(2, None, "o", Decimal(1), at(0)), (3, None, "o", Decimal(1), at(1))]
    rows = {r.day.day: r for r in trailing(bills(spark, same)).collect()}
    assert [rows[d].total_7 for d in (1, 2)] == [3, 4]  # copies once; null keys each
    late = trailing(bills(spark, [(1, "x", "o", Decimal(7), at(3))]), start=T0.date(), end=dt.date(2026, 1, 5)).orderBy("day").collect()
    assert [r.total_7 for r in late] == [0, 0, 0, 7, 7] and [r.day_no for r in late] == [-2, -1, 0, 1, 2]
    assert late[4].avg_7 == 1.0
    after = trailing(bills(spark, [(1, "x", "o", Decimal(7), at(30))]), end=dt.date(2026, 1, 5))
    assert after.collect() == []


# 2. sessions

CALLS = "user string, ts timestamp, tool string, u string, slot int, kind string"


def calls(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "tool_call") for r in rows], CALLS)


def test_sessions_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["ann", " Ann", "bob", None, "", "  "]), rnd.choice([None, *[at(minutes=rnd.randint(0, 3000), microseconds=rnd.randint(0, 2))] * 9]), rnd.choice(["a", "b", None])) for _ in range(800)]
    rows += rows[:200]
    df = calls(spark, rows)
    events = sorted({(u.strip(" ").lower(), t, k or "") for u, t, k in rows if u and u.strip(" ") and t})
    want, kinds, last = [], [], {}
    for u, t, k in events:
        if u not in last or (t - last[u][1]) > dt.timedelta(minutes=30):
            want.append([u, t, t, 0])
            kinds.append(Counter())
            last[u] = (len(want) - 1, t)
        n = last[u][0]
        want[n][2], want[n][3] = t, want[n][3] + 1
        kinds[n][k or None] += 1
        last[u] = (n, t)
    us = lambda t: (t - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)
    got = {(r.user, r.start_us, r.end_us, r.n_events) for r in sessions(df, "user", "ts", "tool").collect()}
    assert got == {(u, us(a), us(b), n) for u, a, b, n in want}
    per = {(r.user, r.start_us, r.end_us, r.n_events, r.tool, r.n_kind) for r in session_kinds(df, "user", "ts", "tool").collect()}
    assert per == {(w[0], us(w[1]), us(w[2]), w[3], k, n) for w, c in zip(want, kinds) for k, n in c.items()}


def test_session_gap_is_exact(spark):
    gap = dt.timedelta(minutes=30)
    a, b, c = at(), at() + gap, at() + 2 * gap + dt.timedelta(microseconds=1)
    rows = sessions(calls(spark, [("u", x, "t") for x in (a, b, c)]), "user", "ts", "tool").orderBy("start_us").collect()
    assert [(r.n_events, r.duration_us) for r in rows] == [(2, 1_800_000_000), (1, 0)]
    old = dt.datetime(1969, 12, 31, 23, 50, tzinfo=UTC)
    rows = sessions(calls(spark, [("u", old, "t"), ("u", old + gap, "t")]), "user", "ts", "tool").collect()
    assert [r.n_events for r in rows] == [2]
    assert sessions(calls(spark, []), "user", "ts", "tool").collect() == []


# 3. percentiles


def rank_errors(values, found, qs):
    v = np.sort(values)
    for q, x in zip(qs, found):
        lo, hi = np.searchsorted(v, x, "left"), np.searchsorted(v, x, "right")
        yield max(0.0, lo - q * len(v), q * len(v) - hi) / len(v)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**63 - 1), st.integers(0, 20), st.integers(900, 2000)), min_size=1, max_size=400), st.integers(1, 5), st.integers(3, 60))
def test_digest_error_after_merges(values, parts, k):
    qs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    v = np.array(values, np.int64)
    held = []
    for part in np.array_split(v, parts):
        held.append(qdigest.compress(np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), part, np.ones(len(part), np.int64), k))
    g, lv, i, c = (np.concatenate(x) for x in zip(*held))
    g, lv, i, c = qdigest.compress(g, lv, i, c, k)
    assert c.sum() == len(v)
    assert (c[lv > 0] <= len(v) // k).all()
    found = qdigest.quantiles(g, lv, i, c, qs)[0]
    assert max(rank_errors(v, found, qs)) <= qdigest.LEVELS / k + 1 / len(v)


def test_digest_size_and_error_at_the_promised_k():
    rnd = np.random.default_rng(3)
    v = (rnd.pareto(0.6, 400_000) * 50).astype(np.int64)
    k = qdigest.compression(0.01)
    z = np.zeros(len(v), np.int64)
    g, lv, i, c = qdigest.compress(z, z, v, z + 1, k)
    assert len(c) <= 3 * k + qdigest.LEVELS
    qs = [0.5, 0.9, 0.95, 0.99]
    assert max(rank_errors(v, qdigest.quantiles(g, lv, i, c, qs)[0], qs)) <= 0.01


@pytest.mark.parametrize("partitions", [4, 300])
def test_percentiles_of_days_combine(spark, partitions):
    rnd = random.Random(4)
    rows = [(dt.date(2026, 6, 1 + n % 3), rnd.choice(["a", "b", None]), {"exec": rnd.randint(-3, 10**6), "auth": rnd.choice([None, 1, 2])} if n % 50 else None, 1, "x") for n in range(3000)]
    df = spark.createDataFrame(rows, "log_day date, tool string, stages_ms map<string,bigint>, cnt int, level string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        days = qdigest.digests(df, {"log_day": F.col("log_day"), "tool": F.col("tool")}, F.col("stages_ms"), "stage")
        got = {(r.tool, r.stage): r for r in qdigest.percentiles(days, ["tool", "stage"], {"p50": 0.5, "p99": 0.99}).collect()}
        one = qdigest.merge_digests(days, ["tool", "stage"])
        again = {(r.tool, r.stage): (r.n_values, r.p50, r.p99) for r in qdigest.percentiles(one, ["tool", "stage"], {"p50": 0.5, "p99": 0.99}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert again == {k: (r.n_values, r.p50, r.p99) for k, r in got.items()}
    for tool in ("a", "b", None):
        for stage in ("exec", "auth"):
            v = [m[stage] for _, t, m, *_ in rows if t == tool and m and m[stage] is not None and m[stage] >= 0]
            assert got[tool, stage].n_values == len(v)
            assert max(rank_errors(np.array(v), [got[tool, stage].p50, got[tool, stage].p99], [0.5, 0.99])) <= 0.01
    assert qdigest.percentiles(qdigest.digests(df.where("false"), {"tool": F.col("tool")}, F.col("stages_ms"), "stage"), ["tool", "stage"], {"p50": 0.5}).collect() == []


def test_calls_are_counted_once(spark):
    from halyard.plans.problems import calls_once

    kind = "kind string, ts timestamp, user string, key string, tool string, params string, stages_ms map<string,bigint>, status string, plan_id string, log_day date"
    day = dt.date(2026, 6, 2)
    line = ("tool_call", at(), "ann", "k", "t", "{}", {"exec": 1}, "success", "p", day)
    copy = ("tool_call", at(), " ANN ", "k", "t", "{}", {"exec": 1}, "success", "p", day + dt.timedelta(1))
    unsure = ("tool_call", None, "ann", "k", "t", "{}", {"exec": 1}, "success", "p1", day)
    other = ("tool_call", None, "ann", "k", "t", "{}", {"exec": 2}, "success", "p2", day)
    df = spark.createDataFrame([line, copy, unsure, unsure, other, ("auth_failure", *line[1:])], kind)
    got = calls_once(df).collect()
    assert len(got) == 3 and {r.log_day for r in got} == {day}


# 4. orphans

GRANTS = "id bigint, user_id string, table_fqn string, granted_at timestamp, k string, maybe string, salt int"
ENTITIES = "fqn string, kind string, tombstone boolean, created_at timestamp, updated_at timestamp, ok string, gone string"


def orphans(spark, grants, entities):
    g = spark.createDataFrame([(*x, "k", "m", 1) for x in grants], GRANTS)
    e = spark.createDataFrame([(*x, "o", "g") for x in entities], ENTITIES)
    return orphan_references(g, e, "id", "table_fqn", "granted_at", "fqn", "updated_at", "created_at", "tombstone", F.col("kind") == "table")


def test_orphan_reasons(spark):
    entities = [
        ("a.b.live", "table", None, at(0), at(0)),
        (" A.b.Gone", "table", True, at(0), at(2)),
        ("a.b.gone", "table", False, at(0), at(1)),
        ("a.b.young", "table", False, at(5), at(5)),
        ("a.b.col", "column", False, at(0), at(0)),
        (None, "table", False, at(0), at(0)),
        ("a.b.undated", "table", False, None, None),
    ]
    grants = [
        (1, "u", "a.b.live", at(1)),
        (1, "U ", " A.B.live", at(1)),
        (2, "u", "a.b.gone", at(1)),
        (3, "u", "a.b.young", at(1)),
        (4, "u", "a.b.young", at(5)),
        (5, "u", "a.b.col", at(1)),
        (6, "u", "nonsense", None),
        (7, "u", None, at(1)),
        (8, "u", "", at(1)),
        (9, "u", "a.b.young", None),
        (10, "u", "a.b.undated", at(1)),
        (None, "u", "a.b.none", at(1)),
        (None, "u", "a.b.none", at(1)),
    ]
    got = orphans(spark, grants, entities)
    assert Counter((r.id, r.reason) for r in got.collect()) == Counter({(2, "deleted"): 1, (3, "late"): 1, (5, "missing"): 1, (6, "missing"): 1, (8, "missing"): 1, (None, "missing"): 2})
    month = {(r.table_fqn, str(r.month), r.reason): r.n_refs for r in orphans_per_period(got, "table_fqn", "granted_at").collect()}
    assert month["a.b.none", "2026-01-01", "missing"] == 2
    assert {r.reason for r in orphans(spark, grants, []).collect()} == {"missing"}
    assert orphans(spark, [], entities).collect() == []


def test_hot_parent(spark):
    grants = [(n, "u", "a.b.hot", at(0)) for n in range(3000)]
    got = orphans(spark, grants, [("a.b.hot", "table", False, at(1), at(1))])
    assert got.count() == 3000 and got.select("reason").distinct().collect()[0].reason == "late"


def test_bloom_loses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    other = spark.range(5000).select(F.concat(F.lit("x"), F.col("id")).alias("k"))
    for bits, most in ((1 << 12, 5000), (1 << 15, 1500), (None, 250)):
        f = bloom.Filter(keys.unionByName(keys.select(F.lit(None).cast("string").alias("k"))), "k", bits)
        assert f.keys == 5000 and keys.where(~f.holds("k")).count() == 0
        assert other.where(f.holds("k")).count() <= most
        assert other.select(F.lit(None).cast("string").alias("k")).where(f.holds("k")).count() == 0
    none = bloom.Filter(keys.where("false"), "k")
    assert keys.where(none.holds("k")).count() == 0
    assert bloom.bits_for(1 << 40) == bloom.MOST_BITS
    assert [bloom.probes_for(1000, bits) for bits in (1000, 3000, 12_000, 1 << 20)] == [1, 2, 4, 4]


def test_orphans_read_references_once(spark):
    """The result is read from what one pass over the references has written."""
    df = problems.p4_found(spark, DATA)
    assert df.count() > 0 and not any("dgw_table_grants" in f for f in df.inputFiles())


def test_tasks_are_those_of_the_last_shuffle(spark):
    df = spark.range(10).selectExpr("id % 3 AS a", "id AS b")
    assert qdigest._tasks(df.repartition(7, "a", "b").where("b > 1")) == 7 == qdigest._tasks(df.repartition(3).repartition(7))
    assert qdigest._tasks(df.groupBy("a").count()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert qdigest._tasks(df) == 0 == qdigest._tasks(df.repartition(7).union(df))


# 5. snapshots

SNAPS = "snapshot_no int, fqn string, description string, tombstone boolean, updated_at timestamp, leaf string, v string, no int"


def changes(spark, rows, **more):
    df = spark.createDataFrame([(*x, "l", "v", 9) for x in rows], SNAPS)
    return {(r.snapshot_no, r.fqn, r.change) for r in snapshot_changes(df, "snapshot_no", "fqn", "updated_at", "tombstone", "description", **more).collect()}


def test_snapshots_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for no in (1, 2, 3, 5):
        for n in range(300):
            if rnd.random() < 0.8:
                for _ in range(rnd.choice([1, 1, 2])):
                    rows.append((no, rnd.choice(["K{}", " k{}"]).format(n), rnd.choice([None, "", "x", "x ", "y"]) if rnd.random() < 0.1 else f"d{n}", rnd.choice([None, False, False, True]), at(rnd.random())))
    rows += rows[:50]
    live = defaultdict(dict)
    for no, k, v, gone, u in rows:
        key = k.strip(" ").lower()
        row = (u, bool(gone), hashlib.md5((v or "").encode()).digest(), v or "")
        live[no][key] = max(live[no].get(key, row), row)
    live = {no: {k: x[3] for k, x in d.items() if not x[1]} for no, d in live.items()}
    want = set()
    for a, b in ((1, 2), (2, 3), (3, 5)):
        want |= {(b, k, "added") for k in live[b].keys() - live[a].keys()} | {(b, k, "removed") for k in live[a].keys() - live[b].keys()}
        want |= {(b, k, "changed") for k in live[a].keys() & live[b].keys() if live[a][k] != live[b][k]}
    for more in ({"levels": 1}, {"levels": 3}, {"levels": 2, "folders": 1}):
        assert changes(spark, rows, **more) == want


def test_snapshots_are_stored_once(spark, tmp_path):
    """With a store each call reads only deliveries that it hasn't seen."""
    first = [(n, f"k{i}", f"d{i}", False, at(n)) for n in (1, 2) for i in range(50 + 10 * n)]
    third = [(3, f"k{i}", f"d{i}" if i != 7 else "x", False, at(3)) for i in range(1, 70)]
    store = str(tmp_path / "store")
    want = {(2, f"k{i}", "added") for i in range(60, 70)}
    assert changes(spark, first, store=store, levels=2) == want
    want |= {(3, "k0", "removed"), (3, "k7", "changed")}
    assert changes(spark, third, store=store) == want
    assert changes(spark, third + [(1, "k0", "other", False, at(9))], store=store) == want
    assert changes(spark, [], store=store) == want


def test_comparison_reads_folders_that_differ(spark):
    same = [(n, f"k{i}", f"d{i}", False, at(1)) for n in (1, 2) for i in range(400)]
    df = spark.createDataFrame([(*x, "l", "v", 9) for x in [*same, (2, "new", "x", False, at(1))]], SNAPS)
    s = Snapshots(df, "snapshot_no", "fqn", "updated_at", "tombstone", "description", levels=2, folders=1)
    assert [tuple(r) for r in s.changes().collect()] == [(2, "new", "added")]
    one = s.rows_near(spark.createDataFrame([(2, 16 * 5)], "at bigint, leaf bigint"))
    assert one.select("no", "top").distinct().collect() == [(2, 5)] and one.collect()
    files = one._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 1 <= files <= 4 and len(s.live.inputFiles()) >= 32


def test_snapshot_odd_cases(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "a", "x", False, at(0))]) == set()
    only_dead = [(1, "a", "x", False, at(0)), (2, "a", "x", True, at(1)), (3, "a", None, None, at(2)), (3, None, "x", False, at(2)), (None, "a", "x", False, at(2))]
    assert changes(spark, only_dead) == {(2, "a", "removed"), (3, "a", "added")}
    assert tree_levels(1) == 1 and tree_levels(1 << 40) == 6

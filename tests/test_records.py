"""The call log: writing, reading, roll-ups, retention, replay, streaming."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from halyard.errors import EngineError, denied, invalid
from halyard.records.log import CallLog, read_log, retain, status_of, summarize, summary_path
from halyard.records.replay import replay
from halyard.records.rollup import audit, multiset_diff
from halyard.streaming.rollup import daily_counts, read_stream, upsert

UTC = dt.timezone.utc
TODAY = dt.date(2026, 6, 4)


class Log:
    def __init__(self, root):
        self.root, self.now = root, dt.datetime(2026, 6, 1, 12, tzinfo=UTC)
        self.log = CallLog(str(root), lambda: self.now)

    def add(self, day, tool="search_entities", status="success", **more):
        self.now = dt.datetime(2026, 6, day, 12, tzinfo=UTC)
        assert self.log.append({"user": "ann", "key": "k", "tool": tool, "status": status, **more})


@pytest.fixture
def log(tmp_path):
    return Log(tmp_path / "log")


def test_summaries(spark, log):
    log.add(1, params={"query": " Rate "})
    log.add(1, params={"query": "rate"})
    log.add(1, params={"query": "bill"}, status="rejected", reject={"kind": "invalid_request", "code": "x", "message": "m", "details": {"reason": "too_long"}})
    log.add(1, "execute_sql", "timeout", reject={"kind": "invalid_request", "code": "x", "message": "m"})
    log.add(1, "execute_sql", rows=7, truncated=True)
    log.add(1, "execute_sql", "", rows=1)
    log.log.append({"kind": "auth_failure"})
    log.add(2, kind="auth_failure")
    log.add(4)
    folder = str(log.root)
    with open(log.root / "raw-2026-06-01.jsonl", "a") as f:
        f.write("not json\n[1, 2]\n{\"kind\": \"tool_call\", \"ts\": \"2026-")
    assert (log.root / "raw-2026-06-01.jsonl").stat().st_mode & 0o777 == 0o600
    assert summarize(spark, folder, TODAY) == ["2026-06-01", "2026-06-02"]
    s = json.loads(summary_path(folder, "2026-06-01").read_text())
    assert s["calls"]["execute_sql"] == {"calls": 3, "success": 1, "rejected": 1, "timeout": 1, "parse_error": 0, "rows": 8, "truncated": 1}
    assert s["rejects"] == {"too_long": 1, "invalid_request": 1}
    assert s["keywords"] == [{"keyword": "rate", "count": 2}, {"keyword": "bill", "count": 1}]
    assert json.loads(summary_path(folder, "2026-06-02").read_text())["calls"] == {}
    assert summarize(spark, folder, TODAY) == []
    log.add(2)  # late
    assert summarize(spark, folder, TODAY) == ["2026-06-02"]
    assert json.loads(summary_path(folder, "2026-06-02").read_text())["calls"]["search_entities"]["calls"] == 1
    assert read_log(spark, folder + "/raw-*.jsonl", dt.datetime(2026, 6, 3, tzinfo=UTC)).count() == 1


def test_retention(spark, log):
    for day in (1, 2, 3, 4):
        log.add(day)
    gone = retain(spark, str(log.root), TODAY, 2, 3)
    assert gone == ["raw-2026-06-01.jsonl", "raw-2026-06-02.jsonl", "summary-2026-06-01.json"]
    assert summary_path(str(log.root), "2026-06-02").exists()


def test_a_failing_disk_fails_nothing(tmp_path):
    (tmp_path / "file").write_text("")
    assert CallLog(str(tmp_path / "file" / "x")).append({"tool": "t"}) is False


def test_status():
    assert [status_of(e) for e in (None, invalid("timeout", ""), invalid("syntax_error", ""), denied("not_granted", ""))] == ["success", "timeout", "parse_error", "rejected"]


def test_replay_and_audit(spark, log):
    log.add(1, "execute_sql", rows=3, truncated=False, plan_id="a", params={"sql": "x"})
    log.add(1, "execute_sql", rows=5, truncated=False, plan_id="b", params={"sql": "y"})
    log.add(1, "execute_sql", "rejected", plan_id="c", params={"sql": "z"}, reject={"kind": "permission_denied", "code": "c", "message": "m", "details": {"reason": "not_granted"}})
    rows = read_log(spark, str(log.root))

    def call(user, tool, params):
        if params["sql"] == "z":
            raise denied("not_granted", "no")
        return 3, False

    assert replay(rows.toLocalIterator(), call) == [{"plan_id": "b", "field": "rows", "logged": 5, "now": 3}]

    def down(user, tool, params):
        raise EngineError("internal", "down", {})

    assert {x["plan_id"] for x in replay(rows.toLocalIterator(), down)} == {"a", "b", "c"}
    seen = spark.createDataFrame([("a", "success"), ("b", "rejected"), ("d", "success")], "plan_id string, status string")
    assert {(r.plan_id, r.problem) for r in audit(rows, seen).collect()} == {("b", "status"), ("c", "unobserved"), ("d", "unlogged")}
    assert multiset_diff(rows, rows, ["user", "status"]).collect() == []


def test_stream(spark, log, tmp_path):
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    log.add(1)
    log.add(1, status="rejected")
    log.add(2, "execute_sql")

    def run():
        q = upsert(daily_counts(read_stream(spark, str(log.root))), table, check)
        q.awaitTermination(120)
        assert q.exception() is None
        return {(str(r.day), r.tool, r.calls, r.failed) for r in spark.read.parquet(table).collect()}

    assert run() == {("2026-06-01", "search_entities", 2, 1), ("2026-06-02", "execute_sql", 1, 0)}
    (log.root / "late.jsonl").write_text('{"kind": "tool_call", "ts": "2026-06-02T13:00:00Z", "tool": "search_entities", "status": "success"}\n')
    assert run() == {("2026-06-01", "search_entities", 2, 1), ("2026-06-02", "execute_sql", 1, 0), ("2026-06-02", "search_entities", 1, 0)}

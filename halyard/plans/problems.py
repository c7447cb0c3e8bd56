"""Queries of the general problems and the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.orphans import orphan_references, orphans_per_period
from halyard.operators.qdigest import digests, percentiles
from halyard.operators.sessions import session_kinds, sessions
from halyard.operators.snapshots import snapshot_changes
from halyard.operators.trailing import trailing_totals
from halyard.functions.keys import norm_key
from halyard.session import materialize
from halyard.sources.tables import table

FIRST_DAY, LAST_DAY = dt.date(2026, 1, 1), dt.date(2026, 6, 29)
QS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
RANK_ERROR = 0.01


def _trailing(spark: SparkSession, d: str, start: dt.date | None) -> DataFrame:
    return trailing_totals(table(spark, d, "bills"), "org_id", "bill_amount", "request_started_at", "bill_id", "id", (7, 30), start, LAST_DAY)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d, None).where("day_no >= 30 AND total_7 > 0 AND 10 * total_7 > 7 * total_30")
    return t.select("org_id", F.date_format("day", "yyyy-MM-dd").alias("bill_day"))


def p1_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d, FIRST_DAY)
    return t.select("org_id", F.date_format("day", "yyyy-MM-dd").alias("bill_day"), *(F.col(c).cast("double").alias(c) for c in ("total_7", "avg_7", "total_30", "avg_30")))


_BILLS = """
live AS (
  SELECT lower(trim(org_id, ' ')) AS org_id, (request_started_at AT TIME ZONE 'UTC')::DATE AS d, coalesce(bill_amount, 0) AS a
  FROM bills WHERE id IN (SELECT max(id) FROM bills GROUP BY bill_id) AND org_id IS NOT NULL AND request_started_at IS NOT NULL),
daily AS (SELECT org_id, d, sum(a) AS t FROM live WHERE d <= DATE '2026-06-29' GROUP BY 1, 2),
orgs AS (SELECT org_id, min(d) AS first FROM daily GROUP BY 1),
grid AS (SELECT org_id, first, unnest(generate_series(least(first, DATE '2026-01-01'), DATE '2026-06-29', INTERVAL 1 DAY))::DATE AS day FROM orgs),
sums AS (
  SELECT g.org_id, g.day, g.first,
    sum(coalesce(t, 0)) OVER (PARTITION BY g.org_id ORDER BY g.day ROWS 6 PRECEDING) AS total_7,
    sum(coalesce(t, 0)) OVER (PARTITION BY g.org_id ORDER BY g.day ROWS 29 PRECEDING) AS total_30
  FROM grid g LEFT JOIN daily y ON y.org_id = g.org_id AND y.d = g.day)
"""


def _is_call() -> F.Column:
    return F.col("kind") == "tool_call"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(table(spark, d, "tool_calls"), "user", "ts", "tool", keep=_is_call())
    return s.where("n_events >= 2").select(F.col("user").alias("user_id"), "start_us", "end_us")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "tool_calls"), "user", "ts", "tool", keep=_is_call()).select(F.col("user").alias("user_id"), "session_no", "start_us", "end_us", "duration_us", F.col("n_events").alias("n_calls"))


def p2_session_tools(spark: SparkSession, d: str) -> DataFrame:
    s = session_kinds(table(spark, d, "tool_calls"), "user", "ts", "tool", keep=_is_call())
    return s.select(F.col("user").alias("user_id"), "session_no", "start_us", "end_us", F.col("n_events").alias("n_calls"), "tool", F.col("n_kind").alias("n_tool_calls"))


_CALLS = """
calls AS (
  SELECT DISTINCT lower(trim("user", ' ')) AS u, epoch_us(ts) AS us, tool FROM tool_calls
  WHERE kind = 'tool_call' AND ts IS NOT NULL AND "user" IS NOT NULL AND trim("user", ' ') <> ''),
flags AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS f FROM calls WINDOW w AS (PARTITION BY u ORDER BY us, tool)),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY us, tool ROWS UNBOUNDED PRECEDING) AS no FROM flags)
"""


def calls_once(df: DataFrame) -> DataFrame:
    """Each call of the log once: kind tool_call, columns log_day, tool, stages_ms.

    Rows equal in user, ts and tool are one call, of the earliest log_day. Rows
    in which one of the three is null (or the user blank) are copies only if
    they are equal in what else they say of the call."""
    user = norm_key(F.col("user"))
    unsure = F.coalesce(user, F.lit("")).isin("") | F.col("ts").isNull() | F.col("tool").isNull()
    rest = F.when(unsure, F.to_json(F.struct(F.col("key").alias("a"), F.col("params").alias("b"), F.col("status").alias("c"), F.col("plan_id").alias("d"), F.array_sort(F.map_entries("stages_ms")).alias("e"))))
    rows = df.where(_is_call()).select(user.alias("u"), "ts", "tool", rest.alias("rest"), F.struct("log_day", F.array_sort(F.map_entries("stages_ms")).alias("e")).alias("s"))
    once = rows.groupBy("u", "ts", "tool", "rest").agg(F.min("s").alias("s"))
    return once.select("s.log_day", "tool", F.map_from_entries("s.e").alias("stages_ms"))


def _day_digests(spark: SparkSession, d: str) -> DataFrame:
    calls = calls_once(table(spark, d, "tool_calls"))
    return digests(calls, {"log_day": F.col("log_day"), "tool": F.col("tool")}, F.col("stages_ms"), "stage", RANK_ERROR)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_day_digests(spark, d), ["tool", "stage"], QS, RANK_ERROR)


def p3_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles(_day_digests(spark, d), ["log_day", "tool", "stage"], QS, RANK_ERROR)
    return p.select(F.date_format("log_day", "yyyy-MM-dd").alias("log_day"), "tool", "stage", "n_values", *QS)


def p3_within_error(spark: SparkSession, d: str) -> DataFrame:
    """Each percentile held against exact ranks: one row per tool, stage and percentile."""
    calls = materialize(calls_once(table(spark, d, "tool_calls")))
    nodes = digests(calls, {"log_day": F.col("log_day"), "tool": F.col("tool")}, F.col("stages_ms"), "stage", RANK_ERROR)
    p = percentiles(nodes, ["tool", "stage"], QS, RANK_ERROR)
    p = p.select("tool", "stage", F.explode(F.create_map(*(x for n in QS for x in (F.lit(n), F.col(n))))).alias("percentile", "v"))
    exact = calls.select("tool", F.explode("stages_ms").alias("stage", "x")).where("x >= 0").groupBy("tool", "stage", "x").agg(F.count(F.lit(1)).alias("n"))
    both = exact.join(p.select(F.col("tool").alias("t"), F.col("stage").alias("s"), "percentile", "v"), F.expr("tool <=> t AND stage = s"))
    ranks = both.groupBy("tool", "stage", "percentile").agg(F.sum("n").alias("n_values"), F.sum(F.when(F.col("x") < F.col("v"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("v"), F.col("n")).otherwise(0)).alias("upto"))
    q = F.create_map(*(x for n, v in QS.items() for x in (F.lit(n), F.lit(v))))[F.col("percentile")]
    slack = F.lit(RANK_ERROR) * F.col("n_values") + 1
    ok = (F.col("below") <= q * F.col("n_values") + slack) & (F.col("upto") >= q * F.col("n_values") - slack)
    return ranks.select("tool", "stage", "percentile", "n_values", ok.alias("within_error"))


_STAGES = """
rows_ AS (
  SELECT lower(trim("user", ' ')) AS u, ts, tool, log_day, list_sort(map_entries(stages_ms)) AS e,
    CASE WHEN coalesce(lower(trim("user", ' ')), '') = '' OR ts IS NULL OR tool IS NULL
      THEN concat_ws('|', coalesce(key, '~'), coalesce(params, '~'), coalesce(status, '~'), coalesce(plan_id, '~'), coalesce(list_sort(map_entries(stages_ms))::VARCHAR, '~')) END AS rest
  FROM tool_calls WHERE kind = 'tool_call'),
once AS (SELECT tool, arg_min(e, (log_day, e::VARCHAR)) AS e FROM rows_ GROUP BY u, ts, tool, rest),
vals AS (SELECT tool, unnest(e) AS x FROM once)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "dgw_table_grants"), table(spark, d, "dgw_sem_entities"), "id", "table_fqn", "granted_at", "fqn", "updated_at", "created_at", "tombstone", F.col("kind") == "table"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("id").alias("grant_id"), "reason")


def p4_per_month(spark: SparkSession, d: str) -> DataFrame:
    m = orphans_per_period(_orphans(spark, d), "table_fqn", "granted_at")
    return m.groupBy("table_fqn", F.date_format("month", "yyyy-MM").alias("month")).agg(*(F.sum(F.when(F.col("reason") == r, F.col("n_refs")).otherwise(0)).alias(f"n_{r}") for r in ("missing", "deleted", "late")))


_ORPHANS = """
g AS (SELECT id, min(lower(trim(table_fqn, ' '))) AS k, min(granted_at) AS t FROM dgw_table_grants WHERE table_fqn IS NOT NULL GROUP BY id),
e AS (
  SELECT k, gone, born FROM (
    SELECT lower(trim(fqn, ' ')) AS k, kind, coalesce(tombstone, false) AS gone, created_at AS born,
      row_number() OVER (PARTITION BY lower(trim(fqn, ' ')) ORDER BY updated_at DESC NULLS LAST) AS r
    FROM dgw_sem_entities WHERE fqn IS NOT NULL) WHERE r = 1 AND kind = 'table'),
o AS (
  SELECT g.*, CASE WHEN e.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN born > t THEN 'late' END AS reason
  FROM g LEFT JOIN e USING (k))
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = snapshot_changes(table(spark, d, "dgw_sem_entity_snapshots"), "snapshot_no", "fqn", "updated_at", "tombstone", "description")
    return c.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "fqn", "change")


_SNAPSHOTS = """
live AS (
  SELECT no, k, v FROM (
    SELECT snapshot_no AS no, lower(trim(fqn, ' ')) AS k, coalesce(description, '') AS v, coalesce(tombstone, false) AS gone,
      row_number() OVER (PARTITION BY snapshot_no, lower(trim(fqn, ' ')) ORDER BY updated_at DESC NULLS LAST) AS r
    FROM dgw_sem_entity_snapshots WHERE fqn IS NOT NULL) WHERE r = 1 AND NOT gone),
pairs AS (
  SELECT coalesce(a.no, b.no + 1) AS no, coalesce(a.k, b.k) AS k, a.v AS v, b.v AS w
  FROM live a FULL JOIN live b ON a.no = b.no + 1 AND a.k = b.k)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_trailing": p1_trailing,
    "p2_found": p2_found,
    "p2_sessions": p2_sessions,
    "p2_session_tools": p2_session_tools,
    "p3_percentiles": p3_percentiles,
    "p3_day_percentiles": p3_day_percentiles,
    "p3_within_error": p3_within_error,
    "p4_found": p4_found,
    "p4_per_month": p4_per_month,
    "p5_found": p5_found,
}

SQL = {
    "p1_found": f"WITH {_BILLS} SELECT org_id, strftime(day, '%Y-%m-%d') AS bill_day FROM sums WHERE day >= first + 29 AND total_7 > 0 AND 10 * total_7 > 7 * total_30",
    "p1_trailing": f"WITH {_BILLS} SELECT org_id, strftime(day, '%Y-%m-%d') AS bill_day, total_7::DOUBLE AS total_7, total_7::DOUBLE / 7 AS avg_7, total_30::DOUBLE AS total_30, total_30::DOUBLE / 30 AS avg_30 FROM sums",
    "p2_found": f"WITH {_CALLS} SELECT u AS user_id, min(us) AS start_us, max(us) AS end_us FROM numbered GROUP BY u, no HAVING count(*) >= 2",
    "p2_sessions": f"WITH {_CALLS} SELECT u AS user_id, no::BIGINT AS session_no, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_calls FROM numbered GROUP BY u, no",
    "p2_session_tools": f"WITH {_CALLS} SELECT u AS user_id, no::BIGINT AS session_no, min(min(us)) OVER s AS start_us, max(max(us)) OVER s AS end_us, (sum(count(*)) OVER s)::BIGINT AS n_calls, tool, count(*) AS n_tool_calls FROM numbered GROUP BY u, no, tool WINDOW s AS (PARTITION BY u, no)",
    "p3_within_error": f"WITH {_STAGES} SELECT tool, stage, percentile, n_values, true AS within_error FROM (SELECT tool, x.key AS stage, count(*) AS n_values FROM vals WHERE x.value >= 0 GROUP BY 1, 2), (VALUES ('p50'), ('p90'), ('p95'), ('p99')) q(percentile)",
    "p4_found": f"WITH {_ORPHANS} SELECT id AS grant_id, reason FROM o WHERE reason IS NOT NULL",
    "p4_per_month": f"WITH {_ORPHANS} SELECT k AS table_fqn, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'late') AS n_late FROM o WHERE reason IS NOT NULL GROUP BY 1, 2",
    "p5_found": f"WITH {_SNAPSHOTS} SELECT no::INTEGER AS snapshot_no, k AS fqn, CASE WHEN w IS NULL THEN 'added' WHEN v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM pairs WHERE no BETWEEN 2 AND 8 AND v IS DISTINCT FROM w",
}

"""The SQL vocabulary of the business-data surface, on the driver's tables.

Each query is SQL text, as callers send it, run by Spark over views of the whole
tables. The same text runs elsewhere once its timestamp literals are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.sources.tables import register_views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in text]

    def run(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d, *used)
        return spark.sql(text)

    return run


_DAY = "CAST(CAST({} AS DATE) AS STRING)"
_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

TEXTS: dict[str, str] = {
    # attribution of a failing day: CTE, join, day buckets, filtered counts, ratio, lag per partition
    "failure_attribution": f"""
WITH daily AS (
  SELECT {_DAY.format("e.ts")} AS d, c.c_mktsegment AS channel, count(*) FILTER (WHERE e.event_type = 'error') AS failed, count(*) AS total
  FROM events e JOIN customer c ON e.user_id = c.c_custkey
  WHERE e.ts >= timestamp_ntz'2024-01-28' AND e.ts < timestamp_ntz'2024-01-31'
  GROUP BY 1, 2)
SELECT d, channel, failed, total, round(CAST(failed AS DOUBLE) / nullif(total, 0), 6) AS rate,
  failed - lag(failed) OVER (PARTITION BY channel ORDER BY d) AS delta
FROM daily""",
    "failure_trend_7d": f"""
SELECT {_DAY.format("ts")} AS d, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / nullif(count(*), 0), 6) AS failure_rate
FROM events WHERE ts >= timestamp_ntz'2024-01-24' AND ts < timestamp_ntz'2024-01-31' GROUP BY 1""",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "global_aggregate": f"SELECT count(*) AS n, {_MONEY.format('o_totalprice')} AS total, max(o_totalprice) AS highest, min(o_totalprice) AS lowest FROM orders",
    "amount_filter_count": "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000",
    "first_rows_limit": f"SELECT o_orderkey, o_orderstatus, o_totalprice, {_DAY.format('o_orderdate')} AS d FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "daily_amount_window": f"""
SELECT {_DAY.format("o_orderdate")} AS d, {_MONEY.format("o_totalprice")} AS total
FROM orders WHERE o_orderdate >= timestamp_ntz'1998-01-01' AND o_orderdate < timestamp_ntz'1999-01-01' GROUP BY 1""",
    "type_totals_window": f"""
SELECT event_type, {_MONEY.format("value")} AS total, count(*) AS n
FROM events WHERE ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-17' GROUP BY event_type""",
    "group_two_keys_max": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS max_amount FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "computed_columns": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net, CASE WHEN l_discount = 0 THEN 'full' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS band FROM lineitem WHERE l_quantity >= 45 AND l_tax <= 0.02",
    "refund_attribution": f"""
SELECT o.o_orderstatus AS status, count(*) AS refunds, {_MONEY.format("l.l_extendedprice")} AS refund_amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY o.o_orderstatus""",
    "left_join_cte_attribution": """
WITH attempts AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderstatus AS status, count(*) AS batches, CAST(coalesce(sum(a.failed), 0) AS BIGINT) AS failed_attempts
FROM orders o LEFT JOIN attempts a ON o.o_orderkey = a.l_orderkey GROUP BY o.o_orderstatus""",
    "chain_left_distinct": """
SELECT c.c_mktsegment AS segment, count(DISTINCT o.o_orderkey) AS n_orders, count(DISTINCT e.event_id) AS n_events
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN events e ON c.c_custkey = e.user_id GROUP BY c.c_mktsegment""",
    "three_way_join_failed": """
SELECT c.c_mktsegment AS segment, count(*) AS items, count(*) FILTER (WHERE l.l_returnflag = 'R') AS failed
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    "left_join_count_vs_distinct": """
SELECT c.c_mktsegment AS segment, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS n_orders
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""",
    "join_on_expression": """
SELECT n.n_name, count(*) AS customers FROM customer c JOIN nation n ON 'NATION_' || CAST(c.c_nationkey AS STRING) = n.n_name GROUP BY n.n_name""",
    "agg_over_window": """
SELECT p.p_brand AS brand, p.p_type AS kind, count(*) AS items, CAST(sum(sum(p.p_size)) OVER (PARTITION BY p.p_brand) AS BIGINT) AS brand_size
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_brand, p.p_type""",
    "trend_lag_subquery": f"""
SELECT d, total, total - lag(total) OVER (ORDER BY d) AS delta
FROM (SELECT {_DAY.format("ts")} AS d, count(*) AS total FROM events GROUP BY 1) t""",
    "having_groups": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "exists_semi": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)",
    "in_semi": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "not_exists_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)",
    "scalar_subquery": "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM customer) AS customers FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_orderstatus",
    "case_exists": "SELECT n_name, CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000) THEN 1 ELSE 0 END AS rich FROM nation n",
    "lateral_top": """
SELECT c.c_custkey, t.top FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t WHERE t.top IS NOT NULL""",
    "full_outer_gap": """
SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""",
    "using_left_join": "SELECT n_regionkey, count(DISTINCT n_name) AS nations, count(r_name) AS named FROM nation LEFT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey) GROUP BY n_regionkey",
    "cross_small": "SELECT r.r_name AS a, s.r_name AS b FROM region r CROSS JOIN region s",
    "self_join_pairs": "SELECT a.n_regionkey AS region, count(*) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_regionkey",
    "union_all": "SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_keys": "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events",
    "except_keys": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "except_all": "SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_quantity < 3 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 49",
    "nested_cte_shadow": "WITH x AS (SELECT o_custkey AS k FROM orders) SELECT count(*) AS n FROM (WITH x AS (SELECT c_custkey AS k FROM customer) SELECT * FROM x) s",
    "recursive_levels": """
WITH RECURSIVE walk AS (
  SELECT CAST('region-' || CAST(r_regionkey AS STRING) AS STRING) AS node, 0 AS depth FROM region
  UNION ALL
  SELECT CAST('nation-' || CAST(n.n_nationkey AS STRING) AS STRING), w.depth + 1 FROM walk w JOIN nation n ON w.node = 'region-' || CAST(n.n_regionkey AS STRING) WHERE w.depth < 5)
SELECT node, CAST(depth AS INT) AS depth FROM walk""",
    "rollup_levels": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_levels": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "rank_frames": """
SELECT n_nationkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS dr, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS rn,
  CAST(ntile(3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS third,
  first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first_name,
  CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near
FROM nation WINDOW w AS (ORDER BY n_regionkey)""",
    "top_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2",
    "values_and_functions": "SELECT a, upper(b) AS u, CAST(length(b) AS INT) AS n, md5(b) AS h, coalesce(nullif(b, ''), 'none') AS c FROM (VALUES (1, 'x'), (2, ''), (3, 'yz')) AS v(a, b)",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "mixed_conditions": "SELECT count(*) AS n FROM customer WHERE (c_acctbal BETWEEN 0 AND 5000 OR c_mktsegment ILIKE 'build%') AND c_name NOT LIKE '%9' AND c_nationkey IS NOT NULL",
    "union_of_aggregates": f"SELECT 'orders' AS kind, count(*) AS n, {_MONEY.format('o_totalprice')} AS total FROM orders UNION ALL SELECT 'lineitem', count(*), {_MONEY.format('l_extendedprice')} FROM lineitem",
    "null_safe_match": "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'O') AS s FROM orders) a WHERE a.s IS NOT DISTINCT FROM NULL",
    "enum_values_total": "SELECT o_orderpriority AS value, count(*) AS n, CAST(count(*) OVER () AS INT) AS total FROM orders GROUP BY o_orderpriority",
    "json_extract": "SELECT event_type, count(*) AS n FROM events WHERE get_json_object(props, '$.k') = '42' GROUP BY event_type",
    "ordered_percentiles": "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median FROM orders GROUP BY o_orderstatus",
    "string_agg": "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    # joins without equality, and the latest row up to a time
    "range_join": """
SELECT b.name AS band, count(*) AS n FROM orders o JOIN (VALUES ('low', 0, 50000), ('mid', 50000, 200000), ('high', 200000, 10000000)) AS b(name, lo, hi)
ON o.o_totalprice >= b.lo AND o.o_totalprice < b.hi GROUP BY b.name""",
    "interval_join": """
SELECT c.c_mktsegment AS segment, count(*) AS n FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL '1' DAY
JOIN customer c ON c.c_custkey = e.user_id GROUP BY c.c_mktsegment""",
    "asof_join": """
SELECT event_type, count(*) AS n, count(last_error) AS after_error FROM (
  SELECT event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error
  FROM events) t GROUP BY event_type""",
    "approx_distinct": """
SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS close FROM events GROUP BY event_type""",
    "approx_median": """
SELECT o_orderstatus, abs(count(*) FILTER (WHERE o_totalprice <= m) - 0.5 * count(*)) <= 0.01 * count(*) + 1 AS close
FROM orders JOIN (SELECT o_orderstatus AS s, percentile_approx(o_totalprice, 0.5, 10000) AS m FROM orders GROUP BY o_orderstatus) q ON s = o_orderstatus GROUP BY o_orderstatus""",
    "sample_all": "SELECT count(*) AS n FROM lineitem TABLESAMPLE (100 PERCENT)",
    "monthly_totals": f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) IS NOT NULL AS dated, substr({_DAY.format('l_shipdate')}, 1, 7) AS month, {_MONEY.format('l_extendedprice')} AS total FROM lineitem GROUP BY 1, 2",
}

#: Where the other engine writes something differently.
_OTHER = {
    "json_extract": lambda s: s.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "asof_join": lambda s: s.replace("END) IGNORE NULLS OVER", "END IGNORE NULLS) OVER"),
    "approx_median": lambda s: s.replace("percentile_approx(o_totalprice, 0.5, 10000)", "median(o_totalprice)"),
    "sample_all": lambda s: s.replace(" TABLESAMPLE (100 PERCENT)", ""),
    "string_agg": lambda s: s.replace("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)", "string_agg(n_name, ',' ORDER BY n_name)"),
}

QUERIES = {name: sql_query(text) for name, text in TEXTS.items()}
SQL = {name: _OTHER.get(name, str)(text.replace("timestamp_ntz'", "timestamp '")) for name, text in TEXTS.items()}

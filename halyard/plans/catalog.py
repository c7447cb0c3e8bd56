"""Queries of the semantic layer, the call log and the catalog checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.catalog.check import SYNONYMS, calibrate, cross_check
from halyard.catalog.draft import merge_columns
from halyard.functions.encode import capped
from halyard.functions.keys import norm_key
from halyard.operators.orphans import newest
from halyard.records import rollup
from halyard.semantic.diff import apply, diff
from halyard.semantic.grants import coverage_gap, expand, replacement, stale
from halyard.semantic.graph import relation_summary, walk_levels
from halyard.semantic.metric import metric_sql
from halyard.semantic.search import bm25, entity_text, fuse, keyword_hits, ranked, vector_hits
from halyard.sources.tables import register_views, table

FIELDS = ("kind", "name", "description", "data_type", "is_time", "pg_schema", "expression", "aggregation", "filter", "tombstone")


def catalogue(df: DataFrame) -> DataFrame:
    """The counting row of each entity: fqn, FIELDS, updated_at."""
    e = newest(df, norm_key(F.col("fqn")), F.col("updated_at"), **{c: F.col(c) for c in (*FIELDS, "updated_at")})
    return e.withColumnRenamed("k", "fqn")


def _now(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(table(spark, d, "dgw_sem_entities"))


def _snapshot(spark: SparkSession, d: str, n: int) -> DataFrame:
    return catalogue(table(spark, d, "dgw_sem_entity_snapshots").where(F.col("snapshot_no") == n))


def _cte(name: str, source: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT lower(trim(fqn, ' ')) AS f, *, row_number() OVER (PARTITION BY lower(trim(fqn, ' ')) ORDER BY updated_at DESC NULLS LAST) AS r
  FROM {source} WHERE fqn IS NOT NULL AND {where}) WHERE r = 1)"""


# search

WORDS = ("invoice", "window")


def keyword_and_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return bm25(docs, "doc_id", ["text"], WORDS).select(F.col("key").alias("doc_id"))


def keyword_bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    s = bm25(table(spark, d, "documents"), "doc_id", ["text"], WORDS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return ranked(s, [F.desc("score"), F.asc("doc_id")], 50, "kw_rank")


def keyword_short_like(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(_now(spark, d), "ra", ("metric", "concept", "table"))


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(_now(spark, d), "rate", ("metric", "concept", "column", "table"))


_BM25 = f"""
docs AS (SELECT doc_id, lower(coalesce(text, '')) AS t, greatest(length(lower(coalesce(text, ''))) - 2, 0) AS dl FROM documents),
hits AS (SELECT *, {", ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)} AS f{i}" for i, w in enumerate(WORDS))} FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS av, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(WORDS)))} FROM hits),
scored AS (
  SELECT doc_id, round({" + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(WORDS)))}, 6) AS score
  FROM hits, stats WHERE {" AND ".join(f"f{i} > 0" for i in range(len(WORDS)))}),
kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS kw_rank FROM scored ORDER BY score DESC, doc_id LIMIT 50)
"""
_VEC = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT v FROM q)), 9) AS distance FROM embeddings),
vec AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS vec_rank FROM near ORDER BY distance, vec_id LIMIT 50)
"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").head()[0]
    return vector_hits(e, "vec_id", "embedding", q)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.round("distance", 6).alias("distance"), "vec_rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    f = fuse(keyword_bm25_rank(spark, d), _vectors(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return f.select("doc_id", F.round("score", 9).alias("score"), "kw_rank", "vec_rank")


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    return _now(spark, d).where("NOT coalesce(tombstone, false)").select("fqn", entity_text().alias("text"))


# graph


def _edges(spark: SparkSession, d: str) -> DataFrame:
    def name(kind: str, c: str) -> F.Column:
        return F.concat(F.lit(kind + "-"), F.col(c).cast("string"))

    n, c, s = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    e = n.select(name("region", "n_regionkey").alias("src_fqn"), name("nation", "n_nationkey").alias("dst_fqn"))
    e = e.unionByName(c.select(name("nation", "c_nationkey").alias("src_fqn"), name("customer", "c_custkey").alias("dst_fqn")))
    e = e.unionByName(s.select(name("nation", "s_nationkey").alias("src_fqn"), name("supplier", "s_suppkey").alias("dst_fqn")))
    return e.select(F.lit("contains").alias("type"), "src_fqn", "dst_fqn", F.lit("").alias("meta"), F.lit(False).alias("tombstone"))


def graph_traverse_out(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("root"))
    return walk_levels(_edges(spark, d), roots, "out")


def graph_traverse_both(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("root")).where("root = 'supplier-7'")
    return walk_levels(_edges(spark, d), roots, "both", 3)


def relation_summary_query(spark: SparkSession, d: str) -> DataFrame:
    return relation_summary(_edges(spark, d), "nation-3").select("type", "direction", "other", "truncated")


_EDGES = """
edges AS (
  SELECT 'region-' || n_regionkey AS s, 'nation-' || n_nationkey AS t FROM nation
  UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey FROM customer
  UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey FROM supplier)
"""


# pipeline


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the last delivery against those of the one before."""
    fields = [c for c in FIELDS if c != "tombstone"]
    live = _snapshot(spark, d, 8).where("NOT coalesce(tombstone, false)")
    return diff(live.select("fqn", *fields), _snapshot(spark, d, 7), ["fqn"])


def snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    """The state after applying the last delivery to the one before."""
    live = _snapshot(spark, d, 8).where("NOT coalesce(tombstone, false)").select("fqn", "kind", "description")
    stored = _snapshot(spark, d, 7).select("fqn", "kind", "description", "tombstone", "updated_at")
    out = apply(live, stored, ["fqn"], F.lit("2026-07-01").cast("timestamp"))
    return out.select("fqn", "kind", "description", "tombstone", F.unix_micros("updated_at").alias("updated_us"))


_LIVE = "NOT coalesce(tombstone, false)"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """A wildcard over each database that has a live table, for one user."""
    tables = _now(spark, d).where(f"kind = 'table' AND {_LIVE} AND size(split(fqn, '[.]')) = 3")
    return tables.select(F.lit("auditor").alias("user_id"), F.concat(F.lit("database:"), F.substring_index("fqn", ".", 2)).alias("target")).distinct()


def _no_relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "type string, src_fqn string, dst_fqn string, meta string, tombstone boolean")


def _grants(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "dgw_table_grants")
    return g.select(norm_key(F.col("user_id")).alias("user_id"), norm_key(F.col("table_fqn")).alias("table_fqn"), "granted_at").where("user_id IS NOT NULL AND table_fqn IS NOT NULL")


def grant_expand(spark: SparkSession, d: str) -> DataFrame:
    return expand(_now(spark, d), _no_relations(spark), _wanted(spark, d))


def grant_coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    """Users with a grant in a database, as if by a wildcard: which of its tables they lack."""
    g = _grants(spark, d)
    parts = g.where("size(split(table_fqn, '[.]')) = 3").select("user_id", F.concat(F.lit("database:"), F.substring_index("table_fqn", ".", 2)).alias("pattern")).distinct()
    gap = coverage_gap(parts, g, _now(spark, d))
    return gap.groupBy("user_id", "pattern").agg(F.count(F.lit(1)).alias("n_missing"))


def stale_grants(spark: SparkSession, d: str) -> DataFrame:
    return stale(_grants(spark, d), _now(spark, d))


def grants_replace(spark: SparkSession, d: str) -> DataFrame:
    """Replacing the grants by those for tables that are live now, and these for one more user."""
    g = _grants(spark, d)
    tables = _now(spark, d).where(f"kind = 'table' AND {_LIVE}").select(F.col("fqn").alias("table_fqn"))
    kept = g.join(tables, "table_fqn", "left_semi").select("user_id", "table_fqn")
    new, changes = replacement(kept.unionByName(tables.select(F.lit("new user").alias("user_id"), "table_fqn")), g, F.current_timestamp())
    same = new.join(changes, ["user_id", "table_fqn"], "left_anti").withColumn("change", F.lit("kept"))
    return changes.unionByName(same.select(*changes.columns)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def metric_dry_run_exec(spark: SparkSession, d: str) -> DataFrame:
    """A metric's definition expanded to SQL and that SQL run."""
    m = metric_sql("failure_rate", "round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / nullif(count(*), 0), 6)", "value >= 1 OR value < 0.5", ["svc.db.events"], {"svc.db.events": ["svc.db.events.ts"]}, ("2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z"))
    register_views(spark, d, "events")
    return spark.sql(m.sql)


def row_cap_truncation(spark: SparkSession, d: str) -> DataFrame:
    """What callers get of a result beyond the cap: how many rows, and the flag."""
    _, rows, cut = capped(table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber"), 500)
    return spark.createDataFrame([(len(rows), cut)], "row_count int, truncated boolean")


# the call log


def record_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.per_tool(table(spark, d, "tool_calls"))


def reject_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollup.reject_reasons(table(spark, d, "tool_calls"))


def keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rollup.keywords(table(spark, d, "tool_calls"))


def replay_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Calls by user and status, of the earlier and the later half of June."""
    log = table(spark, d, "tool_calls").where("kind = 'tool_call'").withColumn("user", norm_key(F.col("user")))
    return rollup.multiset_diff(log.where("log_day < date'2026-06-15'"), log.where("log_day >= date'2026-06-15'"), ["user", "status"])


# drafts


def _columns(e: DataFrame) -> DataFrame:
    parts = F.split("fqn", "[.]")
    c = e.where(f"kind = 'column' AND {_LIVE}").where(F.size(parts) == 4)
    return c.select("fqn", F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("schema"), F.get(parts, F.lit(2)).alias("table"), F.get(parts, F.lit(3)).alias("column"), F.col("data_type").alias("type"), "description", "is_time")


def catalog_drift(spark: SparkSession, d: str) -> DataFrame:
    key = ["schema", "table", "column", "type"]
    return calibrate(_columns(_snapshot(spark, d, 1)).select(*key), _columns(_snapshot(spark, d, 8)).select(*key))


def model_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat_ws(".", "schema", "table").alias("table")
    key = [wide, "column", "type"]
    return cross_check(_columns(_snapshot(spark, d, 8)).select(*key), _columns(_snapshot(spark, d, 1)).select(*key))


def merge_semantics(spark: SparkSession, d: str) -> DataFrame:
    return merge_columns(_columns(_snapshot(spark, d, 8)).select("fqn", "type"), _columns(_snapshot(spark, d, 1)).select("fqn", "type", "description", "is_time"))


_PLAIN = "(coalesce(map_extract_value(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SYNONYMS.items()) + r"}, trim(regexp_replace({t}, '\s*\([^)]*\)', '', 'g'))), trim(regexp_replace({t}, '\s*\([^)]*\)', '', 'g'))) || regexp_replace(regexp_extract({t}, '(\([^)]*\))', 1), '\s', '', 'g'))"
_TYPE = _PLAIN.replace("{t}", r"regexp_replace(lower(trim(data_type)), '\s+', ' ', 'g')")


def _cols(name: str, snap: str) -> str:
    return f"{name} AS (SELECT f, split_part(f, '.', 1) || '.' || split_part(f, '.', 2) || '.' || split_part(f, '.', 3) AS tab, split_part(f, '.', 4) AS col, {_TYPE} AS ty, data_type, description, is_time FROM {snap} WHERE kind = 'column' AND {_LIVE} AND len(string_split(f, '.')) = 4)"


_S1, _S7, _S8 = (_cte(f"s{n}", "dgw_sem_entity_snapshots", f"snapshot_no = {n}") for n in (1, 7, 8))
_NOW = _cte("now_", "dgw_sem_entities")
_G = "g AS (SELECT lower(trim(user_id, ' ')) AS u, lower(trim(table_fqn, ' ')) AS k FROM dgw_table_grants WHERE user_id IS NOT NULL AND table_fqn IS NOT NULL)"
_T = f"t AS (SELECT f FROM now_ WHERE kind = 'table' AND {_LIVE})"
_DB = "split_part({0}, '.', 1) || '.' || split_part({0}, '.', 2)"
_DIFF = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in FIELDS if c != "tombstone")

QUERIES = {
    "keyword_and_search": keyword_and_search,
    "keyword_bm25_rank": keyword_bm25_rank,
    "keyword_short_like": keyword_short_like,
    "entity_search": entity_search,
    "entity_texts": entity_texts,
    "vector_topk": vector_topk,
    "rrf_fusion": rrf_fusion,
    "graph_traverse_out": graph_traverse_out,
    "graph_traverse_both": graph_traverse_both,
    "relation_summary": relation_summary_query,
    "snapshot_diff": snapshot_diff,
    "snapshot_apply": snapshot_apply,
    "grant_expand": grant_expand,
    "grant_coverage_gap": grant_coverage_gap,
    "stale_grants": stale_grants,
    "grants_replace": grants_replace,
    "metric_dry_run_exec": metric_dry_run_exec,
    "row_cap_truncation": row_cap_truncation,
    "record_rollup": record_rollup,
    "reject_histogram": reject_histogram,
    "keyword_frequency": keyword_frequency,
    "replay_multiset_diff": replay_multiset_diff,
    "catalog_drift": catalog_drift,
    "model_crosscheck": model_crosscheck,
    "merge_semantics": merge_semantics,
}

SQL = {
    "keyword_and_search": f"WITH {_BM25} SELECT doc_id FROM scored",
    "keyword_bm25_rank": f"WITH {_BM25} SELECT doc_id, score, kw_rank::INTEGER AS kw_rank FROM kw",
    "keyword_short_like": f"WITH {_NOW} SELECT f AS fqn, (row_number() OVER (ORDER BY f))::INTEGER AS kw_rank FROM now_ WHERE {_LIVE} AND kind IN ('metric', 'concept', 'table') AND (contains(lower(f), 'ra') OR contains(lower(coalesce(name, '')), 'ra') OR contains(lower(coalesce(description, '')), 'ra')) ORDER BY f LIMIT 50",
    "entity_search": f"""WITH {_NOW},
docs AS (SELECT f, kind, lower(coalesce(name, '')) AS a, lower(coalesce(description, '')) AS b FROM now_ WHERE {_LIVE}),
hits AS (SELECT *, greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) AS dl, (length(a) - length(replace(a, 'rate', ''))) // 4 + (length(b) - length(replace(b, 'rate', ''))) // 4 AS f0 FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS n0 FROM hits),
scored AS (SELECT f, round(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / av)), 12) AS score FROM hits, stats WHERE f0 > 0 AND kind IN ('metric', 'concept', 'column', 'table'))
SELECT f AS fqn, (row_number() OVER (ORDER BY score DESC, f))::INTEGER AS kw_rank FROM scored ORDER BY score DESC, f LIMIT 50""",
    "entity_texts": f"WITH {_NOW} SELECT f AS fqn, concat_ws(' ', kind, f, nullif(description, ''), CASE WHEN name <> f THEN name END, CASE WHEN kind = 'metric' THEN nullif(expression, '') END, CASE WHEN kind = 'column' THEN nullif(data_type, '') END) AS text FROM now_ WHERE {_LIVE}",
    "vector_topk": f"WITH {_VEC} SELECT vec_id, round(distance, 6) AS distance, vec_rank::INTEGER AS vec_rank FROM vec",
    "rrf_fusion": f"""WITH {_BM25}, {_VEC},
both_ AS (SELECT coalesce(k.doc_id, v.vec_id) AS doc_id, coalesce(2.0::DOUBLE / (60 + k.kw_rank), 0) + coalesce(1.0::DOUBLE / (60 + v.vec_rank), 0) AS score, k.kw_rank::INTEGER AS kw_rank, v.vec_rank::INTEGER AS vec_rank FROM kw k FULL JOIN vec v ON k.doc_id = v.vec_id)
SELECT doc_id, round(score, 9) AS score, kw_rank, vec_rank FROM both_ ORDER BY both_.score DESC, kw_rank NULLS LAST, vec_rank NULLS LAST, doc_id LIMIT 20""",
    "graph_traverse_out": f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'region-' || r_regionkey AS root, 'region-' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT w.root, e.t, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.s WHERE w.depth < 5) SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node",
    "graph_traverse_both": f"WITH RECURSIVE {_EDGES}, way AS (SELECT s, t FROM edges UNION ALL SELECT t, s FROM edges), walk AS (SELECT 'supplier-7' AS root, 'supplier-7' AS node, 0 AS depth UNION SELECT w.root, e.t, w.depth + 1 FROM walk w JOIN way e ON w.node = e.s WHERE w.depth < 3) SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node",
    "relation_summary": f"WITH {_EDGES}, mine AS (SELECT s, t, row_number() OVER (ORDER BY s, t) AS n, count(*) OVER () AS total FROM edges WHERE s = 'nation-3' OR t = 'nation-3') SELECT 'contains' AS type, CASE WHEN s = 'nation-3' THEN 'out' ELSE 'in' END AS direction, CASE WHEN s = 'nation-3' THEN t ELSE s END AS other, total > 100 AS truncated FROM mine WHERE n <= 100",
    "snapshot_diff": f"WITH {_S7}, {_S8}, a AS (SELECT * FROM s8 WHERE {_LIVE}), b AS (SELECT * FROM s7 WHERE {_LIVE}) SELECT coalesce(a.f, b.f) AS fqn, CASE WHEN b.f IS NULL THEN 'added' WHEN a.f IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.f = b.f WHERE a.f IS NULL OR b.f IS NULL OR {_DIFF}",
    "snapshot_apply": f"""WITH {_S7}, {_S8}, a AS (SELECT * FROM s8 WHERE {_LIVE}), b AS (SELECT *, coalesce(tombstone, false) AS dead FROM s7)
SELECT coalesce(a.f, b.f) AS fqn, CASE WHEN a.f IS NULL THEN b.kind ELSE a.kind END AS kind, CASE WHEN a.f IS NULL THEN b.description ELSE a.description END AS description, a.f IS NULL AS tombstone,
  CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL AND NOT b.dead AND a.kind IS NOT DISTINCT FROM b.kind AND a.description IS NOT DISTINCT FROM b.description OR a.f IS NULL AND b.dead THEN epoch_us(b.updated_at) ELSE epoch_us(TIMESTAMPTZ '2026-07-01 00:00:00+00') END AS updated_us
FROM a FULL JOIN b ON a.f = b.f""",
    "grant_expand": f"WITH {_NOW}, {_T} SELECT DISTINCT 'auditor' AS user_id, f AS table_fqn FROM t WHERE len(string_split(f, '.')) = 3",
    "grant_coverage_gap": f"WITH {_NOW}, {_T}, {_G}, p AS (SELECT DISTINCT u, {_DB.format('k')} AS db FROM g WHERE len(string_split(k, '.')) = 3), due AS (SELECT DISTINCT p.u, p.db, t.f FROM p JOIN t ON {_DB.format('t.f')} = p.db) SELECT u AS user_id, 'database:' || db AS pattern, count(*) AS n_missing FROM due WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.u = due.u AND g.k = due.f) GROUP BY 1, 2",
    "stale_grants": f"WITH {_NOW}, {_T}, {_G} SELECT DISTINCT u AS user_id, k AS table_fqn FROM g WHERE k NOT IN (SELECT f FROM t)",
    "grants_replace": f"WITH {_NOW}, {_T}, {_G}, p AS (SELECT DISTINCT u, k, k IN (SELECT f FROM t) AS ok FROM g) SELECT CASE WHEN ok THEN 'kept' ELSE 'removed' END AS change, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM t",
    "metric_dry_run_exec": "SELECT round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*), 0), 6) AS failure_rate FROM events WHERE (value >= 1 OR value < 0.5) AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "row_cap_truncation": "SELECT least(count(*), 500)::INTEGER AS row_count, count(*) > 500 AS truncated FROM lineitem",
    "record_rollup": """SELECT log_day::VARCHAR AS date, tool, count(*) AS calls, count(*) FILTER (status = 'success') AS success,
  count(*) FILTER (coalesce(nullif(status, ''), 'rejected') NOT IN ('success', 'timeout', 'parse_error')) AS rejected, count(*) FILTER (status = 'timeout') AS timeout,
  count(*) FILTER (status = 'parse_error') AS parse_error, coalesce(sum("rows"), 0)::BIGINT AS "rows", count(*) FILTER (truncated) AS truncated FROM tool_calls WHERE kind = 'tool_call' GROUP BY 1, 2""",
    "reject_histogram": "SELECT * FROM (SELECT log_day::VARCHAR AS date, coalesce(map_extract_value(reject.details, 'reason'), reject.kind) AS reason, count(*) AS n FROM tool_calls WHERE kind = 'tool_call' AND reject IS NOT NULL GROUP BY 1, 2) WHERE reason IS NOT NULL",
    "keyword_frequency": "SELECT date, keyword, count(*) AS n FROM (SELECT log_day::VARCHAR AS date, lower(trim(CASE WHEN json_valid(params) THEN json_extract_string(params, '$.query') END, ' ')) AS keyword FROM tool_calls WHERE kind = 'tool_call' AND tool = 'search_entities') WHERE keyword <> '' GROUP BY 1, 2",
    "replay_multiset_diff": """WITH n AS (SELECT lower(trim("user", ' ')) AS u, status, sum(CASE WHEN log_day < DATE '2026-06-15' THEN 1 ELSE -1 END)::BIGINT AS n FROM tool_calls WHERE kind = 'tool_call' GROUP BY 1, 2)
SELECT u AS "user", status, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, abs(n) AS n FROM n WHERE n <> 0""",
    "catalog_drift": f"WITH {_S1}, {_S8}, {_cols('a', 's1')}, {_cols('b', 's8')} SELECT * FROM (SELECT 'calibrate' AS source, CASE WHEN b.f IS NULL THEN 'error' ELSE 'warn' END AS severity, CASE WHEN b.f IS NULL THEN a.f || ' isn''t in the database' WHEN a.f IS NULL THEN b.f || ' isn''t in the draft' WHEN a.ty <> b.ty THEN a.f || ' is ' || a.ty || ' in the draft and ' || b.ty || ' in the database' END AS message FROM a FULL JOIN b ON a.f = b.f) WHERE message IS NOT NULL",
    "model_crosscheck": f"WITH {_S1}, {_S8}, {_cols('m', 's1')}, {_cols('d0', 's8')}, d AS (SELECT * FROM d0 WHERE tab IN (SELECT tab FROM m)) SELECT * FROM (SELECT 'model' AS source, CASE WHEN d.f IS NULL THEN 'error' ELSE 'warn' END AS severity, CASE WHEN d.f IS NULL THEN m.f || ' is only in the model' WHEN m.f IS NULL THEN d.f || ' is only in the migrations' WHEN d.ty <> m.ty THEN d.f || ' is ' || d.ty || ' in the migrations and ' || m.ty || ' in the model' END AS message FROM m FULL JOIN d ON m.f = d.f) WHERE message IS NOT NULL",
    "merge_semantics": f"WITH {_S1}, {_S8}, {_cols('o', 's1')}, {_cols('n', 's8')} SELECT n.f AS fqn, n.data_type AS type, o.description, coalesce(o.is_time AND lower(trim(n.data_type)) = lower(trim(o.data_type)), false) AS is_time FROM n LEFT JOIN o ON n.f = o.f",
}

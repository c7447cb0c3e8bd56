"""Queries that go through the tools themselves, over a catalogue made of the test tables.

Regions are services, nations databases and customers tables; of each market segment
there is a metric, of each nation a concept. What the tools answer is given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.config import Config, Route
from halyard.execute import Caller, Engine
from halyard.functions.keys import norm_key
from halyard.records.rollup import audit
from halyard.semantic.grants import expand
from halyard.semantic.model import SCHEMAS
from halyard.semantic.search import embedding_coverage, embedding_targets
from halyard.semantic.store import Store
from halyard.session import materialize, shared_dir
from halyard.sources.tables import table

ANN = Caller("ann", "key")
#: Columns whose values are listed as enumerations; the last has more than are given.
ENUMS = {"lineitem": ["l_returnflag"], "orders": ["o_orderpriority", "o_custkey"], "customer": ["c_mktsegment"]}
METRIC_FILTER = "value >= 1 OR value < 0.5"
METRIC = "round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / nullif(count(*), 0), 6)"


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nations with svc and db, customers with db and tab)."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("svc"))
    n = n.withColumn("db", F.concat_ws(".", "svc", F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return n, c.withColumn("tab", F.concat_ws(".", "db", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))))


def _fit(df: DataFrame, name: str) -> DataFrame:
    """The columns of a stored table, null where df has none."""
    kinds = [f.split() for f in SCHEMAS[name].split(",")] if name != "embeddings" else [["entity_fqn", "string"], ["model", "string"], ["vector", "array<float>"]]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds))


def catalogue(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """entities, relations and enum_values."""
    n, c = _names(spark, d)
    one = lambda df, fqn, kind: df.select(fqn.alias("fqn"), F.lit(kind).alias("kind"), fqn.alias("name")).distinct()
    segment = F.concat(F.lit("spend_"), F.lower("c_mktsegment"))
    concept = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))
    e = one(n, F.col("svc"), "service").unionByName(one(n, F.col("db"), "database")).unionByName(one(c, F.col("tab"), "table"))
    e = e.unionByName(one(c, segment, "metric")).unionByName(one(c, concept, "concept"))
    fixed = [("w", "service"), ("w.db", "database"), ("w.db.events", "table"), ("error_rate", "metric")] + [(f"w.db.{t}", "table") for t in ENUMS] + [(f"w.db.{t}.{x}", "column") for t, xs in ENUMS.items() for x in xs]
    e = _fit(e, "entities").unionByName(_fit(spark.createDataFrame([(f, k, f) for f, k in fixed], "fqn string, kind string, name string"), "entities"))
    e = e.withColumn("expression", F.when(F.col("fqn") == "error_rate", METRIC)).withColumn("filter", F.when(F.col("fqn") == "error_rate", METRIC_FILTER))
    time = spark.createDataFrame([("w.db.events.ts", "column", "ts", True)], "fqn string, kind string, name string, is_time boolean")
    e = e.unionByName(_fit(time, "entities"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.alias("src_fqn"), b.alias("dst_fqn")).distinct()
    rich = c.where("c_acctbal > 5000")
    r = edge(n, "contains", F.col("svc"), F.col("db")).unionByName(edge(c, "contains", F.col("db"), F.col("tab")))
    r = r.unionByName(edge(rich, "describes", segment, F.col("tab"))).unionByName(edge(rich, "describes", concept, F.col("tab")))
    r = r.unionByName(edge(c.where("n_nationkey < 3"), "describes", concept, segment))
    r = r.unionByName(spark.createDataFrame([("describes", "nation_3", "w.db.lineitem.l_returnflag"), ("describes", "error_rate", "w.db.events")], "type string, src_fqn string, dst_fqn string"))
    v = None
    for t, xs in ENUMS.items():
        for x in xs:
            some = table(spark, d, t).select(F.lit(f"w.db.{t}.{x}").alias("column_fqn"), F.col(x).cast("string").alias("value")).where("value IS NOT NULL").distinct()
            v = some if v is None else v.unionByName(some)
    return {"entities": e, "relations": _fit(r, "relations"), "enum_values": _fit(v, "enum_values")}


def _engine(spark: SparkSession, d: str, grants: tuple[str, ...] = ()) -> Engine:
    """The tools over the catalogue as written into a store."""
    at = f"{shared_dir(spark).removeprefix('file:')}/tools-{abs(hash((d, id(spark))))}"
    store = Store(spark, at)
    rows = spark.createDataFrame([(ANN.user, g, None) for g in grants], SCHEMAS["grants"])
    store.write({n: df for n, df in catalogue(spark, d).items()} | {"grants": rows}, bump=True)
    store.vacuum()
    return Engine(spark, Config(store=at, routes={"db": Route("db", "w", d)}), store)


def _starts(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """The first service, its first database and that one's first table."""
    row = _names(spark, d)[1].agg(F.min(F.struct("svc", "db", "tab")).alias("m")).head().m
    return row.svc, row.db, row.tab


def tool_get_entity(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d)
    out = []
    for fqn in (*_starts(spark, d), "nation_3"):
        got = engine.get_entity(ANN, fqn)
        for kind, ways in got["relations"].items():
            out += [(fqn, got["entity"]["kind"], kind, way, other, got["relations_truncated"]) for way, others in ways.items() for other in others]
    return spark.createDataFrame(out, "fqn string, kind string, type string, direction string, other string, truncated boolean")


def tool_traverse(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d)
    service, database, last = _starts(spark, d)
    out = []
    for start, way, depth in ((service, "out", 2), (database, "both", 1), (last, "in", 4)):
        g = engine.traverse_relations(ANN, start, "contains", way, depth)
        out += [(start, way, n, g["truncated"], len(g["edges"])) for n in g["nodes"]]
    return spark.createDataFrame(out, "start string, direction string, node string, truncated boolean, n_edges int")


def tool_enum_values(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d)
    out = []
    for fqn in (f"w.db.{t}.{x}" for t, xs in ENUMS.items() for x in xs):
        got = engine.list_enum_values(ANN, fqn)
        out += [(fqn, v["value"], got["total"], got["truncated"]) for v in got["values"]]
    return spark.createDataFrame(out, "fqn string, value string, total int, truncated boolean")


def tool_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric's SQL as the tool gives it, run unchanged by the other tool."""
    engine = _engine(spark, d, ("w.db.events",))
    m = engine.get_metric_definition(ANN, "error_rate", {"start": "2024-01-10T00:00:00Z", "end": "2024-01-20T00:00:00Z"})
    got = engine.execute_sql(ANN, m["dry_run_sql"])
    return spark.createDataFrame([(m["time_applied"], got["columns"][0]["name"], float(got["rows"][0][0]))], "time_applied boolean, name string, value double")


#: Statements of other forms: what each is for, and its text.
STATEMENTS = {
    "table": "TABLE region",
    "values": "VALUES (1, 'a'), (2, 'b'), (3, NULL)",
    "sample": "SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (100)",
    "only": "SELECT n_name FROM ONLY nation",
    "function": "SELECT * FROM range(7)",
    "capped": "SELECT o_orderkey FROM orders",
}


def tool_statements(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d, ("w.db.region", "w.db.lineitem", "w.db.nation", "w.db.orders"))
    out = []
    for name, text in STATEMENTS.items():
        got = engine.execute_sql(ANN, text)
        out.append((name, got["meta"]["row_count"], got["meta"]["truncated"], int(got["rows"][0][0]) if name == "sample" else None))
    return spark.createDataFrame(out, "statement string, row_count int, truncated boolean, value bigint")


def grant_expand_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every metric, concept, service, database and table as a target of its own user."""
    world = {name: materialize(df) for name, df in catalogue(spark, d).items() if name != "enum_values"}
    e = world["entities"].where("fqn NOT LIKE 'w%' AND fqn <> 'error_rate'")
    has = world["relations"].where("type = 'describes'").select(F.col("src_fqn").alias("fqn")).distinct()
    targets = e.where("kind IN ('service', 'database', 'table')").unionByName(e.join(has, "fqn", "left_semi").where("kind IN ('metric', 'concept')").select(e.columns))
    target = F.when(F.col("kind") == "table", F.col("fqn")).otherwise(F.concat_ws(":", "kind", "fqn"))
    return expand(world["entities"], world["relations"], targets.select(F.concat(F.lit("of "), "kind").alias("user_id"), target.alias("target")))


def embedding_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one model for every second customer, of an older one for every third."""
    e = catalogue(spark, d)["entities"]
    key = F.regexp_extract("fqn", r"customer-(\d+)$", 1)
    some = e.where((key != "") & (key.try_cast("bigint") % 6).isin(0, 2, 3, 4))
    have = _fit(some.select(F.col("fqn").alias("entity_fqn"), F.when(key.try_cast("bigint") % 2 == 0, "new").otherwise("old").alias("model")), "embeddings")
    n = embedding_targets(e, have, "new").agg(F.count(F.lit(1)).alias("n")).scalar()
    return embedding_coverage(e, have, "new").withColumn("n_targets", n)


def audit_problems(spark: SparkSession, d: str) -> DataFrame:
    """The log against what users saw, here the log's own rows of all but its first day."""
    log = table(spark, d, "tool_calls").withColumn("who", norm_key(F.col("user")))
    seen = log.where("kind = 'tool_call' AND log_day > date'2026-06-01'").select("who", "status")
    return audit(log, seen, "who").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_NAMES = """
n AS (SELECT n_nationkey, 'region-' || n_regionkey AS svc, 'region-' || n_regionkey || '.nation-' || n_nationkey AS db FROM nation),
c AS (SELECT *, db || '.customer-' || c_custkey AS tab, 'spend_' || lower(c_mktsegment) AS seg, 'nation_' || n_nationkey AS con FROM customer JOIN n ON c_nationkey = n_nationkey),
edges AS (
  SELECT DISTINCT 'contains' AS type, svc AS s, db AS t FROM n UNION SELECT 'contains', db, tab FROM c
  UNION SELECT 'describes', seg, tab FROM c WHERE c_acctbal > 5000 UNION SELECT 'describes', con, tab FROM c WHERE c_acctbal > 5000
  UNION SELECT 'describes', con, seg FROM c WHERE n_nationkey < 3 UNION SELECT 'describes', 'nation_3', 'w.db.lineitem.l_returnflag'),
first AS (SELECT svc, db, tab FROM c ORDER BY svc, db, tab LIMIT 1)
"""
_ENUM = " UNION ALL ".join(f"SELECT DISTINCT 'w.db.{t}.{x}' AS fqn, {x}::VARCHAR AS value FROM {t} WHERE {x} IS NOT NULL" for t, xs in ENUMS.items() for x in xs)

QUERIES = {
    "tool_get_entity": tool_get_entity,
    "tool_traverse": tool_traverse,
    "tool_enum_values": tool_enum_values,
    "tool_metric": tool_metric,
    "tool_statements": tool_statements,
    "grant_expand_kinds": grant_expand_kinds,
    "embedding_gaps": embedding_gaps,
    "audit_problems": audit_problems,
}

SQL = {
    "tool_get_entity": f"""WITH {_NAMES},
roots AS (SELECT svc AS f, 'service' AS kind FROM first UNION ALL SELECT db, 'database' FROM first UNION ALL SELECT tab, 'table' FROM first UNION ALL SELECT 'nation_3', 'concept'),
mine AS (SELECT f, kind, type, s, t, row_number() OVER (PARTITION BY f ORDER BY type, s, t) AS n, count(*) OVER (PARTITION BY f) AS total FROM roots JOIN edges ON s = f OR t = f)
SELECT f AS fqn, kind, type, CASE WHEN s = f THEN 'out' ELSE 'in' END AS direction, CASE WHEN s = f THEN t ELSE s END AS other, total > 100 AS truncated FROM mine WHERE n <= 100""",
    "tool_traverse": f"""WITH {_NAMES},
up AS (SELECT s, t FROM edges WHERE type = 'contains'),
near AS (
  SELECT svc AS start, 'out' AS direction, t AS node, 1 AS lv, s, t FROM first JOIN up ON s = svc
  UNION ALL SELECT svc, 'out', b.t, 2, b.s, b.t FROM first JOIN up a ON a.s = svc JOIN up b ON b.s = a.t
  UNION ALL SELECT db, 'both', CASE WHEN s = db THEN t ELSE s END, 1, s, t FROM first JOIN up ON s = db OR t = db
  UNION ALL SELECT tab, 'in', db, 1, db, tab FROM first UNION ALL SELECT tab, 'in', svc, 2, svc, db FROM first),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start, direction ORDER BY lv, s, t) AS r, count(*) OVER (PARTITION BY start, direction) AS total FROM near),
kept AS (SELECT start, direction, node, total > 199 AS truncated, least(total, 199)::INTEGER AS n_edges FROM ranked WHERE r <= 199)
SELECT * FROM kept UNION ALL SELECT DISTINCT start, direction, start, truncated, n_edges FROM kept""",
    "tool_enum_values": f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY value) AS r, count(*) OVER (PARTITION BY fqn) AS total FROM ({_ENUM})) SELECT fqn, value, total::INTEGER AS total, total > 100 AS truncated FROM v WHERE r <= 100",
    "tool_metric": "SELECT true AS time_applied, 'error_rate' AS name, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*), 0), 6) AS value FROM events WHERE (value >= 1 OR value < 0.5) AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "tool_statements": """SELECT 'table' AS statement, (SELECT count(*) FROM region)::INTEGER AS row_count, false AS truncated, NULL::BIGINT AS value UNION ALL SELECT 'values', 3, false, NULL
UNION ALL SELECT 'sample', 1, false, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'only', (SELECT count(*) FROM nation), false, NULL UNION ALL SELECT 'function', 7, false, NULL
UNION ALL SELECT 'capped', least((SELECT count(*) FROM orders), 500), (SELECT count(*) > 500 FROM orders), NULL""",
    "grant_expand_kinds": f"""WITH {_NAMES},
d AS (SELECT s, t FROM edges WHERE type = 'describes')
SELECT DISTINCT 'of table' AS user_id, tab AS table_fqn FROM c UNION SELECT 'of service', tab FROM c UNION SELECT 'of database', tab FROM c
UNION SELECT 'of metric', t FROM d WHERE s IN (SELECT seg FROM c) UNION SELECT 'of concept', t FROM d WHERE s IN (SELECT con FROM c) AND t IN (SELECT tab FROM c)
UNION SELECT 'of concept', b.t FROM d a JOIN d b ON a.t = b.s WHERE a.s IN (SELECT con FROM c) UNION SELECT 'of concept', 'w.db.lineitem' FROM c WHERE con = 'nation_3'""",
    "embedding_gaps": f"""WITH {_NAMES}, e AS (SELECT DISTINCT svc AS f FROM n UNION SELECT db FROM n UNION SELECT tab FROM c UNION SELECT seg FROM c UNION SELECT con FROM c),
l AS (SELECT count(*) + {5 + len(ENUMS) + sum(map(len, ENUMS.values()))} AS n FROM e), v AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 6 = 3) AS old, count(*) FILTER (c_custkey % 2 = 0) AS new FROM c WHERE c_custkey % 6 IN (0, 2, 3, 4))
SELECT l.n AS n_live, v.n AS n_vectors, greatest(l.n - v.n, 0) AS n_missing, v.old AS n_mismatch, l.n - v.new AS n_targets FROM l, v""",
    "audit_problems": """WITH a AS (SELECT lower(trim("user", ' ')) AS k, count(*) AS n, max(status) AS s FROM tool_calls WHERE kind = 'tool_call' GROUP BY 1),
b AS (SELECT lower(trim("user", ' ')) AS k, count(*) AS m, max(status) AS t FROM tool_calls WHERE kind = 'tool_call' AND log_day > DATE '2026-06-01' GROUP BY 1),
p AS (SELECT CASE WHEN n IS NULL THEN 'unlogged' WHEN m IS NULL THEN 'unobserved' WHEN n <> m THEN 'twice' WHEN s IS DISTINCT FROM t THEN 'status' END AS problem FROM a FULL JOIN b ON a.k = b.k)
SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
}

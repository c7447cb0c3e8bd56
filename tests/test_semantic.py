"""The catalogue from YAML to search, and the tools around it."""

from __future__ import annotations

import json
import threading
import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from halyard.config import Config, Route
from halyard.errors import EngineError
from halyard.execute import Caller, Engine
from halyard.records.log import CallLog, read_log
from halyard.semantic.compile import compile_catalog
from halyard.semantic.credentials import create_key, revoke_key, user_of
from halyard.semantic.graph import traverse
from halyard.semantic.metric import metric_sql
from halyard.semantic.model import KEYS, CatalogError
from halyard.semantic.search import fuse, keyword_hits
from halyard.semantic.store import Store
from halyard.semantic.sync import apply_grants, change_grant, sync
from halyard.sources.yaml_files import load_catalog, load_grants, load_manifest

SERVICE = """
version: 1
service: shop
description: the shop
databases:
  - name: main
    description: sales
    tables:
      - name: orders
        description: orders of customers
        columns:
          - {name: o_orderkey, type: bigint}
          - {name: o_orderdate, type: timestamp, is_time: true}
          - name: o_orderstatus
            type: char(1)
            description: state of the order
            enum_values: [{value: O, label: open}, {value: F, label: finished}]
        references:
          - {to: shop.main.customer, "on": orders.o_custkey = customer.c_custkey}
      - name: customer
        description: who buys
        columns: [{name: c_custkey, type: bigint}]
      - name: lineitem
        description: positions of orders
"""
METRICS = """
version: 1
metrics:
  - {name: open_rate, description: share of open orders, expression: "count(*) FILTER (WHERE o_orderstatus = 'O')::numeric / NULLIF(count(*), 0)", aggregation: ratio, filter: "o_totalprice > 0 OR o_totalprice IS NULL", tables: [shop.main.orders]}
"""
CONCEPTS = """
version: 1
concepts:
  - {name: open_order, description: an order not yet finished, describes: [shop.main.orders.o_orderstatus, open_rate]}
  - {name: buyer, description: the customer who orders, describes: [shop.main.customer]}
"""
GRANTS = """
version: 1
grants:
  - {user: ann, tables: ["concept:open_order", shop.main.customer]}
  - {user: bob, tables: ["database:shop.main"]}
"""
ANN, EVE = Caller("ann", "hk_ann"), Caller("eve", "hk_eve")


def write(root, service=SERVICE, metrics=METRICS, concepts=CONCEPTS):
    (root / "services").mkdir(parents=True, exist_ok=True)
    (root / "services/shop.yaml").write_text(service)
    (root / "metrics.yaml").write_text(metrics)
    (root / "concepts.yaml").write_text(concepts)
    return str(root)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    sync(spark, s, write(tmp_path / "yaml"))
    return s


@pytest.fixture
def engine(spark, store, tmp_path):
    apply_grants(spark, store, GRANTS)
    c = Config(routes={"main": Route("main", "shop", DATA)})
    return Engine(spark, c, store, log=CallLog(str(tmp_path / "log")))


def refused(kind_or_reason, f, *a, **k):
    with pytest.raises(EngineError) as e:
        f(*a, **k)
    assert kind_or_reason in {e.value.kind, e.value.reason}
    return e.value


def test_sync_is_idempotent_and_revives(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    root = tmp_path / "yaml"
    dry = sync(spark, s, write(root), dry_run=True)
    assert dry.changes["entities"]["added"] == 12 and s.read("entities").count() == 0
    assert sync(spark, s, str(root)).total == dry.total
    at = {r.fqn: r.updated_at for r in s.read("entities").collect()}
    again = sync(spark, s, str(root))
    assert again.total == 0
    less = SERVICE.replace("      - name: lineitem\n        description: positions of orders\n", "").replace("label: open", "label: still open")
    changed = sync(spark, s, write(root, less)).changes
    assert changed == {"entities": {"deleted": 1}, "relations": {"deleted": 1}, "enum_values": {"updated": 1}}
    rows = {r.fqn: r for r in s.read("entities").collect()}
    assert rows["shop.main.lineitem"].tombstone and rows["shop"].updated_at == at["shop"]
    assert sync(spark, s, write(root)).changes["entities"] == {"added": 1}
    assert not {r.fqn: r for r in s.read("entities").collect()}["shop.main.lineitem"].tombstone
    assert s.vacuum() > 0 and s.read("entities").count() == 12


@pytest.mark.parametrize(
    "part,old,new",
    [
        ("service", "- name: lineitem", "- name: customer"),
        ("service", "to: shop.main.customer", "to: shop.main.absent"),
        ("service", "value: F", "value: O"),
        ("service", "value: F", 'value: ""'),
        ("service", "type: bigint}", "type: bigint, colour: red}"),
        ("service", "orders.o_custkey = customer.c_custkey", "o_custkey = = c"),
        ("service", "version: 1", "version: 2"),
        ("service", "name: orders", "name: or.ders"),
        ("metrics", "count(*), 0)", "count(*), 0"),
        ("metrics", "IS NULL", "IS NULL; DROP TABLE x"),
        ("metrics", "[shop.main.orders]", "[shop.main]"),
        ("concepts", "open_rate]", "nothing]"),
        ("concepts", "name: buyer", "name: open_rate"),
    ],
)
def test_bad_catalogues(spark, tmp_path, part, old, new):
    text = {"service": SERVICE, "metrics": METRICS, "concepts": CONCEPTS}
    assert old in text[part]
    text[part] = text[part].replace(old, new)
    with pytest.raises(CatalogError):
        compile_catalog(spark, load_catalog(write(tmp_path, **text)))


def test_sources(tmp_path):
    with pytest.raises(CatalogError):
        load_catalog(str(tmp_path / "absent"))
    assert load_catalog(str(tmp_path)) == {"services": [], "metrics": [], "concepts": []}
    with pytest.raises(CatalogError):
        load_grants("version: 1\ngrants: [{user: a, tables: [x.y.z, x.y.z]}]")
    with pytest.raises(CatalogError):
        load_grants("version: 1\ngrants: [{user: a, table: [x.y.z]}]")
    assert load_manifest("version: 1\nservices: [{name: a, dir: x/y, db: d}, {name: b, dir: z}]")[1]["db"] == ""
    for bad in ("{name: A b, dir: x}", "{name: a, dir: /x}", "{name: a, dir: x/../y}", "{name: a}"):
        with pytest.raises(CatalogError):
            load_manifest(f"version: 1\nservices: [{bad}]")


def test_grants(spark, store):
    assert store.revision == 0
    assert apply_grants(spark, store, GRANTS) == {"added": 5, "removed": 0} and store.revision == 1
    pairs = {(r.user_id, r.table_fqn) for r in store.read("grants").collect()}
    assert pairs == {("ann", "shop.main.orders"), ("ann", "shop.main.customer"), ("bob", "shop.main.orders"), ("bob", "shop.main.customer"), ("bob", "shop.main.lineitem")}
    assert apply_grants(spark, store, GRANTS) == {"added": 0, "removed": 0} and store.revision == 1
    assert change_grant(spark, store, "ann", "metric:open_rate", True) == {"added": 0, "removed": 0} and store.revision == 1
    assert change_grant(spark, store, "ann", "shop.main.customer", False)["removed"] == 1 and store.revision == 2
    refused("empty_target", apply_grants, spark, store, "version: 1\ngrants: [{user: a, tables: ['service:none']}]")
    refused("empty_target", apply_grants, spark, store, "version: 1\ngrants: [{user: a, tables: [shop.main.none]}]")
    for bad in ("*", "shop.*", "shop.main", "metric:a.b", "database:x", "what:x"):
        refused("bad_target", change_grant, spark, store, "a", bad, True)
    assert store.revision == 2


def test_new_tables_need_a_new_grant(spark, store, tmp_path):
    apply_grants(spark, store, GRANTS)
    more = SERVICE + "      - {name: events, description: new}\n"
    r = sync(spark, store, write(tmp_path / "yaml", more))
    assert any("bob" in w and "shop.main.events" in w for w in r.warnings)
    less = SERVICE.replace("      - name: lineitem\n        description: positions of orders\n", "")
    r = sync(spark, store, write(tmp_path / "yaml", less))
    assert any("bob" in w and "shop.main.lineitem" in w and "no table" in w for w in r.warnings)


def test_sql(engine, tmp_path):
    r = engine.execute_sql(ANN, "SELECT o_orderstatus, count(*) AS n, avg(o_totalprice)::numeric(12,2) AS a, max(o_orderdate) AS d FROM public.orders GROUP BY 1 ORDER BY 1 -- end", plan_id="p1")
    assert [c["type"] for c in r["columns"]] == ["string", "bigint", "decimal(12,2)", "timestamp_ntz"]
    assert isinstance(r["rows"][0][2], str) and r["meta"]["row_count"] == len(r["rows"]) and not r["meta"]["truncated"]
    r = engine.execute_sql(ANN, "SELECT o_orderkey AS a, o_custkey AS a FROM orders;")
    assert len(r["rows"]) == 500 and r["meta"]["truncated"] and len(r["rows"][0]) == 2
    refused("not_granted", engine.execute_sql, ANN, "SELECT * FROM lineitem")
    refused("not_granted", engine.execute_sql, EVE, "SELECT * FROM orders")
    refused("not_granted", engine.execute_sql, ANN, "WITH lineitem AS (SELECT * FROM lineitem) SELECT * FROM lineitem")
    refused("unknown_table", engine.execute_sql, ANN, f"SELECT * FROM parquet.`{DATA}/lineitem.parquet`")
    refused("non_select", engine.execute_sql, ANN, "DROP TABLE orders")
    refused("syntax_error", engine.execute_sql, ANN, "SELECT a FROM t WHERE GROUP x y")
    refused("engine_error", engine.execute_sql, ANN, "SELECT nothing FROM orders")
    refused("engine_error", engine.execute_sql, ANN, "SELECT 1 / 0")
    refused("unknown_dbname", engine.execute_sql, ANN, "SELECT 1", dbname="x")
    refused("empty", engine.execute_sql, ANN, "  ")
    log = read_log(engine.spark, str(tmp_path / "log"))
    rows = log.orderBy("ts").collect()
    assert [x.status for x in rows] == ["success", "success", *["rejected"] * 5, "parse_error", *["rejected"] * 4]
    assert rows[0].plan_id == "p1" and rows[0].stages_ms.keys() == {"parse", "perm", "exec"} and rows[2].reject.details["reason"] == "not_granted"
    assert json.loads(rows[0].params)["sql"].startswith("SELECT")


def test_sql_timeout(spark, store):
    apply_grants(spark, store, GRANTS)
    e = Engine(spark, Config(routes={"main": Route("main", "shop", DATA)}, timeout_ms=1500), store)
    slow = "SELECT count(*) FROM (SELECT a.id FROM range(0, 60000, 1, 64) a JOIN range(60000) b ON a.id <> b.id AND hash(a.id, b.id) = 1) t"
    t = time.monotonic()
    assert refused("timeout", e.execute_sql, ANN, slow).kind == "invalid_request"
    assert time.monotonic() - t < 30
    assert e.execute_sql(ANN, "SELECT 1 AS x")["rows"] == [[1]]


def test_gate_refuses_at_once(engine):
    with engine.gate.slot(ANN.key), engine.gate.slot(ANN.key):
        t = time.monotonic()
        refused("key_concurrency_limit", engine.execute_sql, ANN, "SELECT 1")
        assert time.monotonic() - t < 1
    out = []
    ts = [threading.Thread(target=lambda: out.append(engine.execute_sql(ANN, "SELECT count(*) AS n FROM orders")["rows"])) for _ in range(2)]
    [x.start() for x in ts]
    [x.join() for x in ts]
    assert out[0] == out[1]


def test_catalogue_tools(engine):
    e = engine.get_entity(ANN, "shop.main.orders.o_orderstatus")
    assert e["entity"]["data_type"] == "char(1)" and [v["value"] for v in e["enum_values"]] == ["F", "O"] and not e["enum_truncated"]
    assert e["relations"] == {"contains": {"out": [], "in": ["shop.main.orders"]}, "describes": {"out": [], "in": ["open_order"]}}
    assert engine.list_enum_values(ANN, "shop.main.orders.o_orderstatus")["total"] == 2
    refused("wrong_kind", engine.list_enum_values, ANN, "shop.main.orders")
    refused("not_found", engine.get_entity, ANN, "shop.main.absent")
    refused("too_long", engine.get_entity, ANN, "x" * 513)
    m = engine.get_metric_definition(ANN, "open_rate", {"start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z"})
    assert m["time_applied"] and m["tables"] == ["shop.main.orders"]
    assert m["dry_run_sql"].endswith("FROM orders WHERE (o_totalprice > 0 OR o_totalprice IS NULL) AND orders.o_orderdate >= TIMESTAMP '2024-01-01T00:00:00Z' AND orders.o_orderdate < TIMESTAMP '2024-02-01T00:00:00Z'")
    for bad in ({"start": "2024-02-01T00:00:00Z", "end": "2024-01-01T00:00:00Z"}, {"start": "x", "end": "y"}, {"start": "2024-01-01T00:00:00Z"}, {"start": "2024-01-01T00:00:00", "end": "2024-02-01T00:00:00Z"}):
        refused("bad_time", engine.get_metric_definition, ANN, "open_rate", bad)
    refused("wrong_kind", engine.get_metric_definition, ANN, "buyer")
    t = engine.traverse_relations(ANN, "shop", "connects_to")
    assert t["nodes"] == ["shop", "shop.main"] and t["edges"][0]["dst"] == "shop.main" and not t["truncated"]
    t = engine.traverse_relations(ANN, "shop.main.customer", "references", "in")
    assert t["edges"] == [{"type": "references", "src": "shop.main.orders", "dst": "shop.main.customer", "meta": "orders.o_custkey = customer.c_custkey"}]
    refused("bad_relation", engine.traverse_relations, ANN, "shop", "x")
    refused("bad_direction", engine.traverse_relations, ANN, "shop", "contains", "up")
    refused("bad_depth", engine.traverse_relations, ANN, "shop", "contains", "out", -1)
    assert engine.traverse_relations(ANN, "shop", "connects_to", "out", 9)["truncated"]
    assert engine.self_check() == []


def test_search(spark, store, engine):
    found = engine.search_entities(ANN, "order")
    assert {h["fqn"] for h in found["hits"]} == {"open_rate", "open_order", "buyer"} and found["total"] == 3
    assert [h["fqn"] for h in engine.search_entities(ANN, "order finished")["hits"]] == ["open_order"]
    assert [h["fqn"] for h in engine.search_entities(ANN, "ORDER x yz", "metric")["hits"]] == ["open_rate"]
    assert engine.search_entities(ANN, "o_")["total"] == 0 and engine.search_entities(ANN, "_o")["hits"][0]["fqn"] == "open_order"
    refused("bad_type", engine.search_entities, ANN, "x", "table")
    refused("too_long", engine.search_entities, ANN, "x" * 257)
    words = ["open", "customer", "order", "share"]
    embed = lambda texts: [[float(t.lower().count(w)) for w in words] for t in texts]
    sync(spark, store, str(store.root.parent / "yaml"), embed=embed, model="m1")
    assert store.read("embeddings").count() == 12
    assert sync(spark, store, str(store.root.parent / "yaml"), embed=embed, model="m1").embedded == 0
    e = Engine(spark, engine.config, store, embed=embed)
    hits = [h["fqn"] for h in e.search_entities(ANN, "customer who")["hits"]]
    assert hits[0] == "buyer" and set(hits) == {"buyer", "open_order", "open_rate"}

    def broken(texts):
        raise OSError("down")

    assert Engine(spark, engine.config, store, embed=broken).search_entities(ANN, "order")["total"] == 3
    assert sync(spark, store, str(store.root.parent / "yaml"), embed=broken, model="m2").warnings


def test_any_keyword_hit_is_before_vector_hits(spark):
    kw = spark.range(1, 51).select(F.concat(F.lit("k"), "id").alias("fqn"), F.col("id").cast("int").alias("kw_rank"))
    vec = spark.range(1, 51).select(F.concat(F.lit("v"), "id").alias("fqn"), F.col("id").cast("int").alias("vec_rank"))
    rows = fuse(kw, vec, "fqn", 60).collect()
    assert [r.fqn for r in rows[:51]] == [f"k{n}" for n in range(1, 51)] + ["v1"]


def test_kinds_are_filtered_before_the_cap(spark):
    cols = "fqn string, kind string, name string, description string, tombstone boolean"
    rows = [(f"t{n:03}", "table", "x", "payment", False) for n in range(200)] + [("m", "metric", "x", "payment payment long text here", False), ("dead", "metric", "x", "payment", True)]
    assert [r.fqn for r in keyword_hits(spark.createDataFrame(rows, cols), "payment").collect()] == ["m"]


def test_traversal_limits(spark):
    rows = [("contains", "root", f"n{i:04}", "", False) for i in range(300)] + [("contains", f"n{i:04}", "root", "", False) for i in range(300)] + [("contains", "n0000", "n0001", "", False), ("contains", "n0000", "gone", "", True), ("references", "root", "r", "", False)]
    rel = spark.createDataFrame(rows, "type string, src_fqn string, dst_fqn string, meta string, tombstone boolean")
    g = traverse(rel, "root", "contains", "both", 2)
    assert g.truncated and len(g.nodes) == 200 and {e["src"] for e in g.edges} | {e["dst"] for e in g.edges} <= set(g.nodes)
    assert g.nodes[0] == "n0000" and g.nodes[198] == "n0198" and {"type": "contains", "src": "n0000", "dst": "n0001", "meta": ""} in g.edges
    assert traverse(rel, "absent", "contains").nodes == ["absent"]
    chain = spark.createDataFrame([("contains", f"c{i}", f"c{i + 1}", "", False) for i in range(9)], "type string, src_fqn string, dst_fqn string, meta string, tombstone boolean")
    g = traverse(chain, "c0", "contains", "out", 5)
    assert g.nodes == [f"c{i}" for i in range(6)] and not g.truncated


def test_metric_notes():
    m = metric_sql("x", "sum(a)", "", ["s.d.t", "s.d.u"], {"s.d.t": ["s.d.t.b", "s.d.t.a"]}, ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"))
    assert len(m.notes) == 3 and "t.a >=" in m.sql and m.time_applied


def test_credentials_and_backup(spark, store, tmp_path):
    key = create_key(store, "ann")
    assert user_of(store, key) == "ann" and key not in str(store.read("credentials").collect())
    assert revoke_key(store, key) == 1 and revoke_key(store, key) == 0
    refused("unauthorized", user_of, store, key)
    store.backup(str(tmp_path / "copy"))
    copy = Store(spark, str(tmp_path / "copy"))
    assert all(copy.read(n).count() == store.read(n).count() for n in KEYS)
    refused("same_path", store.backup, str(store.root))
    refused("exists", store.backup, str(tmp_path / "copy"))

"""Structure from migrations, drafts, and findings."""

from __future__ import annotations

import json

import pytest
import yaml

from halyard.catalog.check import calibrate, cross_check, exit_code, live_columns, ordered
from halyard.catalog.ddl import auto_name, migration_files, replay
from halyard.catalog.draft import draft, merge_documents, render
from halyard.semantic.model import CatalogError

M1 = """
-- first
CREATE TABLE IF NOT EXISTS users (
  id BIGSERIAL PRIMARY KEY,
  name varchar(36) NOT NULL DEFAULT 'a, (b)',
  state text CHECK (state IN ('on', 'off', '')),
  price numeric(12, 2)
);
CREATE TABLE sales.orders (
  id bigint,
  user_id bigint REFERENCES users (id) ON DELETE CASCADE,
  kind character varying(10) NOT NULL,
  CONSTRAINT kinds CHECK (kind = ANY (ARRAY['x'::text, 'y'::text])),
  CHECK (price > 0),
  CONSTRAINT fk_self FOREIGN KEY (id, kind) REFERENCES orders (id, kind)
);
CREATE INDEX i ON users (name);
"""
M2 = """
ALTER TABLE users ADD COLUMN IF NOT EXISTS age int, ADD COLUMN born timestamp with time zone NOT NULL, DROP COLUMN price;
ALTER TABLE ONLY orders DROP CONSTRAINT IF EXISTS kinds, ADD CONSTRAINT kinds CHECK (kind IN ('z'));
ALTER TABLE users ALTER COLUMN name TYPE varchar(64) USING name::varchar;
ALTER TABLE users RENAME COLUMN a TO b;
ALTER TABLE absent ADD COLUMN x int;
CREATE TABLE IF NOT EXISTS users (id int);
CREATE TABLE gone (id int); DROP TABLE IF EXISTS gone, never;
COMMENT ON TABLE users IS 'CREATE TABLE no (id int);';
"""


def test_replay():
    s = replay([M1, M2])
    assert s.tables["users"].columns == {"id": "BIGSERIAL", "name": "varchar(64)", "state": "text", "age": "int", "born": "timestamp with time zone"}
    assert s.tables["orders"].schema == "sales" and s.tables["orders"].columns["kind"] == "character varying(10)"
    assert s.tables["users"].enums() == {"state": ["on", "off"]} and s.tables["orders"].enums() == {"kind": ["z"]}
    assert s.edges() == [("orders", "orders", "orders.id = orders.id AND orders.kind = orders.kind"), ("orders", "users", "orders.user_id = users.id")]
    assert s.counts() == {"tables": 2, "columns": 8, "enums": 2, "references": 2}
    assert len(s.warnings) == 3
    assert replay([M1, "ALTER TABLE orders DROP CONSTRAINT orders_user_id_fkey; ALTER TABLE users DROP COLUMN state"]).counts()["references"] == 1
    assert replay([]).counts()["tables"] == 0
    assert auto_name("t" * 70, "c", "fkey") == "t" * 63 and auto_name("t", "c", "fkey") == "t_c_fkey"


def test_migration_files(tmp_path):
    for n in ("2_b.up.sql", "1_a.up.sql", "1_a.down.sql", "x.sql"):
        (tmp_path / n).write_text("")
    (tmp_path / "sub.up.sql").mkdir()
    assert [p.name for p in migration_files(str(tmp_path))] == ["1_a.up.sql", "2_b.up.sql"]


def test_draft_and_merge():
    new = draft("svc", "db", replay([M1, M2]))
    text = render(new)
    assert text == render(draft("svc", "db", replay([M1, M2]))) and yaml.safe_load(text) == new
    old = yaml.safe_load(text)
    users = next(t for t in old["databases"][0]["tables"] if t["name"] == "users")
    old["description"], users["description"] = "the service", "people"
    for c in users["columns"]:
        if c["name"] == "born":
            c["is_time"] = True
        if c["name"] == "age":
            c |= {"is_time": True, "type": "date", "description": "years"}
        if c["name"] == "state":
            c["enum_values"][0]["label"] = "switched on"
    m = merge_documents(new, old)
    cols = {c["name"]: c for c in next(t for t in m["databases"][0]["tables"] if t["name"] == "users")["columns"]}
    assert m["description"] == "the service" and cols["born"]["is_time"] and "is_time" not in cols["age"] and cols["age"]["description"] == "years"
    assert cols["state"]["enum_values"] == [{"value": "on", "label": "switched on"}, {"value": "off"}]
    assert merge_documents(m, m) == m and "databases" not in draft("svc", "", replay([]))
    with pytest.raises(CatalogError):
        merge_documents(new, old | {"service": "other"})


def test_findings(spark):
    cols = "schema string, table string, column string, type string"
    d = spark.createDataFrame([("p", "t", "a", "VARCHAR(36)"), ("p", "t", "b", "int8"), ("p", "t", "c", "timestamptz"), ("p", "t", "d", "numeric(12, 2)")], cols)
    v = spark.createDataFrame([("p", "t", "a", "character varying(36)"), ("p", "t", "b", "integer"), ("p", "t", "d", "numeric(12,2)"), ("p", "t", "e", "text")], cols)
    got = [(r.severity, r.message) for r in ordered(calibrate(d, v)).collect()]
    assert got == [("error", "p.t.c isn't in the database"), ("warn", "p.t.b is bigint in the draft and integer in the database"), ("warn", "p.t.e isn't in the draft")]
    assert exit_code(calibrate(d, v)) == 2 and exit_code(calibrate(v, v)) == 0
    models = spark.createDataFrame([("t", "a", "varchar(36)"), ("t", "z", None), ("t", "b", None)], "table string, column string, type string")
    got = [(r.severity, r.message) for r in ordered(cross_check(d, models)).collect()]
    assert got == [("error", "t.z is only in the model"), ("warn", "t.c is only in the migrations"), ("warn", "t.d is only in the migrations")]
    assert live_columns(spark, {"t": v}).count() == 4


def test_scan_against_models(spark, tmp_path, monkeypatch, capsys):
    """Exit codes of scan: 0, 2 with an error among the findings, 1 if it can't be run."""
    from halyard import cli

    monkeypatch.setattr(cli, "make_session", lambda master=None: spark)
    (tmp_path / "shop" / "migrations").mkdir(parents=True)
    (tmp_path / "shop" / "migrations" / "1.up.sql").write_text("CREATE TABLE goods (id bigint, price numeric(8,2));")
    (tmp_path / "m.yaml").write_text("version: 1\nservices:\n  - {name: shop, dir: shop, db: main}\n")
    models = tmp_path / "models.json"

    def scan(*columns):
        models.write_text("\n".join(json.dumps({"service": "shop", "table": "goods", "column": c, "type": t}) for c, t in columns))
        return cli.main(["scan", str(tmp_path / "m.yaml"), str(tmp_path), str(tmp_path / "out"), "--models", str(models)])

    assert scan(("id", "int8"), ("price", None)) == 0 and "warn" not in capsys.readouterr().out
    assert scan(("id", "text"), ("price", None)) == 0 and "shop.goods.id is bigint" in capsys.readouterr().out
    assert scan(("id", "bigint"), ("colour", "text")) == 2 and "error shop.goods.colour is only in the model" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path / "absent.yaml"), str(tmp_path), str(tmp_path / "out")]) == 1
    assert cli.embedder("json:loads") is json.loads and cli.embedder(None) is None
    with pytest.raises(AttributeError):
        cli.embedder("json:nothing")

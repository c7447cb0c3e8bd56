"""From the authors' YAML to entities, relations and enum values.

What people write by hand fits the driver; what follows (diff, apply, search)
works on DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from halyard.guard.dialect import rewrite
from halyard.guard.lexer import statements
from halyard.semantic.model import ENTITY, ENUM, RELATION, CatalogError, check_fqn, check_segment
from halyard.sources.yaml_files import known


@dataclass
class Target:
    """Everything the catalogue should hold."""

    entities: dict[str, dict[str, Any]] = field(default_factory=dict)
    relations: dict[tuple[str, str, str], str] = field(default_factory=dict)
    enums: dict[tuple[str, str], str] = field(default_factory=dict)

    def add(self, fqn: str, kind: str, name: str, **more: Any) -> str:
        if fqn in self.entities:
            raise CatalogError(f"{fqn} is defined twice", fqn=fqn)
        blank = dict.fromkeys(("description", "data_type", "pg_schema", "expression", "aggregation", "filter"), "") | {"is_time": False}
        self.entities[fqn] = {"fqn": fqn, "kind": kind, "name": name} | blank | {k: v for k, v in more.items() if v is not None}
        return fqn

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        names = [c.split()[0] for c in ENTITY.split(", ")]
        return {
            "entities": spark.createDataFrame([tuple(e[n] for n in names) for e in self.entities.values()], ENTITY),
            "relations": spark.createDataFrame([(*k, m) for k, m in self.relations.items()], RELATION),
            "enum_values": spark.createDataFrame([(*k, v) for k, v in self.enums.items()], ENUM),
        }


def _parses(spark: SparkSession, text: str, where: str) -> None:
    """Whether a fragment is one expression and nothing else."""
    try:
        if len(statements(text)) != 1:
            raise ValueError
        spark._jsparkSession.sessionState().sqlParser().parseExpression(rewrite(text))
    except Exception:
        raise CatalogError(f"{where}: not an expression: {text}", fragment=text) from None


def compile_catalog(spark: SparkSession, raw: dict[str, list[dict[str, Any]]]) -> Target:
    """Both passes: first all entities, then what refers to them, so that order
    doesn't matter. A full name given twice, a reference to what isn't there or has
    the wrong kind, an empty or repeated enum value and a fragment that isn't an
    expression are errors."""
    t = Target()
    later: list[tuple[str, str, str, str, tuple[str, ...]]] = []
    for s in raw["services"]:
        service = t.add(check_segment(s.get("service"), "service"), "service", s["service"], description=s.get("description"))
        for d in s.get("databases") or []:
            d = known(d, "database", service)
            db = t.add(f"{service}.{check_segment(d.get('name'), service)}", "database", d["name"], description=d.get("description"))
            t.relations["connects_to", service, db] = ""
            for x in d.get("tables") or []:
                _table(spark, t, db, known(x, "table", db), later)
    for m in raw["metrics"]:
        name = check_segment(m.get("name"), "metric")
        _parses(spark, m.get("expression") or "", name)
        if m.get("filter"):
            _parses(spark, m["filter"], name)
        t.add(name, "metric", name, description=m.get("description"), expression=m["expression"], aggregation=m.get("aggregation"), filter=m.get("filter"))
        later += [("describes", name, x, "", ("table",)) for x in m.get("tables") or []]
    for c in raw["concepts"]:
        name = t.add(check_segment(c.get("name"), "concept"), "concept", c["name"], description=c.get("description"))
        later += [("describes", name, x, "", ("table", "column", "metric")) for x in c.get("describes") or []]
    for kind, src, dst, meta, wanted in later:
        e = t.entities.get(dst)
        if e is None or e["kind"] not in wanted:
            raise CatalogError(f"{src}: {dst} is no {' or '.join(wanted)}", fqn=dst)
        t.relations[kind, src, dst] = meta
    return t


def _table(spark: SparkSession, t: Target, db: str, x: dict[str, Any], later: list) -> None:
    fqn = t.add(f"{db}.{check_segment(x.get('name'), db)}", "table", x["name"], description=x.get("description"), pg_schema=x.get("schema"))
    t.relations["contains", db, fqn] = ""
    for c in x.get("columns") or []:
        c = known(c, "column", fqn)
        col = t.add(f"{fqn}.{check_segment(c.get('name'), fqn)}", "column", c["name"], description=c.get("description"), data_type=c.get("type"), is_time=bool(c.get("is_time")))
        t.relations["contains", fqn, col] = ""
        for v in c.get("enum_values") or []:
            v = known(v, "enum", col)
            value = str(v.get("value") if v.get("value") is not None else "")
            if not value or (col, value) in t.enums:
                raise CatalogError(f"{col}: enum value {value!r} is empty or given twice", fqn=col)
            t.enums[col, value] = v.get("label") or ""
    for r in x.get("references") or []:
        r = known(r, "reference", fqn)
        if r.get("on"):
            _parses(spark, r["on"], fqn)
        later.append(("references", fqn, check_fqn(r.get("to") or "", 3), r.get("on") or "", ("table",)))

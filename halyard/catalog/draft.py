"""Drafts of the catalogue: rendering, and merging a new one into what people added."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.catalog.ddl import Structure
from halyard.semantic.model import CatalogError
from halyard.sources.yaml_files import VERSION, yaml


def draft(service: str, db: str, s: Structure) -> dict[str, Any]:
    """The YAML document of a service: tables and references in order of name, columns as declared."""
    doc: dict[str, Any] = {"version": VERSION, "service": service}
    if not db:
        return doc
    edges = s.edges()
    tables = []
    for t in sorted(s.tables.values(), key=lambda t: t.name):
        enums = t.enums()
        one: dict[str, Any] = {"name": t.name, "schema": t.schema, "columns": []}
        for c, kind in t.columns.items():
            one["columns"].append({"name": c, "type": kind} | ({"enum_values": [{"value": v} for v in enums[c]]} if enums.get(c) else {}))
        refs = [{"to": f"{service}.{db}.{b}", "on": on} for a, b, on in edges if a == t.name]
        tables.append(one | ({"references": refs} if refs else {}))
    return doc | {"databases": [{"name": db, "tables": tables}]}


def render(doc: dict[str, Any]) -> str:
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True, indent=2, width=10_000)


def _norm(kind: str | None) -> str:
    return " ".join((kind or "").lower().split())


def merge_documents(new: dict[str, Any], old: dict[str, Any]) -> dict[str, Any]:
    """Structure from `new`; descriptions, labels and is_time from `old`, the last
    only where the type is the same. Documents of different services can't be merged."""
    if new.get("service") != old.get("service"):
        raise CatalogError(f"drafts of {new.get('service')} and {old.get('service')}")

    def described(n: dict, o: dict | None) -> dict:
        return n | ({"description": o["description"]} if o and o.get("description") else {})

    by = lambda xs: {x["name"]: x for x in xs or []}
    out = described(new, old)
    dbs = by(old.get("databases"))
    out["databases"] = []
    for d in new.get("databases") or []:
        od = dbs.get(d["name"], {})
        tables = []
        for t in d.get("tables") or []:
            ot = by(od.get("tables")).get(t["name"], {})
            columns = []
            for c in t.get("columns") or []:
                oc = by(ot.get("columns")).get(c["name"], {})
                m = described(c, oc)
                if oc.get("is_time") and _norm(oc.get("type")) == _norm(c.get("type")):
                    m["is_time"] = True
                labels = {v["value"]: v.get("label") for v in oc.get("enum_values") or []}
                if c.get("enum_values"):
                    m["enum_values"] = [v | ({"label": labels[v["value"]]} if labels.get(v["value"]) else {}) for v in c["enum_values"]]
                columns.append(m)
            tables.append(described(t, ot) | {"columns": columns})
        out["databases"].append(described(d, od) | {"tables": tables})
    if not out["databases"]:
        del out["databases"]
    return out


def merge_columns(new: DataFrame, old: DataFrame) -> DataFrame:
    """The same for rows: columns fqn and type of `new`; description and is_time of
    `old` (fqn, type, description, is_time), the latter only for an equal type."""
    o = old.select("fqn", F.col("type").alias("old_type"), "description", "is_time")
    same = F.lower(F.trim("type")) == F.lower(F.trim("old_type"))
    return new.select("fqn", "type").join(o, "fqn", "left").select("fqn", "type", "description", F.coalesce(F.col("is_time") & same, F.lit(False)).alias("is_time"))

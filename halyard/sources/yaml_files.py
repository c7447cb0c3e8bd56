"""YAML sources: the catalogue, grants and manifests. Unknown fields are errors."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from halyard.semantic.model import CatalogError

try:
    import yaml
except ImportError:  # read of YAML isn't possible then
    yaml = None

VERSION = 1
# fixed values: the fields of each part of a file
FIELDS = {
    "service": {"version", "service", "description", "databases"},
    "database": {"name", "description", "tables"},
    "table": {"name", "description", "schema", "columns", "references"},
    "column": {"name", "type", "description", "is_time", "enum_values"},
    "enum": {"value", "label"},
    "reference": {"to", "on"},
    "metrics": {"version", "metrics"},
    "metric": {"name", "description", "expression", "aggregation", "filter", "tables"},
    "concepts": {"version", "concepts"},
    "concept": {"name", "description", "describes"},
    "grants": {"version", "grants"},
    "grant": {"user", "tables"},
    "manifest": {"version", "services"},
    "manifest_service": {"name", "dir", "db", "models_dir"},
}
_NAME = re.compile(r"[a-z0-9_][a-z0-9_-]*\Z")


def parse(text: str, what: str) -> dict[str, Any]:
    if yaml is None:
        raise CatalogError("PyYAML isn't installed")
    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise CatalogError(f"{what}: {e}") from None
    if not isinstance(doc, dict):
        raise CatalogError(f"{what}: not a mapping")
    if doc.get("version") != VERSION:
        raise CatalogError(f"{what}: version must be {VERSION}")
    return doc


def known(x: Any, kind: str, where: str) -> dict[str, Any]:
    """x, if it is a mapping with no other fields than its kind has. YAML 1.1 reads
    an unquoted `on` as true."""
    if not isinstance(x, dict):
        raise CatalogError(f"{where}: not a mapping")
    x = {("on" if k is True else k): v for k, v in x.items()}
    odd = set(x) - FIELDS[kind]
    if odd:
        raise CatalogError(f"{where}: unknown field {sorted(map(str, odd))[0]}")
    return x


def load_catalog(root: str) -> dict[str, list[dict[str, Any]]]:
    """services/*.yaml in order of name, metrics.yaml and concepts.yaml of a folder.
    The folder must be there; a missing part is empty."""
    at = Path(root)
    if not at.is_dir():
        raise CatalogError(f"no folder {root}")
    services = [known(parse(p.read_text("utf-8"), p.name), "service", p.name) for p in sorted((at / "services").glob("*.yaml"))]
    out: dict[str, list] = {"services": services}
    for part, one in (("metrics", "metric"), ("concepts", "concept")):
        p = at / f"{part}.yaml"
        doc = known(parse(p.read_text("utf-8"), p.name), part, p.name) if p.exists() else {}
        out[part] = [known(x, one, p.name) for x in doc.get(part) or []]
    return out


def load_grants(text: str) -> list[tuple[str, str]]:
    """(user, target) of a grants file; a pair given twice is an error."""
    out: list[tuple[str, str]] = []
    for g in known(parse(text, "grants"), "grants", "grants").get("grants") or []:
        g = known(g, "grant", "grants")
        if not g.get("user") or not g.get("tables"):
            raise CatalogError("grants: an entry needs user and tables")
        for t in g["tables"]:
            if (g["user"], t) in out:
                raise CatalogError(f"grants: {g['user']} has {t} twice")
            out.append((g["user"], t))
    return out


def load_manifest(text: str) -> list[dict[str, str]]:
    """Services with their folder and database; names are identifiers, folders relative."""
    out, seen = [], set()
    for s in known(parse(text, "manifest"), "manifest", "manifest").get("services") or []:
        s = known(s, "manifest_service", "manifest")
        name, where, db = s.get("name") or "", s.get("dir") or "", s.get("db") or ""
        if not _NAME.match(name) or db and not _NAME.match(db):
            raise CatalogError(f"manifest: bad name {name or db!r}")
        if not where or where.startswith("/") or ".." in where.split("/"):
            raise CatalogError(f"manifest: bad folder {where!r}")
        if name in seen:
            raise CatalogError(f"manifest: {name} twice")
        seen.add(name)
        out.append({"name": name, "dir": where, "db": db, "models_dir": s.get("models_dir") or ""})
    return out

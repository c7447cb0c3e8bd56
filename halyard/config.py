"""Limits and settings, with their defaults, from the environment."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from halyard.errors import invalid

# fixed values: bounds of the query surface
ROW_CAP, ROW_CAP_MOST = 500, 5000
TIMEOUT_MS = 30_000
KEY_CONCURRENCY, PROCESS_CONCURRENCY = 2, 8
RAW_DAYS, SUMMARY_DAYS = 7, 30
SEARCH_HITS, CHANNEL_HITS, ENUM_VALUES, DEPTH, NODES, SUMMARY_EDGES = 20, 50, 100, 5, 200, 100
QUERY_CHARS, FQN_CHARS = 256, 512
EMBED_BATCH = 100

_UNITS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "": 1}


def timeout_ms(text: str) -> int:
    """A duration such as 30s, 30000ms, 1.5min, 1h, 1d or 30000 in milliseconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|min|h|d|)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[1]) * _UNITS[m[2]])


@dataclass(frozen=True)
class Route:
    """A database name and the folder or catalog namespace its tables are in."""

    dbname: str
    service: str
    path: str


def parse_routes(text: str) -> dict[str, Route]:
    """A JSON array of {dbname, service, path}; names are unique and without dots."""
    routes: dict[str, Route] = {}
    for x in json.loads(text or "[]"):
        r = Route(x.get("dbname", ""), x.get("service", ""), x.get("path", ""))
        if not r.dbname or not r.service or not r.path or "." in r.dbname or "." in r.service:
            raise ValueError(f"a route needs dbname, service and path, names without dots: {x}")
        if r.dbname in routes:
            raise ValueError(f"dbname given twice: {r.dbname}")
        routes[r.dbname] = r
    return routes


def find_route(routes: Mapping[str, Route], dbname: str | None) -> Route:
    """The named route; without a name the only one there is."""
    if not routes:
        raise invalid("not_configured", "no database is configured")
    if not dbname:
        if len(routes) > 1:
            raise invalid("dbname_required", "several databases are configured", dbnames=sorted(routes))
        return next(iter(routes.values()))
    if dbname not in routes:
        raise invalid("unknown_dbname", f"no database {dbname}", dbnames=sorted(routes))
    return routes[dbname]


@dataclass(frozen=True)
class Config:
    store: str = "./store"
    routes: dict[str, Route] = field(default_factory=dict)
    row_cap: int = ROW_CAP
    timeout_ms: int = TIMEOUT_MS
    key_concurrency: int = KEY_CONCURRENCY
    process_concurrency: int = PROCESS_CONCURRENCY
    log_dir: str = "./logs"
    raw_days: int = RAW_DAYS
    summary_days: int = SUMMARY_DAYS
    embedding_model: str = ""

    def __post_init__(self) -> None:
        if not ROW_CAP <= self.row_cap <= ROW_CAP_MOST:
            raise ValueError(f"the row cap must be from {ROW_CAP} to {ROW_CAP_MOST}")
        for n in ("timeout_ms", "key_concurrency", "process_concurrency", "raw_days", "summary_days"):
            if getattr(self, n) <= 0:
                raise ValueError(f"{n} must be positive")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        """HALYARD_<FIELD> for each field; unset ones keep their default."""
        given = {}
        for name, f in cls.__dataclass_fields__.items():
            v = env.get(f"HALYARD_{name.upper()}")
            if v is None:
                continue
            given[name] = parse_routes(v) if name == "routes" else timeout_ms(v) if name == "timeout_ms" else int(v) if f.type == "int" else v
        return cls(**given)

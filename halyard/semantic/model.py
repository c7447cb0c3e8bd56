"""The catalogue's tables and the rules for names."""

from __future__ import annotations

from halyard.errors import EngineError, INVALID

# fixed values: kinds of entities and of relations
KINDS = ("service", "database", "table", "column", "metric", "concept")
RELATIONS = ("connects_to", "contains", "references", "describes")

ENTITY = "fqn string, kind string, name string, description string, data_type string, is_time boolean, pg_schema string, expression string, aggregation string, filter string"
RELATION = "type string, src_fqn string, dst_fqn string, meta string"
ENUM = "column_fqn string, value string, label string"
STAMP = ", tombstone boolean, updated_at timestamp"

#: Every stored table with its key columns.
SCHEMAS = {
    "entities": ENTITY + STAMP,
    "relations": RELATION + STAMP,
    "enum_values": ENUM + STAMP,
    "embeddings": "entity_fqn string, model string, vector array<float>",
    "grants": "user_id string, table_fqn string, granted_at timestamp",
    "grant_patterns": "user_id string, pattern string",
    "credentials": "key_hash string, user_id string, role string, created_at timestamp, revoked_at timestamp",
}
KEYS = {"entities": ["fqn"], "relations": ["type", "src_fqn", "dst_fqn"], "enum_values": ["column_fqn", "value"]}


class CatalogError(EngineError):
    def __init__(self, message: str, **details):
        super().__init__(INVALID, message, {"reason": "bad_catalog", **details})


def check_segment(s: str, what: str) -> str:
    """One segment of a name: not empty, without dots, blanks and NUL."""
    if not isinstance(s, str) or not s or "." in s or "\0" in s or any(c.isspace() for c in s):
        raise CatalogError(f"{what}: bad name {s!r}")
    return s


def check_fqn(s: str, segments: int | None = None) -> str:
    parts = s.split(".") if isinstance(s, str) else []
    if not parts or segments is not None and len(parts) != segments:
        raise CatalogError(f"bad full name {s!r}")
    for p in parts:
        check_segment(p, s)
    return s

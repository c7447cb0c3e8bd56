"""Structured errors: a kind, a stable machine-readable reason and details."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# fixed values: kinds of errors and their codes
INVALID = "invalid_request"
UNAUTHORIZED = "unauthorized"
DENIED = "permission_denied"
LIMITED = "rate_limited"
MISSING = "not_implemented"
INTERNAL = "internal"
CODES = {INVALID: 400, UNAUTHORIZED: 401, DENIED: 403, LIMITED: 429, MISSING: 501, INTERNAL: 500}


@dataclass
class EngineError(Exception):
    kind: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__init__(self.message)

    @property
    def reason(self) -> str | None:
        return self.details.get("reason")

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "code": CODES[self.kind], "message": self.message, "details": self.details}


def invalid(reason: str, message: str, **details: Any) -> EngineError:
    return EngineError(INVALID, message, {"reason": reason, **details})


def denied(reason: str, message: str, **details: Any) -> EngineError:
    return EngineError(DENIED, message, {"reason": reason, **details})


def map_spark_error(e: Exception, cancelled: bool = False) -> EngineError:
    """An exception of Spark as a structured error: a cancelled statement is a
    timeout, a refused access a denial, a lost service internal, the rest the
    statement's own fault."""
    name = getattr(e, "getCondition", lambda: None)() if hasattr(e, "getCondition") else None
    state = getattr(e, "getSqlState", lambda: None)() if hasattr(e, "getSqlState") else None
    text = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
    if cancelled or (name or "").startswith("OPERATION_CANCELED") or "cancelled" in text and "tag" in text:
        return invalid("timeout", "the statement took longer than allowed", sqlstate=state or "57014")
    if state == "42501":
        return EngineError(DENIED, text, {"sqlstate": state})
    if state and (state.startswith("08") or state.startswith("57P")):
        return EngineError(INTERNAL, text, {"sqlstate": state})
    if name == "PARSE_SYNTAX_ERROR":
        return invalid("syntax_error", text, error=text)
    return invalid("engine_error", text, condition=name, sqlstate=state)

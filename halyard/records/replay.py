"""Running logged calls again and comparing the outcome."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from halyard.errors import EngineError
from halyard.records.log import status_of


def replay(rows: Iterable[Any], call: Callable[[str, str, dict[str, Any]], tuple[int | None, bool]]) -> list[dict[str, Any]]:
    """What differs, one entry per differing call. rows: logged calls, such as
    `toLocalIterator()` gives; call(user, tool, params) -> (rows, truncated) or EngineError."""
    out = []
    for r in rows:
        error: EngineError | None = None
        n: int | None = None
        cut = False
        try:
            params = json.loads(r.params) if r.params else {}
        except ValueError:
            out.append({"plan_id": r.plan_id, "field": "params", "logged": r.params, "now": None})
            continue
        try:
            n, cut = call(r.user, r.tool, params)
        except EngineError as e:
            error = e
        now = {"status": status_of(error), "rows": n, "truncated": cut if error is None else None, "reject": (error.kind, error.reason) if error else None}
        was = {"status": r.status, "rows": r.rows, "truncated": bool(r.truncated) if r.status == "success" else None, "reject": (r.reject.kind, (r.reject.details or {}).get("reason")) if r.reject else None}
        if now["status"] == "success" and was["rows"] is None:
            now["rows"] = None
        out += [{"plan_id": r.plan_id, "field": k, "logged": was[k], "now": now[k]} for k in was if was[k] != now[k]]
    return out

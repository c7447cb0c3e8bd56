"""Values in JSON by paths such as a.b[0].c."""

from __future__ import annotations

import re
from typing import Any

_STEP = re.compile(r"\.?([^.\[\]]+)|\[(\d+)\]")


def resolve(doc: Any, path: str) -> Any:
    """The value at a path; LookupError if it isn't there, ValueError for a bad path."""
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path {path!r}")
        name, index = m.groups()
        if name is not None:
            if not isinstance(doc, dict) or name not in doc:
                raise LookupError(path)
            doc = doc[name]
        else:
            if not isinstance(doc, list) or int(index) >= len(doc):
                raise LookupError(path)
            doc = doc[int(index)]
        at = m.end()
    return doc


def mismatches(doc: Any, wanted: dict[str, Any]) -> list[str]:
    """The paths whose value isn't the wanted one or isn't there."""
    out = []
    for path, value in wanted.items():
        try:
            if resolve(doc, path) != value:
                out.append(path)
        except LookupError:
            out.append(path)
    return out

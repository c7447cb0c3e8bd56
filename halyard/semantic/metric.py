"""Metrics: their definition as SQL that isn't run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from halyard.errors import invalid


@dataclass
class MetricSql:
    sql: str
    time_applied: bool = False
    notes: list[str] = field(default_factory=list)


def parse_time(text: str) -> dt.datetime:
    try:
        t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise invalid("bad_time", f"not an RFC 3339 time: {text}") from None
    if t.tzinfo is None:
        raise invalid("bad_time", f"a time needs its zone: {text}")
    return t


def metric_sql(name: str, expression: str, filter_: str, tables: list[str], time_columns: dict[str, list[str]], time_range: tuple[str, str] | None = None) -> MetricSql:
    """SELECT expression AS name FROM tables WHERE filter AND time in [start, end).

    tables: full names, in order; time_columns: for each the live time columns in
    order of name, of which the first is used. The filter is put in parentheses.
    Several tables can't be combined without a join condition: they are listed and
    a note says so. All notes are kept."""
    short = [t.split(".")[-1] for t in sorted(tables)]
    out = MetricSql(f"SELECT {expression} AS {name} FROM {', '.join(short)}" if short else f"SELECT {expression} AS {name}")
    where = [f"({filter_})"] if filter_ else []
    if len(short) > 1:
        out.notes.append("several tables: add the join condition before running this")
    if time_range is not None:
        start, end = time_range
        if parse_time(start) >= parse_time(end):
            raise invalid("bad_time", "start must be before end")
        for t in sorted(tables):
            cols = sorted(time_columns.get(t) or [])
            if not cols:
                out.notes.append(f"{t} has no time column")
                continue
            if len(cols) > 1:
                out.notes.append(f"{t} has several time columns, {cols[0].split('.')[-1]} is used")
            c = f"{t.split('.')[-1]}.{cols[0].split('.')[-1]}"
            where += [f"{c} >= TIMESTAMP '{start}'", f"{c} < TIMESTAMP '{end}'"]
            out.time_applied = True
    if where:
        out.sql += " WHERE " + " AND ".join(where)
    return out

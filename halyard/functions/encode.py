"""Values of a result as JSON."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def type_name(t: T.DataType) -> str:
    return t.simpleString()


def value(v: Any, t: T.DataType) -> Any:
    """Numbers and strings as they are, decimals as text with their scale, instants
    by RFC 3339, binary as \\x and hex digits; arrays, maps and structs by their parts."""
    if v is None:
        return None
    if isinstance(t, T.DecimalType):
        return f"{v:f}" if isinstance(v, decimal.Decimal) else str(v)
    if isinstance(t, T.TimestampType):
        u = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        u = u.astimezone(dt.timezone.utc)
        frac = f".{u.microsecond:06d}".rstrip("0") if u.microsecond else ""
        return u.strftime("%Y-%m-%dT%H:%M:%S") + frac + "Z"
    if isinstance(t, T.BinaryType):
        return "\\x" + bytes(v).hex()
    if isinstance(t, T.ArrayType):
        return [value(x, t.elementType) for x in v]
    if isinstance(t, T.MapType):
        return {str(value(k, t.keyType)): value(x, t.valueType) for k, x in v.items()}
    if isinstance(t, T.StructType):
        return {f.name: value(v[n], f.dataType) for n, f in enumerate(t)}
    if isinstance(v, (dt.datetime, dt.date, dt.time, dt.timedelta)):
        return v.isoformat() if hasattr(v, "isoformat") else str(v)
    return v


def capped(df: DataFrame, cap: int) -> tuple[list[dict[str, str]], list[list[Any]], bool]:
    """(columns, rows by position, truncated): one row more than the cap is fetched."""
    rows = df.limit(cap + 1).collect()
    columns = [{"name": f.name, "type": type_name(f.dataType)} for f in df.schema]
    kinds = [f.dataType for f in df.schema]
    return columns, [[value(v, t) for v, t in zip(r, kinds)] for r in rows[:cap]], len(rows) > cap

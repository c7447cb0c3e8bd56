"""What differs between the wanted and the stored catalogue, and the next version of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: `added`, `updated`, `deleted`. Rows are live in `stored`
    unless their tombstone is true; other columns of `wanted` are compared with
    null equal to null. Keys are unique on either side."""
    fields = [c for c in wanted.columns if c not in keys]
    a = wanted.select(*keys, F.struct(*fields).alias("a") if fields else F.lit(1).alias("a"))
    b = stored.where(~F.coalesce("tombstone", F.lit(False))).select(*keys, F.struct(*fields).alias("b") if fields else F.lit(1).alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change IS NOT NULL")


def apply(wanted: DataFrame, stored: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The next version of `stored`: wanted rows live (a deleted one that is wanted
    again revives), live rows that aren't wanted get a tombstone, `updated_at` is
    `now` where something changed and as before elsewhere. Applying twice changes
    nothing."""
    fields = [c for c in wanted.columns if c not in keys]
    w = wanted.select(*keys, *(F.col(c).alias(f"__w_{c}") for c in fields), F.lit(True).alias("__in"))
    s = stored.withColumn("__there", F.lit(True)).withColumn("__dead", F.coalesce("tombstone", F.lit(False)))
    j = w.join(s, keys, "full")
    inside, there = F.coalesce("__in", F.lit(False)), F.coalesce("__there", F.lit(False))
    same = reduce(lambda x, c: x & F.col(f"__w_{c}").eqNullSafe(F.col(c)), fields, inside & there & ~F.coalesce("__dead", F.lit(False)))
    dead = F.when(inside, False).otherwise(True)
    kept = same | (~inside & F.coalesce("__dead", F.lit(False)))
    out = [F.when(inside, F.col(f"__w_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return j.select(*keys, *out, dead.alias("tombstone"), F.when(kept, F.col("updated_at")).otherwise(now).alias("updated_at"))

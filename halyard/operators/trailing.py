"""Rolling totals over trailing periods, from cumulative sums."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.keys import col, norm_key, utc_day


def newest_version(df: DataFrame, key: str, version: str, **fields) -> DataFrame:
    """One row per key, that with the greatest version, with the given fields.

    The maximum of a struct is combined before the shuffle, so that a key with
    very many versions costs one row per task. A null key equals no other: such
    rows each count. Of rows equal in key and version the greatest fields win.
    """
    pick = df.select(
        col(key).alias("k"),
        F.when(col(key).isNull(), col(version)).alias("k2"),
        F.struct(col(version).alias("__v"), *(c.alias(n) for n, c in fields.items())).alias("s"),
    )
    return pick.groupBy("k", "k2").agg(F.max("s").alias("s")).select("k", *(f"s.{n}" for n in fields))


def trailing_totals(
    df: DataFrame,
    entity: str,
    amount: str,
    at: str,
    key: str,
    version: str,
    periods: Sequence[int] = (7, 30),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Totals and daily averages per entity over the days up to each day.

    Columns: entity, day (date), day_no (1 on the entity's first day with a row,
    less before it), total_N and avg_N for each period N.

    Each entity's daily amounts are summed up once, cumulatively; the running sum
    of a day with rows holds until the day before the next such day (forward
    fill), and the total of N days is the running sum less that of N days before.
    Days run from the entity's first day, or from `start` if that is earlier, to
    `end`, by default the last day of all.

    Rows are reduced to entity and day before anything is ordered, so that no
    task sees more of an entity than its calendar, however many rows it has.

    A row counts once per key, by its greatest version. Rows whose counting
    version has a null entity or time don't count; a null amount counts as 0.
    Days after `end` don't count. An empty table gives an empty result; a blank
    entity is an entity like others. Other columns of df don't matter.
    """
    live = newest_version(df, key, version, e=norm_key(col(entity)), d=utc_day(col(at)), a=col(amount)).where("e IS NOT NULL AND d IS NOT NULL")
    if end is not None:
        live = live.where(F.col("d") <= F.lit(end))
    daily = live.groupBy("e", "d").agg(F.sum(F.coalesce("a", F.lit(0))).alias("t"))
    until = F.lit(end) if end is not None else daily.agg(F.max("d")).scalar()

    by_day = Window.partitionBy("e").orderBy("d")
    steps = daily.select(
        "e",
        "d",
        F.sum("t").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.coalesce(F.date_sub(F.lead("d").over(by_day), 1), until).alias("last"),
        F.min("d").over(Window.partitionBy("e")).alias("first"),
    )
    days = F.transform(F.sequence("d", "last"), lambda x: F.struct(x.alias("day"), F.col("run").alias("run")))
    if start is not None:
        empty = F.transform(F.sequence(F.lit(start), F.date_sub("d", 1)), lambda x: F.struct(x.alias("day"), F.lit(0).cast(steps.schema["run"].dataType).alias("run")))
        days = F.when((F.col("d") == F.col("first")) & (F.col("d") > F.lit(start)), F.concat(empty, days)).otherwise(days)
    filled = steps.select("e", "first", F.explode(days).alias("x")).select("e", "first", "x.day", "x.run")
    order = Window.partitionBy("e").orderBy("day")
    out = [F.col("e").alias(entity), F.col("day"), (F.datediff("day", "first") + 1).alias("day_no")]
    for n in periods:
        total = F.col("run") - F.coalesce(F.lag("run", n).over(order), F.lit(0))
        out += [total.alias(f"total_{n}"), (total.cast("double") / n).alias(f"avg_{n}")]
    return filled.select(*out)

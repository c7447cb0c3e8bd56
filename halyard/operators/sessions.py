"""Splitting activity into sessions at gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.keys import col, floor_div, micros, norm_key


def _slots(df: DataFrame, user: str, at: str, kind: str, gap_us: int, keep: Column | None) -> DataFrame:
    """u, slot, kind, n, lo, hi: distinct events counted by user, slot and kind.

    A slot is a stretch of time as long as the gap, so all events of a slot are
    of one session; everything after this works on slots, not on events."""
    rows = df if keep is None else df.where(keep)
    rows = rows.select(norm_key(col(user)).alias("u"), micros(col(at)).alias("us"), col(kind).alias("kind"))
    rows = rows.where("u IS NOT NULL AND u <> '' AND us IS NOT NULL").distinct()
    return rows.groupBy("u", floor_div(F.col("us"), gap_us).alias("slot"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))


def _numbered(slots: DataFrame, gap_us: int) -> DataFrame:
    """slots with the session's number of its user: the lag over slots flags gaps
    above the threshold, the running sum of flags is the number."""
    by_slot = Window.partitionBy("u").orderBy("slot")
    one = slots.groupBy("u", "slot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gap = F.col("lo") - F.lag("hi").over(by_slot)
    flagged = one.withColumn("new", F.when(gap <= gap_us, 0).otherwise(1))
    return flagged.withColumn("no", F.sum("new").over(by_slot.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def sessions(df: DataFrame, user: str, at: str, kind: str, gap_us: int = 30 * 60 * 1_000_000, keep: Column | None = None) -> DataFrame:
    """One row per session: user, session_no, start_us, end_us, duration_us, n_events.

    A new session begins where more than `gap_us` microseconds lie between an
    event and the user's previous one. Events are the rows for which `keep`
    holds and whose user is neither null nor blank and whose time isn't null;
    rows equal in user, time and kind (nulls being equal) are one event.

    Events are first counted by user and slot of time, combined before the
    shuffle; a user with a third of all events then has no more rows than slots
    in the calendar, and windows run over slots alone. An empty table gives an
    empty result; other columns don't matter.
    """
    s = _numbered(_slots(df, user, at, kind, gap_us, keep), gap_us)
    return s.groupBy("u", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).select(
        F.col("u").alias(user),
        F.col("no").alias("session_no"),
        F.col("lo").alias("start_us"),
        F.col("hi").alias("end_us"),
        (F.col("hi") - F.col("lo")).alias("duration_us"),
        F.col("n").alias("n_events"),
    )


def session_kinds(df: DataFrame, user: str, at: str, kind: str, gap_us: int = 30 * 60 * 1_000_000, keep: Column | None = None) -> DataFrame:
    """One row per session and kind of event in it: user, session_no, start_us,
    end_us, n_events of the session, kind and n_kind. Otherwise as `sessions`;
    events of a null kind are counted under null."""
    by_slot = Window.partitionBy("u").orderBy("slot")
    slots = _slots(df, user, at, kind, gap_us, keep)
    here = Window.partitionBy("u", "slot")
    before = F.max("hi").over(by_slot.rangeBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(here.orderBy(F.col("kind").asc_nulls_first())) == 1
    rows = slots.select("*", F.min("lo").over(here).alias("slot_lo"), before.alias("before"), first.alias("first"))
    new = F.when(F.col("first") & ~F.coalesce(F.col("slot_lo") - F.col("before") <= gap_us, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("new", new)
    no = F.sum("new").over(Window.partitionBy("u").orderBy("slot").rangeBetween(Window.unboundedPreceding, 0))
    per_kind = rows.withColumn("no", no).groupBy("u", "no", "kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = Window.partitionBy("u", "no")
    return per_kind.select(
        F.col("u").alias(user),
        F.col("no").alias("session_no"),
        F.min("lo").over(whole).alias("start_us"),
        F.max("hi").over(whole).alias("end_us"),
        F.sum("n").over(whole).alias("n_events"),
        F.col("kind").alias(kind),
        F.col("n").alias("n_kind"),
    )

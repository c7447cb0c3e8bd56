"""References to records that do not exist, are deleted, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.keys import col, norm_key
from halyard.operators.bloom import Filter
from halyard.session import materialize

#: A key's references are spread over so many groups in the exact join, and its
#: one parent row is given to each; what is still too large then AQE splits.
SALT = 8


def newest(df: DataFrame, key: Column, updated: Column, **fields: Column) -> DataFrame:
    """The counting row of each non-null key: that with the greatest `updated`,
    of ties that with the greatest fields. Combined before the shuffle."""
    rows = df.select(key.alias("k"), F.struct(updated.alias("__u"), *(c.alias(n) for n, c in fields.items())).alias("s")).where("k IS NOT NULL")
    return rows.groupBy("k").agg(F.max("s").alias("s")).select("k", *(f"s.{n}" for n in fields))


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    ref_id: str,
    ref_key: str,
    ref_at: str,
    parent_key: str,
    parent_updated: str,
    parent_created: str,
    parent_deleted: str,
    parent_ok: Column | None = None,
) -> DataFrame:
    """Rows (ref_id, key, at, reason) of the references without a valid parent.

    reason: `missing`, no parent has the key; `deleted`, the parent is marked as
    deleted; `late`, it is not, but was created after the reference was made.
    A parent's counting row is that with the greatest `parent_updated`; parents
    for which `parent_ok` isn't true don't exist here. A null mark means not
    deleted, a null time is never late.

    The references are read once, reduced to one row each and written with what a
    Bloom filter of the parents' keys, of bounded size, says of them: what it doesn't
    hold is missing for certain and takes no part in a join. Only what it holds is
    joined exactly, in salted groups.

    References with a null key are none. Rows equal in `ref_id` are one
    reference, of which the row with the earliest time (null last), then the
    least key counts; rows with a null id each count. Empty tables on either
    side are allowed; other columns don't matter.
    """
    ok = F.lit(True) if parent_ok is None else F.coalesce(parent_ok, F.lit(False))
    known = newest(parents, norm_key(col(parent_key)), col(parent_updated), ok=ok, gone=F.coalesce(col(parent_deleted), F.lit(False)), born=col(parent_created))
    known = materialize(known.where("ok").select("k", "gone", "born"))
    keys = Filter(known, "k")

    one = refs.select(col(ref_id).alias("id"), norm_key(col(ref_key)).alias("k"), col(ref_at).alias("at")).where("k IS NOT NULL")
    one = one.withColumn("u", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    once = one.groupBy("id", "u").agg(F.min(F.struct(F.col("at").isNull().alias("n"), "at", "k")).alias("s")).select("id", "s.k", "s.at")
    seen = materialize(once.withColumn("maybe", keys.holds("k")), "maybe")

    certain = seen.where("NOT maybe").select("id", "k", "at", F.lit("missing").alias("reason"))
    salted = seen.where("maybe").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALT)).cast("int"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("there", F.lit(True))
    joined = salted.join(copies, ["k", "salt"], "left")
    why = F.when(F.col("there").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("born") > F.col("at"), "late")
    checked = joined.select("id", "k", "at", why.alias("reason")).where("reason IS NOT NULL")
    return certain.unionByName(checked).select(F.col("id").alias(ref_id), F.col("k").alias(ref_key), F.col("at").alias(ref_at), "reason")


def orphans_per_period(orphans: DataFrame, key: str, at: str, period: str = "month") -> DataFrame:
    """Number of orphan references by key, period of `at` (its first day, UTC) and reason."""
    from halyard.functions.keys import utc_day

    month = F.trunc(utc_day(col(at)), period)
    return orphans.groupBy(col(key).alias(key), month.alias(period), "reason").agg(F.count(F.lit(1)).alias("n_refs"))

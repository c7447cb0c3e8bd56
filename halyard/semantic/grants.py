"""Grants: targets, expansion to tables, full replacement, what is missing or stale."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.errors import invalid
from halyard.semantic.graph import tables_behind
from halyard.semantic.search import live
from halyard.session import materialize

_SEGMENT = r"[^.\s:*\0]+"
_TARGET = re.compile(rf"(?:{_SEGMENT}\.{_SEGMENT}\.{_SEGMENT}|(?:metric|concept|service):{_SEGMENT}|database:{_SEGMENT}\.{_SEGMENT})\Z")


def check_target(target: str) -> str:
    """A table's full name, or metric:, concept:, service: or database: and a name.
    A wildcard over everything isn't allowed."""
    if not isinstance(target, str) or not _TARGET.match(target):
        raise invalid("bad_target", f"can't be granted: {target!r}", target=target)
    return target


def is_pattern(target: str) -> bool:
    return target.startswith(("service:", "database:"))


def expand(entities: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, table_fqn), distinct, of the wanted (user_id, target). A target that
    stands for no table refuses the whole."""
    behind = materialize(tables_behind(entities, relations, wanted))
    empty = wanted.select("target").distinct().join(behind.select("target").distinct(), "target", "left_anti").orderBy("target").limit(1).collect()
    if empty:
        raise invalid("empty_target", f"{empty[0].target} stands for no table", target=empty[0].target)
    return wanted.join(behind, "target").select("user_id", "table_fqn").distinct()


def replacement(wanted: DataFrame, stored: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(the new grants, changes): pairs of `wanted` with the time they were first
    granted, and (user_id, table_fqn, change) of those `added` and `removed`."""
    key = ["user_id", "table_fqn"]
    old = stored.groupBy(*key).agg(F.min("granted_at").alias("granted_at"))
    j = wanted.select(*key, F.lit(True).alias("w")).distinct().join(old.withColumn("s", F.lit(True)), key, "full")
    new = j.where("w").select(*key, F.coalesce("granted_at", now).alias("granted_at"))
    change = F.when(F.col("s").isNull(), "added").when(F.col("w").isNull(), "removed")
    return new, j.select(*key, change.alias("change")).where("change IS NOT NULL")


def coverage_gap(patterns: DataFrame, grants: DataFrame, entities: DataFrame) -> DataFrame:
    """(user_id, pattern, table_fqn): live tables a wildcard (service:x, database:x.y)
    would stand for today that its user has no grant for."""
    rel = entities.sparkSession.createDataFrame([], "type string, src_fqn string, dst_fqn string, meta string, tombstone boolean, updated_at timestamp")
    behind = tables_behind(entities, rel, patterns.select(F.col("pattern").alias("target")))
    due = patterns.join(behind, F.col("pattern") == F.col("target")).select("user_id", "pattern", "table_fqn").distinct()
    return due.join(grants.select("user_id", "table_fqn").distinct(), ["user_id", "table_fqn"], "left_anti")


def stale(grants: DataFrame, entities: DataFrame) -> DataFrame:
    """(user_id, table_fqn) of the grants for what is no live table."""
    tables = live(entities).where("kind = 'table'").select(F.col("fqn").alias("table_fqn"))
    return grants.select("user_id", "table_fqn").distinct().join(tables, "table_fqn", "left_anti").select("user_id", "table_fqn")

"""Findings: drafts against the models of the code and against the live catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("error", "warn", "info")
# fixed values: spellings of one type
SYNONYMS = {
    "varchar": "character varying",
    "char": "character",
    "bpchar": "character",
    "int": "integer",
    "int4": "integer",
    "serial": "integer",
    "serial4": "integer",
    "int8": "bigint",
    "bigserial": "bigint",
    "serial8": "bigint",
    "int2": "smallint",
    "smallserial": "smallint",
    "bool": "boolean",
    "float4": "real",
    "float8": "double precision",
    "decimal": "numeric",
    "timestamptz": "timestamp with time zone",
    "timestamp": "timestamp without time zone",
    "timetz": "time with time zone",
    "time": "time without time zone",
}


def plain_type(c: Column) -> Column:
    """A type by its catalog name, in lower case, with its precision if it has one."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    base = F.trim(F.regexp_replace(low, r"\s*\([^)]*\)", ""))
    size = F.regexp_replace(F.regexp_extract(low, r"(\([^)]*\))", 1), r"\s", "")
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv)), base), base)
    return F.concat(name, size)


def live_columns(spark: SparkSession, views: dict[str, DataFrame], schema: str = "public") -> DataFrame:
    """(schema, table, column, type) of DataFrames by table name."""
    rows = [(schema, t, f.name, f.dataType.simpleString()) for t, df in sorted(views.items()) for f in df.schema]
    return spark.createDataFrame(rows, "schema string, table string, column string, type string")


def _finding(source: str, severity: Column | str, message: Column) -> list[Column]:
    return [F.lit(source).alias("source"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), message.alias("message")]


def calibrate(draft: DataFrame, live: DataFrame) -> DataFrame:
    """(source, severity, message) where drafts and the live catalog (schema, table,
    column, type) differ: only in the draft is an error, only live a warning, as is
    another type."""
    key = ["schema", "table", "column"]
    d, v = draft.select(*key, plain_type(F.col("type")).alias("d")), live.select(*key, plain_type(F.col("type")).alias("v"))
    at = F.concat_ws(".", *key)
    message = F.when(F.col("v").isNull(), F.concat(at, F.lit(" isn't in the database"))).when(F.col("d").isNull(), F.concat(at, F.lit(" isn't in the draft"))).when(F.col("d") != F.col("v"), F.concat(at, F.lit(" is "), F.col("d"), F.lit(" in the draft and "), F.col("v"), F.lit(" in the database")))
    return d.join(v, key, "full").select(*_finding("calibrate", F.when(F.col("v").isNull(), "error").otherwise("warn"), message)).where("message IS NOT NULL")


def cross_check(draft: DataFrame, models: DataFrame) -> DataFrame:
    """The same between drafts and the columns of the code's models (table, column,
    type or null): only in a model is an error, only in the draft a warning, if its
    table has a model at all. Several models of a table count together."""
    key = ["table", "column"]
    m = models.groupBy(*key).agg(F.max(plain_type(F.col("type"))).alias("m"), F.lit(True).alias("in_m"))
    d = draft.select(*key, plain_type(F.col("type")).alias("d"), F.lit(True).alias("in_d")).join(models.select("table").distinct(), "table", "left_semi")
    at = F.concat_ws(".", *key)
    message = F.when(F.col("in_d").isNull(), F.concat(at, F.lit(" is only in the model"))).when(F.col("in_m").isNull(), F.concat(at, F.lit(" is only in the migrations"))).when(F.col("d") != F.col("m"), F.concat(at, F.lit(" is "), F.col("d"), F.lit(" in the migrations and "), F.col("m"), F.lit(" in the model")))
    return d.join(m, key, "full").select(*_finding("model", F.when(F.col("in_d").isNull(), "error").otherwise("warn"), message)).where("message IS NOT NULL")


def ordered(findings: DataFrame) -> DataFrame:
    """Errors first, then by message."""
    rank = F.element_at(F.create_map(*(x for n, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(n)))), F.col("severity"))
    return findings.orderBy(rank, "message")


def exit_code(findings: DataFrame) -> int:
    """2 if there is an error among the findings, else 0; 1 is for what can't be run."""
    return 0 if findings.where("severity = 'error'").isEmpty() else 2

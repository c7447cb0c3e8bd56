from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from halyard.functions.encode import capped
from halyard.functions.json_path import mismatches, resolve
from halyard.functions.keys import col, floor_div, norm_key, utc_day


def test_json_path():
    doc = {"a": {"b": [{"c": 1}, [2]]}}
    assert resolve(doc, "a.b[0].c") == 1 and resolve(doc, "a.b[1][0]") == 2 and resolve(doc, "") == doc
    for bad in ("a.x", "a.b[9]", "a[0]", "a.b.c"):
        with pytest.raises(LookupError):
            resolve(doc, bad)
    with pytest.raises(ValueError):
        resolve(doc, "a.[")
    assert mismatches(doc, {"a.b[0].c": 1, "a.b[0].d": 1, "a.b[1]": [3]}) == ["a.b[0].d", "a.b[1]"]


def test_values_as_json(spark):
    df = spark.sql(
        "SELECT 1.50BD AS d, timestamp'2024-01-02 03:04:05.5' AS t, date'2024-01-02' AS day, X'0aFF' AS b, array(1.0BD, null) AS a,"
        " map('k', timestamp'2024-01-02 00:00:00') AS m, named_struct('x', 1) AS s, cast(null AS int) AS n, true AS f, timestamp_ntz'2024-01-02 03:04:05' AS z, 'é' AS u"
    )
    cols, rows, cut = capped(df, 5)
    assert rows == [["1.50", "2024-01-02T03:04:05.5Z", "2024-01-02", "\\x0aff", ["1.0", None], {"k": "2024-01-02T00:00:00Z"}, {"x": 1}, None, True, "2024-01-02T03:04:05", "é"]]
    assert cols[0] == {"name": "d", "type": "decimal(3,2)"} and not cut
    assert capped(spark.range(6), 5)[2] is True and capped(spark.range(5), 5)[2] is False
    assert isinstance(df.head().d, Decimal)


def test_keys(spark):
    df = spark.createDataFrame([(" AbC ", -1, dt.datetime(1969, 12, 31, 23, 59, 59, tzinfo=dt.timezone.utc)), (None, 7, None), ("\tx", 0, dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc))], "`a.b c` string, n bigint, t timestamp")
    rows = df.select(norm_key(col("a.b c")).alias("k"), floor_div(F.col("n"), 5).alias("q"), utc_day(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("abc", -1, dt.date(1969, 12, 31)), (None, 1, None), ("\tx", 0, dt.date(2026, 1, 1))]


def test_written_tables_are_released(spark):
    from halyard.session import materialize, release, shared_dir

    release(spark)
    df = materialize(spark.range(10).withColumn("x", F.lit("a")))
    assert df.count() == 10 and df.inputFiles()[0].startswith(f"file://{shared_dir(spark)}/halyard/")
    assert release(spark) == 1 and release(spark) == 0

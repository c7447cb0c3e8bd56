"""Daily roll-ups of the call log, and comparing what was logged with what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calls(log: DataFrame) -> DataFrame:
    return log.where("kind = 'tool_call'")


def per_tool(log: DataFrame, day: str = "log_day") -> DataFrame:
    """(date, tool, calls, success, rejected, timeout, parse_error, rows, truncated);
    a call without a status counts as rejected."""
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("rejected"))
    return calls(log).groupBy(F.col(day).cast("string").alias("date"), "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        *(F.count_if(status == s).alias(s) for s in ("success", "timeout", "parse_error")),
        F.count_if(~status.isin("success", "timeout", "parse_error")).alias("rejected"),
        F.coalesce(F.sum(F.col("rows").cast("bigint")), F.lit(0)).alias("rows"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )


def reject_reasons(log: DataFrame, day: str = "log_day") -> DataFrame:
    """(date, reason, n): the reason in the details of a rejection, else its kind."""
    reason = F.coalesce(F.element_at(F.col("reject.details"), F.lit("reason")), F.col("reject.kind"))
    return calls(log).where("reject IS NOT NULL").groupBy(F.col(day).cast("string").alias("date"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).where("reason IS NOT NULL")


def keywords(log: DataFrame, day: str = "log_day") -> DataFrame:
    """(date, keyword, n) of the queries of searches, in lower case, without blanks
    around them. Params that aren't JSON have no query."""
    word = F.lower(F.trim(F.get_json_object("params", "$.query")))
    return calls(log).where("tool = 'search_entities'").select(F.col(day).cast("string").alias("date"), word.alias("keyword")).where("keyword <> ''").groupBy("date", "keyword").agg(F.count(F.lit(1)).alias("n"))


def summary_lines(log: DataFrame) -> DataFrame:
    """(date, o, name, line) of the days' summaries: a line of JSON for each tool, each
    reason of rejections and each keyword, these in order of frequency; o and name
    give the order. Nothing is gathered by day."""
    fields = ("calls", "success", "rejected", "timeout", "parse_error", "rows", "truncated")
    low = F.lit(-(1 << 62)).cast("bigint")

    def rows(df: DataFrame, o: Column, name: str, *more: str) -> DataFrame:
        return df.where("date IS NOT NULL").select("date", o.alias("o"), F.col(name).alias("name"), F.to_json(F.struct(name, *more)).alias("line"))

    tools = rows(per_tool(log).where("tool IS NOT NULL"), low, "tool", *fields)
    rejects = rows(reject_reasons(log), low + 1, "reason", "n")
    return tools.unionByName(rejects).unionByName(rows(keywords(log), -F.col("n"), "keyword", "n"))


def multiset_diff(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., side, n): how many more rows of a combination one side has (`left`, `right`)."""
    n = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).unionByName(b.groupBy(*by).agg((-F.count(F.lit(1))).alias("n")))
    d = n.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")
    return d.select(*by, F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").alias("n"))


def audit(log: DataFrame, observed: DataFrame, key: str = "plan_id") -> DataFrame:
    """(key, problem) of what doesn't match one to one: `unlogged`, `unobserved`, `status`, `twice`."""
    a = calls(log).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("logged"))
    b = observed.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.max("status").alias("seen"))
    problem = F.when(F.col("n").isNull(), "unlogged").when(F.col("m").isNull(), "unobserved").when(F.col("n") != F.col("m"), "twice").when(~F.col("logged").eqNullSafe(F.col("seen")), "status")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")

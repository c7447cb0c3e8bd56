"""The daily roll-up as a stream over the growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.records.log import SCHEMA


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """New files of a log folder as they appear."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(folder)


def daily_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, tool, calls, failed) per UTC day; lines later than `late` behind the
    newest are left to the batch roll-up, which summarises their day again."""
    t = log.where("kind = 'tool_call' AND ts IS NOT NULL").withWatermark("ts", late)
    g = t.groupBy(F.window("ts", "1 day").alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("status").eqNullSafe(F.lit("success"))).alias("failed"))
    return g.select(F.col("w.start").cast("date").alias("day"), "tool", "calls", "failed")


def upsert(counts: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the newest counts of each day in a Parquet folder partitioned by day: each
    batch rewrites the days it touches, so that a batch run twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            from halyard.session import materialize

            spark = batch.sparkSession
            days = batch.select("day").distinct()
            try:
                old = spark.read.schema(batch.schema).parquet(table)
                kept = old.join(days, "day", "left_semi").join(batch.select("day", "tool"), ["day", "tool"], "left_anti")
                batch_all = materialize(kept.select(*batch.columns).unionByName(batch))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                batch_all = batch
            batch_all.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
        finally:
            batch.unpersist()

    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()

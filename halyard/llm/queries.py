"""Queries of the problems on texts and, where there is such, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.encode import decode_column, encode_column
from halyard.llm.mixing import Mix
from halyard.llm.spans import SharedSpans
from halyard.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), {"doc_id": F.col("doc_id")}, "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding gives each text again."""
    docs = table(spark, d, "documents")
    ids = encode_column(docs, {"doc_id": F.col("doc_id"), "was": F.coalesce("text", F.lit(""))}, "text")
    back = decode_column(ids, {"doc_id": F.col("doc_id"), "was": F.col("was")}, "ids")
    return back.select("doc_id", (F.col("was") == F.col("text")).alias("same"))


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mixture keeps what it promises, by its own rows: no source is ever a
    block off, reached shares are the wanted ones, and repeats are within their limit."""
    mix = _mix(spark, d)
    targets = table(spark, d, "mix_targets").select("source", "max_repeats", F.col("target_share").cast("double").alias("share"))
    found = mix.deviation(mix.rows())
    every = Window.partitionBy()  # one row per source of mix_targets, which doesn't grow
    rows = targets.join(found, "source", "left").withColumn("used", F.col("used_tokens").isNotNull())
    wanted = F.col("share") / F.sum(F.when(F.col("used"), F.col("share"))).over(every)
    reached = F.col("used_tokens") / F.sum("used_tokens").over(every)
    yes = F.lit(True)
    return rows.select(
        "source",
        "used",
        F.coalesce((F.col("ahead") < 1) & (F.col("behind") < 1), yes).alias("within_block"),
        F.coalesce(F.abs(reached - wanted) < 0.0005, yes).alias("share_reached"),
        F.coalesce(F.col("most_uses") <= F.col("max_repeats"), yes).alias("repeats_kept"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).pairs()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each document: its characters, how many lie in shared spans, and with how many others."""
    docs = table(spark, d, "documents")
    spans = SharedSpans(docs)
    reps, places = spans.found()
    links, shared = spans.links(reps), spans.shared_chars(places)
    zero = F.lit(0).cast("bigint")
    copies = spans.members.select("doc_id", F.lit(True).alias("copied"))
    sizes = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    out = sizes.join(links, "doc_id", "left").join(shared, "doc_id", "left").join(copies, "doc_id", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", zero))
    return out.select("doc_id", "n_chars", chars.alias("shared_chars"), F.coalesce("n_others", zero).alias("n_others"))


def p8_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between the representatives of classes of equal texts."""
    return SharedSpans(table(spark, d, "documents")).rep_pairs().select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each document that is long enough, by its representative."""
    return SharedSpans(table(spark, d, "documents")).classes()


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_within": p7_within, "p8_found": p8_found, "p8_spans": p8_spans, "p8_links": p8_links, "p8_classes": p8_classes}


#: All windows of 150 characters of all texts, and what texts have one in common.
_WINDOWS = """
texts AS (SELECT doc_id, text FROM documents WHERE length(text) >= 150),
win AS (SELECT doc_id, p, md5(substr(text, p + 1, 150)) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS p FROM texts)),
sets AS (SELECT DISTINCT list_sort(list_distinct(list(doc_id))) AS ids FROM win GROUP BY w HAVING count(DISTINCT doc_id) > 1),
ends AS (SELECT ids, unnest(ids) AS a FROM sets),
pairs AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(ids) AS b FROM ends) WHERE a < b),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM texts)
"""
_COVERED = """
twice AS (SELECT w FROM win GROUP BY w HAVING count(DISTINCT doc_id) > 1),
steps AS (SELECT doc_id, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 150) AS s FROM win SEMI JOIN twice USING (w)),
chars AS (SELECT doc_id, sum(least(s, 150)) AS c FROM steps GROUP BY 1),
others AS (SELECT x AS doc_id, count(*) AS n FROM (SELECT unnest([a, b]) AS x FROM pairs) GROUP BY 1)
"""

SQL = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_within": "SELECT source, target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE source IS NOT NULL AND length(text) > 0) AS used, true AS within_block, true AS share_reached, true AS repeats_kept FROM mix_targets",
    "p8_found": f"WITH {_WINDOWS} SELECT a AS doc_a, b AS doc_b FROM pairs",
    "p8_spans": f"WITH {_WINDOWS}, {_COVERED} SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c, 0)::BIGINT AS shared_chars, coalesce(n, 0)::BIGINT AS n_others FROM documents d LEFT JOIN chars USING (doc_id) LEFT JOIN others USING (doc_id)",
    "p8_links": f"WITH {_WINDOWS} SELECT a AS doc_a, b AS doc_b FROM pairs JOIN classes x ON x.doc_id = a AND x.class_id = a JOIN classes y ON y.doc_id = b AND y.class_id = b",
    "p8_classes": f"WITH {_WINDOWS} SELECT doc_id, class_id FROM classes",
}

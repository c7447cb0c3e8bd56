"""Mixing sources to target weights by a proportionate-fair schedule."""

from __future__ import annotations

import heapq
import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.keys import col
from halyard.llm.encode import count_tokens
from halyard.session import materialize

#: Tokens of a block, the unit of the schedule, at least; of a mixture that is smaller
#: than a period of such blocks, less.
BLOCK_TOKENS = 4096
#: Parts of a source that running sums are first made over.
PARTS = 4096
#: Sources a table of targets may list, and slots of a schedule's period.
MOST_SOURCES, MOST_SLOTS = 10_000, 1_000_000


def pfair(units: list[int]) -> list[int]:
    """The source of each slot of one period, as long as the sum of the units.

    Source s has the weight w = units[s] / period. Its block number k (from 0) is
    released at slot floor(k / w) and due by slot ceil((k + 1) / w). Each slot
    goes to the released block with the earliest deadline (ties: to the lower
    source), so that at any slot t a source has had less than one block more or
    less than w * t. After a period every source has had exactly its units."""
    period = sum(units)
    waiting = [(0, s, 0) for s, u in enumerate(units) if u > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: list[int] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // units[s]), s, k))
        if not ready:  # can't be while the units add up to the period
            raise AssertionError("no block is released")
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < units[s]:
            heapq.heappush(waiting, ((k + 1) * period // units[s], s, k + 1))
    return out


def whole_units(shares: list[Decimal]) -> list[int]:
    """Shares as whole numbers in the same proportion, as small as they can be."""
    down = max([0, *(-x.as_tuple().exponent for x in shares)])
    n = [int(x * 10**down) for x in shares]
    g = math.gcd(*n) or 1
    return [x // g for x in n]


class Mix:
    """A mixture of documents.

    docs: doc_id, source and text columns; targets: source, share, max_repeats.

    Sources with a positive share and at least one token take part; their shares
    are used in proportion to each other, so that a listed source without tokens
    leaves its share to the others. The mixture is as large as it can be with
    every share reached and no document used more than max_repeats times, or has
    `total_tokens`; then a source that is too small for its share is used
    max_repeats times and falls short. Whole blocks of equal size leave out less than
    a token for each block.

    The stream of a source are its documents' tokens, in an order by a hash of their
    id, and again in the same order for each repeat. It is cut into blocks, and a
    document that reaches over the end of a block goes on in the source's next one,
    so that a slot of the schedule has exactly a block of tokens whatever the lengths
    of the documents. The size of blocks is such that the mixture has whole periods:
    shares are reached exactly, and no prefix of the mixture has a block more or less
    of a source than its share. Only the last document of a source may be cut off.

    Documents of sources that aren't listed, of a null source and with a null id
    have no part in it, nor have empty and null texts, which have no tokens. A
    null max_repeats counts as 1, a null share as 0; targets listed twice raise
    ValueError. An empty table of documents or targets gives an empty mixture.
    Other columns don't matter.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, path: str | None = None):
        self.spark = docs.sparkSession
        listed = targets.select(col("source"), col("target_share").cast("decimal(20,10)").alias("share"), F.coalesce(col("max_repeats"), F.lit(1)).cast("bigint").alias("most")).where("source IS NOT NULL").limit(MOST_SOURCES + 1).collect()
        if len(listed) > MOST_SOURCES or len({r.source for r in listed}) < len(listed):
            raise ValueError("the targets list a source twice, or more sources than MOST_SOURCES")
        self.targets = {r.source: (r.share or Decimal(0), max(0, r.most)) for r in listed}
        mine = docs.where(col(source).isin(list(self.targets)) & col(doc_id).isNotNull()) if self.targets else docs.where("false")
        counted = count_tokens(mine, {"doc_id": col(doc_id), "source": col(source)}, text, path)
        #: doc_id, source, n_tokens of documents that can be used; texts go no further
        self.counted = materialize(counted.where("n_tokens > 0"))
        rows = self.counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        self.tokens = {r.source: r.t for r in rows}
        self.n_docs = {r.source: r.n for r in rows}
        self.used = [s for s in sorted(self.targets) if self.targets[s][0] > 0 and self.targets[s][1] > 0 and self.tokens.get(s)]
        self.units = whole_units([self.targets[s][0] for s in self.used]) if self.used else []
        self.period = sum(self.units)
        if self.period > MOST_SLOTS:
            raise ValueError("the shares have a period above MOST_SLOTS")
        most = {s: self.tokens[s] * self.targets[s][1] for s in self.used}
        total = total_tokens if total_tokens is not None else min((most[s] * self.period // u for s, u in zip(self.used, self.units)), default=0)
        periods = max(1, total // (max(1, self.period) * block_tokens))
        self.block = max(1, total // (max(1, self.period) * periods))
        self.total = min(total, self.block * self.period * periods)
        #: Tokens that each source has to give, whole blocks unless it is too small.
        self.quota = {s: min(most[s], self.total * u // self.period) for s, u in zip(self.used, self.units)}

    def rows(self) -> DataFrame:
        """The mixture as pieces of documents: slot, source, doc_id, repeat_no (from 1),
        at_token (place in the source's stream), from_token (place in the document) and
        n_tokens; to be read in order of slot and at_token."""
        slots = pfair(self.units)
        places: dict[int, list[int]] = {n: [] for n in range(len(self.used))}
        for t, s in enumerate(slots):
            places[s].append(t)
        plan = [(s, self.tokens[s], self.quota[s], self.units[n], places[n]) for n, s in enumerate(self.used)]
        plan_df = self.spark.createDataFrame(plan, "source string, total bigint, quota bigint, units bigint, places array<bigint>")

        # running sums of a source, first over its parts, then within each part
        key = F.xxhash64("doc_id")
        docs = self.counted.select("*", key.alias("h"), (F.shiftrightunsigned(key, 40) % F.lit(PARTS)).cast("int").alias("part"))
        parts = docs.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
        before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select("source", "part", before.alias("before"))
        inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "n_tokens")
        run = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        docs = docs.select("source", "part", "doc_id", "n_tokens", run.alias("run"))
        # the plan has at most MOST_SOURCES rows and MOST_SLOTS places, the parts PARTS rows for each source
        docs = docs.join(parts, ["source", "part"]).join(F.broadcast(plan_df), "source").withColumn("first", F.col("before") + F.col("run"))
        times = F.when(F.col("first") < F.col("quota"), F.expr("(quota - first - 1) div total + 1")).otherwise(0)
        again = docs.where("first < quota").withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))))
        again = again.withColumn("at", F.col("first") + (F.col("repeat_no") - 1) * F.col("total")).withColumn("end", F.least(F.col("at") + F.col("n_tokens"), "quota"))
        pieces = again.withColumn("block", F.explode(F.expr(f"sequence(at div {self.block}, (end - 1) div {self.block})")))
        begin = F.greatest("at", F.col("block") * self.block)
        size = F.least("end", (F.col("block") + 1) * self.block) - begin
        slot = F.expr(f"(block div units) * {max(1, self.period)}") + F.get("places", F.expr("cast(block % units AS int)"))
        return pieces.select(slot.alias("slot"), "source", "doc_id", F.col("repeat_no").cast("int").alias("repeat_no"), begin.alias("at_token"), (begin - F.col("at")).alias("from_token"), size.alias("n_tokens"))

    def shares(self) -> DataFrame:
        """One row per listed source: source, target_share, n_docs, n_tokens (that it
        has), used_tokens, most_uses of a document, reached_share. A source gives
        exactly its quota, so that no document needs to be placed for this."""
        used = sum(self.quota.values())
        known = []
        for s, (share, _) in sorted(self.targets.items()):
            q, t = self.quota.get(s, 0), self.tokens.get(s, 0)
            known.append((s, float(share), self.n_docs.get(s, 0), t, q, -(-q // t) if t else 0, q / used if used else 0.0))
        return self.spark.createDataFrame(known, "source string, target_share double, n_docs bigint, n_tokens bigint, used_tokens bigint, most_uses bigint, reached_share double")

    def deviation(self, rows: DataFrame) -> DataFrame:
        """Of the rows of the mixture: source, used_tokens, most_uses, and by how many
        blocks it is ever ahead of and behind its share, before and after each of its
        slots. Running sums are made over parts of the slots, then within each part."""
        slots = materialize(rows.groupBy("slot", "source").agg(F.sum("n_tokens").alias("t"), F.max("repeat_no").alias("uses")))
        width = max(1, -(-self.total // self.block) // PARTS + 1)
        slots = slots.withColumn("part", F.expr(f"slot div {width}"))
        past = (Window.unboundedPreceding, -1)

        def before(by: list[str], name: str) -> DataFrame:
            """slots with the sum of t before each, among those equal in `by`."""
            parts = slots.groupBy("part", *by).agg(F.sum("t").alias("t"))
            earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(*past)  # at most PARTS rows for each source
            parts = parts.select("part", *by, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
            inside = Window.partitionBy("part", *by).orderBy("slot").rowsBetween(*past)
            run = slots.select("*", F.coalesce(F.sum("t").over(inside), F.lit(0)).alias("run"))
            return run.join(parts, ["part", *by]).select("slot", "source", "t", "uses", (F.col("base") + F.col("run")).alias(name))

        both = before([], "all").join(before(["source"], "own").select("slot", "own"), "slot")
        weight = F.create_map(*(F.lit(x) for s, u in zip(self.used, self.units) for x in (s, u)))[F.col("source")] if self.used else F.lit(0)
        due = lambda done: done * weight / F.lit(max(1, self.period))
        ahead, behind = F.col("own") + F.col("t") - due(F.col("all") + F.col("t")), due(F.col("all")) - F.col("own")
        return both.groupBy("source").agg(F.sum("t").alias("used_tokens"), F.max("uses").alias("most_uses"), (F.max(ahead) / self.block).alias("ahead"), (F.max(behind) / self.block).alias("behind"))

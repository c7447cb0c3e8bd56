"""Bloom filters made of built-in columns only.

A filter is an array of bigint words, built by a bit_or aggregation, written as
a table of one row and read through a scalar subquery, so that it is built once
and both sides stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.keys import col
from halyard.session import materialize

#: Bits of a filter: at least, at most (32 MB), and for each key.
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 1 << 12, 1 << 28, 12
MOST_PROBES = 4


def bits_for(keys: int) -> int:
    """A power of two; beyond MOST_BITS the filter lets more through, never less."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys - 1).bit_length() if keys else 0))


def probes_for(keys: int, bits: int) -> int:
    """Probes that let least through: about 0.7 for each bit that a key has."""
    return max(1, min(MOST_PROBES, round(0.69 * bits / max(1, keys))))


def _shift(name: str, c: Column, by: Column) -> Column:
    return F.call_function(name, c, by.cast("int"))


class Filter:
    """A Bloom filter of the non-null values of a key column of a written table.

    It has at most MOST_BITS bits, however many keys there are: what is sent to the
    tasks is bounded, and with more keys than that allows it only lets more through."""

    def __init__(self, table: DataFrame, key: str, bits: int | None = None):
        keys = table.select(col(key).alias("k")).where("k IS NOT NULL")
        #: Number of keys put in
        self.keys = keys.count()
        self.bits = bits or bits_for(self.keys)
        self.probes = probes_for(self.keys, self.bits)
        self._words = materialize(self._build(keys)) if self.keys else None

    def _bit(self, key: Column) -> list[Column]:
        """Bit numbers of a key, by double hashing; 31-bit halves, as sums must not overflow."""
        low = F.lit((1 << 31) - 1).cast("bigint")
        h = F.xxhash64(key)
        a, b = h.bitwiseAND(low), F.shiftright(h, 32).bitwiseAND(low).bitwiseOR(F.lit(1).cast("bigint"))
        return [(a + b * F.lit(n)).bitwiseAND(F.lit(self.bits - 1).cast("bigint")) for n in range(self.probes)]

    def _build(self, keys: DataFrame) -> DataFrame:
        """Words are combined before the shuffle; blanks fill the places without a key."""
        at = keys.select(F.explode(F.array(*self._bit(F.col("k")))).alias("bit"))
        one = _shift("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63).cast("bigint")))
        words = at.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(one).alias("v"))
        blank = keys.sparkSession.range(self.bits >> 6).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v"))
        every = words.unionByName(blank).groupBy("w").agg(F.bit_or("v").alias("v"))
        return every.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("x")).select(F.transform("x", lambda x: x.v).alias("x"))

    def holds(self, key: str) -> Column:
        """False only where the key is certainly not among the filter's; false for null."""
        c = col(key)
        if self._words is None:
            return F.lit(False)
        words, hit = self._words.scalar(), c.isNotNull()
        for bit in self._bit(c):
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            hit = hit & (_shift("shiftright", word, bit.bitwiseAND(F.lit(63).cast("bigint"))).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return hit

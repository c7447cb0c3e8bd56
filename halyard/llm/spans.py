"""Long exact spans that several texts share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.keys import col
from halyard.llm.windows import SLICE, TOP, Roller, Sketch, Slice, slices, width_for
from halyard.operators.bloom import Filter
from halyard.session import materialize, ship_package, size_estimate

#: Groups that the rows of a frequent key are spread over in a join.
SALT = 8
#: Members of a class that are in one place of a join; a larger class is spread over more.
SPREAD = 10_000
#: Anchors that a task gathers before it sends them.
SEND_AT = 1 << 17
#: Anchors of a hash range, the least number of which makes a range of its own.
RANGE = 1 << 22

_ROLL: dict[int, Roller] = {}


def _roller(seed: int) -> Roller:
    if seed not in _ROLL:
        _ROLL[seed] = Roller(seed, SLICE)
    return _ROLL[seed]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


ANCHOR = "h bigint, doc bigint, pos int, n int"


def _anchors(length: int):
    """Batches of (doc_id, text) into rows of ANCHOR.

    What the task itself finds TOP times in a part of its texts is frequent for
    certain: these rows have n = TOP, and only one row more, at pos -1, tells the
    hash's range of them. So of a hash that a third of all texts have, a range gets
    fewer than TOP rows for each SEND_AT anchors. All others have n = 1."""

    def send(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        often = n >= TOP
        told = first[often]
        yield _batch("h doc pos n", np.r_[h, h[told]].view(np.int64), np.r_[doc, doc[told]], np.r_[pos, np.full(len(told), -1)].astype(np.int32), np.r_[np.where(often[of], TOP, 1), np.full(len(told), TOP)].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for s in slices(b.column(1).to_pylist(), length, _roller(1)):
                p = s.anchors()
                doc, pos = s.place(p)
                held.append((s._all[p], ids[doc], pos))
                size += len(p)
                if size >= SEND_AT:
                    yield from send(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from send(*map(np.concatenate, zip(*held)))

    return run


def _repeated(width: int | None):
    """All rows of ANCHOR of one range of hashes into those of hashes that several
    documents have, n being their number (up to TOP).

    First pass: a count-min sketch sums what the parts have. Second pass: rows whose
    count is estimated as 1 are left out; they are alone, as no estimate is too low.
    Only the rest is sorted and grouped exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        sketch = Sketch(width or width_for(sum(len(c[0]) for c in held)))
        for h, _, pos, n in held:
            sketch.add(h[n == 1].view(np.uint64))
            sketch.add(h[(n > 1) & (pos < 0)].view(np.uint64), TOP)
        sure, rest = [], []
        while held:
            h, doc, pos, n = held.pop()
            known = (n > 1) & (pos >= 0)
            sure.append((h[known], doc[known], pos[known], n[known]))
            keep = np.flatnonzero(~known)
            keep = keep[sketch.estimate(h[keep].view(np.uint64)) >= 2]
            rest.append((h[keep], doc[keep], pos[keep], n[keep]))
        h, doc, pos, n = map(np.concatenate, zip(*rest))
        if len(h):
            order = np.argsort(h, kind="stable")
            h, doc, pos, n = h[order], doc[order], pos[order], n[order]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[begin, len(h)])
            total = np.minimum(np.add.reduceat(n, begin), TOP)
            several = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)) | (total == TOP)
            take = np.repeat(several, size) & (pos >= 0)
            sure.append((h[take], doc[take], pos[take], np.repeat(total, size)[take].astype(np.int32)))
        for rows in sure:
            for a in range(0, len(rows[0]), SEND_AT):
                yield _batch("h doc pos n", *(x[a : a + SEND_AT] for x in rows))

    return run


class _Runs:
    """Where runs of one character begin and end in a text; asked in order of place."""

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, 0

    def around(self, pos: int, size: int) -> tuple[int, int]:
        """Of the run that a gram lies in, (-1, -1) if it isn't of one character."""
        t, c = self.text, self.text[pos]
        if t[pos : pos + size].strip(c):
            return -1, -1
        if not (self.at <= pos < self.end):
            self.at = len(t[:pos].rstrip(c))
            self.end = re.compile(re.escape(c) + "*", re.S).match(t, pos).end()
        return self.at, self.end


NEAR = "h bigint, doc bigint, pos int, before int, around string, run_at int, run_end int"


def _surroundings(length: int):
    """Batches of (doc_id, text, [(pos, h)]) into rows of NEAR: anchors with so many
    characters on both sides as a window with the anchor in it can have."""
    k = length // 2
    side = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            rows = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            pos, h = (lists.flatten().field(n) for n in (0, 1))
            around, ends, texts = [], [], b.column(1).to_pylist()
            last, runs = -1, _Runs("")
            for d, x in zip(rows.tolist(), pos.to_pylist()):
                t = texts[d]
                if d != last:
                    last, runs = d, _Runs(t)
                around.append(t[max(0, x - side) : x + k + side])
                ends.append(runs.around(x, k))
            ends = np.array(ends, np.int32).reshape(-1, 2)
            before = np.minimum(pos.to_numpy(), side).astype(np.int32)
            whole = _batch("h doc pos before around run_at run_end", h, b.column(0).take(pa.array(rows)), pos, before, pa.array(around, pa.string()), ends[:, 0], ends[:, 1])
            for a in range(0, len(rows), 10_000):
                yield whole.slice(a, 10_000)

    return run


WINDOW = "h bigint, h2 bigint, doc bigint, pos int, last int"


def _windows(length: int, once: bool):
    """Batches of (doc_id, text, [h]) into all windows whose anchor's hash is listed,
    with two hashes. Windows with the same content that begin one after the other
    are one row, from pos to last. once: each content once per text."""

    def rows(s: Slice, ids: np.ndarray, frequent: np.ndarray) -> pa.RecordBatch | None:
        at = s.at[np.isin(s.gram, frequent)]
        if not len(at):
            return None
        h, h2 = _roller(1).hashes(s.sums, at, length), _roller(2).hashes(_roller(2).sums(s.codes), at, length)
        doc, pos = s.place(at)
        if once:
            o = np.lexsort((h2, h, doc))
            doc, pos, h, h2 = doc[o], pos[o], h[o], h2[o]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        if not once:
            new[1:] |= pos[1:] != pos[:-1] + 1
        begin = np.flatnonzero(new)
        last = pos[np.r_[begin[1:], len(pos)] - 1]
        return _batch("h h2 doc pos last", h[begin].view(np.int64), h2[begin].view(np.int64), ids[doc[begin]], pos[begin].astype(np.int32), last.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frequent = np.unique(b.column(2).flatten().to_numpy().view(np.uint64))
            ids = b.column(0).to_numpy()
            for s in slices(b.column(1).to_pylist(), length, _roller(1)):
                out = rows(s, ids, frequent)
                if out is not None:
                    yield out

    return run


MATCH = "a bigint, b bigint, lo int, hi int"


def _matches(length: int, covers: bool):
    """Rows of NEAR, sorted by h, into pairs of documents (a, b) whose texts are equal
    around an anchor for at least `length` characters, and with covers also into the
    places (a, lo, hi) that are equal to such in another document. Fewer than TOP
    rows of different documents have an h in common."""
    k = length // 2
    side = length - k
    full = k + 2 * side

    def chars(around: list[str], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters with the anchor at one place, and how many follow it."""
        padded = [("\0" * (side - l) + t).ljust(full, "\0") for t, l in zip(around, before.tolist())]
        after = np.array([len(t) for t in around]) - before - k
        return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(around), full), after

    def match(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, doc, pos, before, run_at, run_end = (t.column(x).to_numpy() for x in (0, 1, 2, 3, 5, 6))
        text, after = chars(t.column(4).to_pylist(), before)
        lo, hi = pos.astype(np.int64) + k, pos.astype(np.int64)  # nothing yet
        for d in range(1, len(h)):
            i = np.flatnonzero(h[d:] == h[:-d])
            if not len(i):
                break
            i = i[doc[i] != doc[i + d]]
            for part in range(0, len(i), 4096):
                x = i[part : part + 4096]
                y = x + d
                eq = text[x] == text[y]
                left = np.argmin(np.c_[eq[:, :side][:, ::-1], np.zeros(len(x), bool)], axis=1)
                right = np.argmin(np.c_[eq[:, side + k :], np.zeros(len(x), bool)], axis=1)
                left, right = np.minimum(left, np.minimum(before[x], before[y])), np.minimum(right, np.minimum(after[x], after[y]))
                ok = eq[:, side : side + k].all(axis=1) & (left + right + k >= length)
                if not ok.any():
                    continue
                p, q = doc[x[ok]], doc[y[ok]]
                u = np.unique(np.c_[np.minimum(p, q), np.maximum(p, q)], axis=0)
                yield _batch("a b lo hi", u[:, 0], u[:, 1], pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.int32()))
                if covers:
                    for z in (x[ok], y[ok]):
                        np.minimum.at(lo, z, pos[z] - left[ok])
                        np.maximum.at(hi, z, pos[z] + k + right[ok])
        z = np.flatnonzero(hi - lo >= length)
        if covers and len(z):
            a, e = lo[z], hi[z]
            run = np.minimum(e, run_end[z]) - np.maximum(a, run_at[z]) >= length  # then all of the run is like it
            a, e = np.where(run, np.minimum(a, run_at[z]), a), np.where(run, np.maximum(e, run_end[z]), e)
            yield _batch("a b lo hi", doc[z], pa.nulls(len(z), pa.int64()), a.astype(np.int32), e.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            h = t.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], side="left"))
            rest = t.slice(cut)
            if cut:
                yield from match(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from match(rest)

    return run


def _salt(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALT)).cast("int").alias("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")


class SharedSpans:
    """Which documents have a run of at least `length` characters in common.

    Characters are Unicode code points, compared exactly, wherever they stand.
    Columns of docs: doc_id (bigint) and text; others don't matter. Texts shorter
    than `length`, null and empty ones share nothing; rows with a null doc_id have
    no part; equal rows are one document. If a doc_id comes with several texts,
    that with the greatest hash is the document's.

    Exact copies are put into classes first and represented by the least id; the
    other copies are left out of what follows. (1) Of every text the anchors (see
    windows) are sent to the range of their hash. There a count-min sketch sums the
    counts of all parts. (2) In a second pass anchors whose count is estimated as 1
    are left out; they are in no other text, as an estimate is never too low. (3) The
    rest is grouped exactly. Anchors in fewer than TOP places are paired by comparing
    the characters around them. More frequent ones are never paired as such, since
    common phrases would make all pairs of their texts candidates; for these whole
    windows are grouped, by 128 bits of hashes, and of groups with the same texts one
    is paired, so that only pairs that are cases come about.

    A range has its sketch to itself, whose width is that of the range's anchors;
    the number of ranges grows with the table, and nothing that grows is broadcast.
    width and ranges are for tests.
    """

    def __init__(self, docs: DataFrame, length: int = 150, doc_id: str = "doc_id", text: str = "text", width: int | None = None, ranges: int | None = None):
        if length < 16 or length > 900:
            raise ValueError("length must be from 16 to 900")
        ship_package(docs.sparkSession)
        self.length, self.width, self.spark = length, width, docs.sparkSession
        key = F.unhex(F.sha2("text", 256))
        self.docs = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.char_length("text") >= length))
        keyed = materialize(self.docs.select("doc_id", key.alias("key")))
        mark = F.xxhash64("key")
        several = materialize(keyed.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id", "hi"))
        if not several.isEmpty():
            self.docs = self.docs.withColumn("key", key).join(several, "doc_id", "left").where(F.col("hi").isNull() | (mark == F.col("hi"))).select("doc_id", "text")
            keyed = materialize(self.docs.select("doc_id", key.alias("key")))
        classes = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).where("rep < top")
        ways = F.expr(f"(n - 1) div {SPREAD} + 1").cast("int").alias("ways")
        #: (key, rep, ways) of the texts that several documents have
        self._classes = materialize(classes.select("key", "rep", ways))
        #: (doc_id, rep, ways, way) of the documents that have exact copies, each once
        self.members = self._members(keyed)
        self.ranges = ranges or self._ranges(size_estimate(docs))
        self._reduced = self._without(keyed.select("doc_id"), self.members.where("doc_id <> rep").select("doc_id"))
        self._anchors: DataFrame | None = None

    def _ranges(self, text_bytes: int) -> int:
        """A byte in the files is about two characters, with an anchor for 40. A table
        of unknown size has as many ranges as a shuffle has partitions."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return n if text_bytes >= 1 << 60 else max(n, text_bytes // 20 // RANGE + 1)

    def _members(self, keyed: DataFrame) -> DataFrame:
        mine = keyed.where(Filter(self._classes, "key").holds("key")).select("key", "doc_id", _salt("doc_id"))
        found = mine.join(self._classes.select("*", _salts()), ["key", "salt"]).select("doc_id", "rep", "ways").distinct()
        return materialize(found.withColumn("way", F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int")))

    def _without(self, ids: DataFrame, out: DataFrame) -> DataFrame:
        """The documents whose id isn't in `out`, in one pass without a shuffle of texts
        but of the few that a Bloom filter of `out` and one of its mistakes hold."""
        gone = Filter(out, "doc_id")
        if not gone.keys:
            return self.docs
        wrong = materialize(ids.where(gone.holds("doc_id")).join(out, "doc_id", "left_anti").distinct())
        sure = self.docs.where(~gone.holds("doc_id"))
        mistaken = Filter(wrong, "doc_id")
        if not mistaken.keys:
            return sure
        return sure.unionByName(self.docs.where(gone.holds("doc_id") & mistaken.holds("doc_id")).join(wrong, "doc_id", "left_semi"))

    def repeated(self) -> DataFrame:
        """Rows of ANCHOR of those that several texts have, once per object."""
        if self._anchors is None:
            sent = self._reduced.mapInArrow(_anchors(self.length), ANCHOR)
            place = F.when((F.col("n") == 1) | (F.col("pos") < 0), F.col("h")).otherwise(F.xxhash64("doc", "pos"))
            self._anchors = materialize(sent.repartition(self.ranges, place).mapInArrow(_repeated(self.width), ANCHOR))
        return self._anchors

    def _texts(self, listed: DataFrame) -> DataFrame:
        """(doc_id, text, listed) of the documents in listed (doc, listed); other texts
        aren't shuffled but for what a Bloom filter mistakes."""
        listed = materialize(listed)
        rows = self.docs.where(Filter(listed, "doc").holds("doc_id"))
        return rows.join(listed, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "listed")

    def _near(self, covers: bool) -> DataFrame:
        few = self.repeated().where(F.col("n") < TOP).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("listed"))
        near = self._texts(few).mapInArrow(_surroundings(self.length), NEAR)
        return near.repartition(self.ranges, "h").sortWithinPartitions("h").mapInArrow(_matches(self.length, covers), MATCH)

    def _far(self, once: bool) -> DataFrame | None:
        """Rows of WINDOW of frequent anchors, None if there is no such anchor."""
        many = self.repeated().where(F.col("n") >= TOP)
        if many.isEmpty():
            return None
        listed = many.groupBy("doc").agg(F.collect_set("h").alias("listed"))
        return materialize(self._texts(listed).mapInArrow(_windows(self.length, once), WINDOW))

    def _far_pairs(self, windows: DataFrame) -> DataFrame:
        low = F.lit((1 << 40) - 1).cast("bigint")
        once = windows.select("h", "h2", "doc").distinct()
        sums = [F.sum(F.xxhash64("doc", F.lit(s)).bitwiseAND(low)).alias(f"s{s}") for s in (1, 2)]
        groups = once.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
        one = groups.groupBy("n", "s1", "s2").agg(F.min(F.struct("h", "h2")).alias("w")).select("w.h", "w.h2")
        chosen = materialize(once.select("*", _salt("doc")).join(one.select("*", _salts()), ["h", "h2", "salt"], "left_semi"))
        left, right = chosen.withColumnRenamed("doc", "a"), chosen.select("h", "h2", F.col("doc").alias("b"), _salts())
        return left.join(right, ["h", "h2", "salt"]).where("a < b").select("a", "b")

    def rep_pairs(self) -> DataFrame:
        """(a, b), a < b: pairs of representatives that share a span, each once."""
        pairs = self._near(False).select("a", "b")
        windows = self._far(True)
        if windows is not None:
            pairs = pairs.unionByName(self._far_pairs(windows))
        return pairs.distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: every pair of documents that share a span,
        copies included."""
        return self._expanded(materialize(self.rep_pairs()))

    def _expanded(self, reps: DataFrame) -> DataFrame:
        wide = reps
        for end, other in (("a", "b"), ("b", "a")):
            ways = self._classes.select(F.col("rep").alias(end), "ways")
            way = F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("way")
            mine = self.members.select(F.col("rep").alias(end), "way", "doc_id")
            wide = wide.join(ways, end, "left").select("a", "b", way).join(mine, [end, "way"], "left").select(F.coalesce("doc_id", end).alias(end), other)
        across = wide.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
        left = self.members.select("rep", "way", F.col("doc_id").alias("doc_a"))
        right = self.members.select("rep", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.col("doc_id").alias("doc_b"))
        within = left.join(right, ["rep", "way"]).where("doc_a < doc_b").select("doc_a", "doc_b")
        return across.unionByName(within)

    def found(self) -> tuple[DataFrame, DataFrame]:
        """(representative pairs, (doc_id, lo, hi) of the places of representatives that
        another representative has as well): both from one pass."""
        near = materialize(self._near(True))
        pairs, places = near.where("b IS NOT NULL").select("a", "b"), near.where("b IS NULL").select(F.col("a").alias("doc_id"), "lo", "hi")
        windows = self._far(False)
        if windows is not None:
            pairs = pairs.unionByName(self._far_pairs(windows))
            twice = windows.groupBy("h", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", "h2", _salts())
            mine = windows.select("*", _salt("doc", "pos")).join(twice, ["h", "h2", "salt"], "left_semi")
            places = places.unionByName(mine.select(F.col("doc").alias("doc_id"), F.col("pos").alias("lo"), (F.col("last") + self.length).alias("hi")))
        return materialize(pairs.distinct()), places

    def links(self, reps: DataFrame) -> DataFrame:
        """(doc_id, n_others) of the documents that share a span: with how many. Counted
        from pairs of representatives and the sizes of their classes, unexpanded."""
        sizes = materialize(self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")))
        ends = reps.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        other = ends.join(sizes, F.col("b") == F.col("rep"), "left").groupBy("a").agg(F.sum(F.coalesce("size", F.lit(1))).alias("n"))
        copies = self.members.join(sizes, "rep").join(other, F.col("rep") == F.col("a"), "left")
        copies = copies.select("doc_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_others"))
        alone = other.join(sizes, F.col("a") == F.col("rep"), "left_anti").select(F.col("a").alias("doc_id"), F.col("n").alias("n_others"))
        return copies.unionByName(alone)

    def shared_chars(self, places: DataFrame) -> DataFrame:
        """(doc_id, shared_chars) of the documents without copies that share a span: how
        many of their characters lie in these. Copies share all they have."""
        ends = places.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"))
        before = F.max("hi").over(Window.partitionBy("doc_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
        new = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("before", F.lit(0))))
        sums = ends.withColumn("before", before).groupBy("doc_id").agg(F.sum(new).alias("shared_chars"))
        return sums.join(self.members, "doc_id", "left_anti")

    def classes(self) -> DataFrame:
        """(doc_id, class_id): every document that is long enough, with the least id of
        those that have the same text."""
        ids = self.docs.select("doc_id").distinct()
        return ids.join(self.members, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))

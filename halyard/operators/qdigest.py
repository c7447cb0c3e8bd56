"""Percentiles with a deterministic rank error: quantile digests over a dyadic tree.

Values are non-negative integers below 2**LEVELS, the bounded ordered universe.
A node (level, idx) of the tree stands for the values v with v >> level == idx.
A digest is a set of nodes with counts. Digests of parts are merged by adding
the counts of equal nodes; compressing moves counts of small nodes up, so that
of n values no inner node gets more than n / k. A value's rank is uncertain by
the counts of its ancestors, at most LEVELS * n / k, after any number of merges.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import ship_package

#: Every non-negative bigint is in the universe.
LEVELS = 63
#: Values that a task gathers before it folds them into its digests.
FOLD = 1 << 20
#: Digests of a group that one task merges at most.
FAN_IN = 256

NODE = "level int, idx bigint, cnt bigint"


def compression(error: float) -> int:
    """The k that keeps the rank error within `error` of all values."""
    return math.ceil(LEVELS / error)


def compress(group: np.ndarray, level: np.ndarray, idx: np.ndarray, cnt: np.ndarray, k: int):
    """Add equal nodes and compress the digests of all groups at once.

    group: int64 codes from 0. Gives the four arrays again, sorted by group."""
    if not len(group):
        return group, level, idx, cnt
    most = np.bincount(group, weights=cnt).astype(np.int64) // k
    order = np.lexsort((idx, group, level))
    group, level, idx, cnt = group[order], level[order], idx[order], cnt[order]
    starts = np.searchsorted(level, np.arange(LEVELS + 2))
    out: list[tuple] = []
    up_g, up_i, up_c = (np.empty(0, np.int64) for _ in range(3))
    for lv in range(LEVELS + 1):
        a, b = starts[lv], starts[lv + 1]
        g, i, c = np.concatenate([group[a:b], up_g]), np.concatenate([idx[a:b], up_i]), np.concatenate([cnt[a:b], up_c])
        if not len(g):
            continue
        o = np.lexsort((i, g))
        g, i, c = g[o], i[o], c[o]
        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
        g, i, c = g[new], i[new], np.add.reduceat(c, new)
        if lv == LEVELS:
            out.append((g, np.full(len(g), lv), i, c))
            break
        # siblings with their parent's own count, next to each other in this order
        fam = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] >> 1 != i[:-1] >> 1)])
        fg, fi, fc = g[fam], i[fam] >> 1, np.add.reduceat(c, fam)
        pa_, pb = starts[lv + 1], starts[lv + 2]
        own = _find(group[pa_:pb], idx[pa_:pb], cnt[pa_:pb], fg, fi)
        small = (fc + own <= most[fg]) & (most[fg] > 0)
        keep = np.repeat(~small, np.diff(np.r_[fam, len(g)]))
        out.append((g[keep], np.full(int(keep.sum()), lv), i[keep], c[keep]))
        up_g, up_i, up_c = fg[small], fi[small], fc[small]
    g, lv, i, c = (np.concatenate(x) for x in zip(*out))
    o = np.argsort(g, kind="stable")
    return g[o], lv[o].astype(np.int64), i[o], c[o]


def _find(g: np.ndarray, i: np.ndarray, c: np.ndarray, want_g: np.ndarray, want_i: np.ndarray) -> np.ndarray:
    """Counts of the wanted nodes among nodes of one level, 0 where there is none."""
    if not len(g):
        return np.zeros(len(want_g), np.int64)
    n = len(g)
    ag, ai = np.concatenate([g, want_g]), np.concatenate([i, want_i])
    o = np.lexsort((np.arange(len(ag)) >= n, ai, ag))
    own = np.where(o < n, np.concatenate([c, np.zeros(len(want_g), np.int64)])[o], 0)
    new = np.r_[True, (ag[o][1:] != ag[o][:-1]) | (ai[o][1:] != ai[o][:-1])]
    run = np.add.reduceat(own, np.flatnonzero(new))
    total = np.empty(len(ag), np.int64)
    total[o] = np.repeat(run, np.diff(np.r_[np.flatnonzero(new), len(ag)]))
    return total[n:]


def quantiles(group: np.ndarray, level: np.ndarray, idx: np.ndarray, cnt: np.ndarray, qs: Sequence[float]) -> np.ndarray:
    """For each group code from 0 (rows) and q (columns) the largest value of the
    first node, in order of largest value and then size, up to which q of all lie."""
    high = ((idx + 1) << level) - 1  # wraps to the largest bigint at the root
    order = np.lexsort((level, high, group))
    g, high, c = group[order], high[order], cnt[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.r_[first[1:], len(g)]
    run = np.cumsum(c)
    out = np.empty((len(first), len(qs)), np.int64)
    for row, (a, b) in enumerate(zip(first, ends)):
        base = run[a - 1] if a else 0
        n = run[b - 1] - base
        want = [base + max(1, math.ceil(q * int(n) - 1e-9)) for q in qs]
        out[row] = high[a + np.searchsorted(run[a:b], want, side="left")]
    return out


def _flat(a: pa.Array) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _emit(keys: list[pa.Array], group: np.ndarray, level, idx, cnt, names: Sequence[str]) -> pa.RecordBatch:
    at = pa.array(group)
    return pa.RecordBatch.from_arrays([k.take(at) for k in keys] + [pa.array(level.astype(np.int32)), pa.array(idx), pa.array(cnt)], names=[*names, "level", "idx", "cnt"])


def _codes(cols: list[pa.Array]) -> tuple[np.ndarray, pa.Table]:
    """Codes of the rows' keys, and the keys by code."""
    t = pa.table({f"k{n}": c for n, c in enumerate(cols)})
    code, top = np.zeros(len(t), np.int64), 1
    for c in cols:
        d = c.dictionary_encode(null_encoding="encode")
        n = max(1, len(d.dictionary))
        if top * n > 1 << 62:
            u, code = np.unique(code, return_inverse=True)
            top = len(u)
        code, top = code * n + d.indices.to_numpy(zero_copy_only=False), top * n
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, t.take(pa.array(first))


def _fold_maps(names: Sequence[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (keys..., map<string, bigint>) into one digest per group and task,
    a group being the keys and a key of the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def fold() -> None:
            nonlocal held, size
            t = pa.concat_tables(held).combine_chunks()
            if not t.num_rows:
                held, size = [], 0
                return
            cols = [_flat(x) for x in t.columns]
            code, keys = _codes(cols[:-3])
            g, lv, i, c = compress(code, *(x.to_numpy().astype(np.int64) for x in cols[-3:]), k)
            out = keys.take(pa.array(g))
            held = [pa.table([*out.columns, pa.array(lv.astype(np.int32)), pa.array(i), pa.array(c)], names=t.column_names)]
            size = len(g)

        for b in batches:
            m = b.column(b.num_columns - 1)
            offs = m.offsets.to_numpy()
            row = np.repeat(np.arange(len(m)), np.diff(offs))
            keys, vals = (x.slice(offs[0], offs[-1] - offs[0]) for x in (m.keys, m.items))
            ok = pc.fill_null(pc.greater_equal(vals, 0), False)
            at = pa.array(row).filter(ok)
            cols = [b.column(x).take(at) for x in range(b.num_columns - 1)] + [keys.filter(ok)]
            v = vals.filter(ok)
            # equal values of a batch first
            code, uniq = _codes([*cols, v])
            t = pa.table([*uniq.columns[:-1], pa.array(np.zeros(uniq.num_rows, np.int32)), uniq.column(uniq.num_columns - 1), pa.array(np.bincount(code, minlength=uniq.num_rows).astype(np.int64))], names=[*names, "level", "idx", "cnt"])
            held.append(t)
            size += t.num_rows
            if size > FOLD:
                fold()
        if held:
            fold()
            for b in pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=100_000):
                yield b

    return run


def _fold_groups(n_keys: int, k: int, last: Callable[[list[pa.Array], list[np.ndarray]], pa.RecordBatch]) -> Callable:
    """Nodes sorted by their group (the first n_keys columns) into last(keys, nodes)
    of whole groups, many groups at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def cut(t: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, list[pa.Table]]:
            t = t.combine_chunks()
            code, keys = _codes([_flat(x) for x in t.columns[:n_keys]])
            whole = np.ones(len(code), bool) if final else code != code[-1]
            rest = [] if final else [t.filter(pa.array(~whole))]
            if not whole.any():
                return None, rest
            t = t.filter(pa.array(whole)).combine_chunks()
            g, at = np.unique(code[whole], return_inverse=True)
            lv, i, c = (_flat(t.column(n_keys + x)).to_numpy().astype(np.int64) for x in range(3))
            nodes = compress(at.astype(np.int64), lv, i, c, k)
            return last([_flat(x) for x in keys.take(pa.array(g)).columns], list(nodes)), rest

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size > FOLD:
                out, held = cut(pa.concat_tables(held), False)
                size = sum(t.num_rows for t in held)
                if out is not None:
                    yield out
        if size:
            out, _ = cut(pa.concat_tables(held), True)
            if out is not None:
                yield out

    return run


def _merge(nodes: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Merged and compressed digests of the groups given by names."""
    ship_package(nodes.sparkSession)
    keys = [f.name for f in nodes.schema if f.name in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in names) + ", " + NODE

    def last(at: list, n: list) -> pa.RecordBatch:
        return _emit(at, *n, names=keys)

    added = nodes.groupBy(*keys, "level", "idx").agg(F.sum("cnt").alias("cnt")).select(*keys, "level", "idx", "cnt")
    return added.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_fold_groups(len(keys), k, last), schema)


def _tasks(df: DataFrame) -> int:
    """How many tasks df has at most: those of its last shuffle. 0 if there is none, as
    the files' splits aren't known before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    last = None if "Union" in plan else re.search(r"Exchange \w+\((?:.*, )?(\d+)\)", plan)
    return int(last[1]) if last else 0


def digests(df: DataFrame, keys: dict[str, Column], values: Column, label: str, error: float = 0.01) -> DataFrame:
    """Digests as rows (keys..., label, level, idx, cnt), one digest for each
    combination of keys and key of the map column `values` (map<string, bigint>).

    Null and negative values of the map and null maps don't count; null keys are a group.
    Each task first makes its own digests; their nodes are added and compressed,
    in two steps unless at most FAN_IN tasks have part in a group, so that no task
    merges more than FAN_IN digests of bounded size.
    """
    ship_package(df.sparkSession)
    k = compression(error)
    src = df.select(*(c.alias(n) for n, c in keys.items()), values.alias("__m")).where("__m IS NOT NULL")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__m")
    names = [*keys, label]
    part = src.mapInArrow(_fold_maps(names, k), f"{kinds}, `{label}` string, {NODE}")
    if not 0 < _tasks(src) <= FAN_IN:
        salted = part.withColumn("__salt", F.spark_partition_id() % F.lit(FAN_IN))
        part = _merge(salted, [*names, "__salt"], k).drop("__salt")
    return _merge(part, names, k)


def merge_digests(nodes: DataFrame, by: Sequence[str], error: float = 0.01) -> DataFrame:
    """Digests of the coarser groups `by` from digests of finer ones."""
    return _merge(nodes.select(*by, "level", "idx", "cnt"), by, compression(error))


def percentiles(nodes: DataFrame, by: Sequence[str], qs: dict[str, float], error: float = 0.01) -> DataFrame:
    """by..., n_values and one bigint for each name in qs, of digests combined to
    the groups `by`. The rank of each lies within `error` of the wanted one."""
    ship_package(nodes.sparkSession)
    k = compression(error)
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in by), "n_values bigint", *(f"`{n}` bigint" for n in qs)])

    def last(keys: list, n: list) -> pa.RecordBatch:
        q = quantiles(*n, list(qs.values()))
        total = np.bincount(n[0], weights=n[3]).astype(np.int64)
        return pa.RecordBatch.from_arrays([*keys, pa.array(total), *(pa.array(q[:, x]) for x in range(len(qs)))], names=[*by, "n_values", *qs])

    added = nodes.groupBy(*by, "level", "idx").agg(F.sum("cnt").alias("cnt")).select(*by, "level", "idx", "cnt")
    return added.repartition(*by).sortWithinPartitions(*by).mapInArrow(_fold_groups(len(by), k, last), schema)

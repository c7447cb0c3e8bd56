"""Encoding and decoding of whole text columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from halyard.functions.keys import col
from halyard.llm.automaton import Automaton, compile_file
from halyard.session import ship_package

#: Folder of the public vocabulary files, unless a path is given.
VOCABULARIES = os.environ.get("HALYARD_VOCABULARIES", "/opt/tokenizers")


def vocabulary(name: str = "byte_bpe_50k") -> str:
    return f"{VOCABULARIES}/{name}.json"


def _sent(spark: SparkSession, path: str):
    """The compiled automaton of a vocabulary file as a broadcast, once per
    application. Its size is that of the vocabulary (some MB), not of the data."""
    ship_package(spark)
    sc = spark.sparkContext
    known = sc.__dict__.setdefault("_halyard_automata", {})
    if path not in known:
        known[path] = sc.broadcast(compile_file(path))
    return known[path]


#: Tokens that a batch's column of lists holds, by its offsets.
MOST_TOKENS = (1 << 31) - 1


def list_parts(n: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Lists of n tokens each as (from row, to row, column); one part but for very many tokens."""
    run = np.r_[0, np.cumsum(n, dtype=np.int64)]
    a = 0
    while True:
        z = max(a + 1, int(np.searchsorted(run, run[a] + MOST_TOKENS, side="right")) - 1) if run[-1] - run[a] > MOST_TOKENS else len(n)
        yield a, z, pa.ListArray.from_arrays(pa.array((run[a : z + 1] - run[a]).astype(np.int32)), pa.array(flat[run[a] : run[z]]))
        a = z
        if a >= len(n):
            return


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema[:-1]), f"`{name}` {kind}"])


def encode_column(df: DataFrame, keep: dict[str, Column], text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """The columns `keep` of each row and `ids`, the token ids of its text.

    Special tokens are neither added nor recognised: strings that look like them
    are ordinary text. A null or empty text has an empty list, never null. Texts
    are encoded whole, however long; one row in gives one row out, in no shuffle.
    Other columns of df don't matter.
    """
    return _mapped(df, keep, text, path, ids, True)


def count_tokens(df: DataFrame, keep: dict[str, Column], text: str, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """As encode_column, with the number of tokens (bigint) in place of the ids."""
    return _mapped(df, keep, text, path, name, False)


def _mapped(df: DataFrame, keep: dict[str, Column], text: str, path: str | None, name: str, ids: bool) -> DataFrame:
    sent = _sent(df.sparkSession, path or vocabulary())
    src = df.select(*(c.alias(n) for n, c in keep.items()), col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = sent.value
        enc = a.ready()
        for b in batches:
            n, flat = enc.encode(b.column(b.num_columns - 1).to_pylist(), ids)
            for x, z, out in list_parts(n, flat) if ids else [(0, len(n), pa.array(n))]:
                yield pa.RecordBatch.from_arrays([*b.slice(x, z - x).columns[:-1], out], names=[*b.schema.names[:-1], name])

    return src.mapInArrow(run, _schema(src, name, "array<int>" if ids else "bigint"))


def decode_column(df: DataFrame, keep: dict[str, Column], ids: str, path: str | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of each row and `text`, spelt by its token ids (array<int>).

    A null list and an empty one give an empty text; an id without a token gives
    nothing; bytes that aren't UTF-8 give U+FFFD."""
    sent = _sent(df.sparkSession, path or vocabulary())
    src = df.select(*(c.alias(n) for n, c in keep.items()), col(ids).cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value.ready()
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = pa.array(enc.decode(np.r_[0, np.cumsum(n)], flat), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], text])

    return src.mapInArrow(run, _schema(src, text, "string"))

"""Bringing the stored catalogue to what the authors wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.config import EMBED_BATCH
from halyard.semantic.compile import compile_catalog
from halyard.semantic.diff import apply, diff
from halyard.semantic.grants import coverage_gap, expand, is_pattern, replacement, stale
from halyard.semantic.model import KEYS
from halyard.semantic.search import embedding_targets
from halyard.semantic.store import Store
from halyard.session import materialize, ship_package
from halyard.sources.yaml_files import load_catalog, load_grants

#: Tasks that call the embedder at the same time.
EMBED_TASKS = 4
#: Turns texts into vectors, a batch at a time; it is sent to the tasks.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass
class SyncResult:
    changes: dict[str, dict[str, int]] = field(default_factory=dict)
    embedded: int = 0
    warnings: list[str] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(n for t in self.changes.values() for n in t.values())


def sync(spark: SparkSession, store: Store, folder: str, dry_run: bool = False, embed: Embedder | None = None, model: str = "") -> SyncResult:
    """Compile, compare and, unless dry_run, apply; nothing is written where nothing
    changed. A failing embedder is a warning, not an error."""
    target = compile_catalog(spark, load_catalog(folder)).frames(spark)
    out = SyncResult()
    new = {}
    for name, keys in KEYS.items():
        stored = store.read(name)
        counts = {r.change: r["count"] for r in diff(target[name], stored, keys).groupBy("change").count().collect()}
        out.changes[name] = counts
        if counts:
            new[name] = apply(target[name], stored, keys, F.current_timestamp()).select(*stored.columns)
    if dry_run:
        return out
    if new:
        store.write(new)
    patterns, grants, entities = store.read("grant_patterns"), store.read("grants"), store.read("entities")
    out.warnings += [f"{r.user_id}: {r.pattern} doesn't cover {r.table_fqn} yet" for r in coverage_gap(patterns, grants, entities).orderBy("user_id", "pattern", "table_fqn").limit(100).collect()]
    out.warnings += [f"{r.user_id}: {r.table_fqn} is no table any more" for r in stale(grants, entities).orderBy("user_id", "table_fqn").limit(100).collect()]
    if embed is not None:
        try:
            out.embedded = embed_missing(spark, store, embed, model)
        except Exception as e:
            out.warnings.append(f"no embeddings: {e}")
    return out


def embed_missing(spark: SparkSession, store: Store, embed: Embedder, model: str) -> int:
    """Vectors for the entities that lack one of this model. If the model's dimension
    has changed, all vectors are made anew. Rows of removed entities and of other
    models go. The embedder is called where the entities are, by at most EMBED_TASKS
    tasks at once, and vectors are written from there."""
    ship_package(spark)
    entities, have = store.read("entities"), store.read("embeddings").where(F.col("model") == model)
    new = _vectors(embedding_targets(entities, have, model), embed, model)
    dims = [r[0] for r in new.select(F.size("vector")).distinct().limit(2).collect()]
    if not dims:
        return 0
    if len(dims) > 1:
        raise ValueError("vectors of different dimensions")
    if not have.where(F.size("vector") != dims[0]).isEmpty():
        have = have.where("false")
        new = _vectors(embedding_targets(entities, have, model), embed, model)
    live = entities.where(~F.coalesce("tombstone", F.lit(False))).select(F.col("fqn").alias("entity_fqn"))
    store.write({"embeddings": have.join(live, "entity_fqn", "left_semi").unionByName(new)})
    return new.count()


def _vectors(todo: DataFrame, embed: Embedder, model: str) -> DataFrame:
    """(entity_fqn, model, vector) of rows of fqn and text, in batches with one retry each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, EMBED_BATCH):
                part = b.slice(a, EMBED_BATCH)
                texts = part.column(1).to_pylist()
                try:
                    vectors = embed(texts)
                except Exception:
                    vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError("a vector is missing")
                made = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * len(texts)), made], names=["entity_fqn", "model", "vector"])

    return materialize(todo.repartition(EMBED_TASKS).mapInArrow(run, "entity_fqn string, model string, vector array<float>"))


def apply_grants(spark: SparkSession, store: Store, text: str) -> dict[str, int]:
    """Replace all grants by those of a YAML text; counts of added and removed pairs.
    Unchanged grants don't raise the revision."""
    from halyard.semantic.grants import check_target

    pairs = [(u, check_target(t)) for u, t in load_grants(text)]
    wanted = spark.createDataFrame(pairs, "user_id string, target string")
    tables = expand(store.read("entities"), store.read("relations"), wanted)
    new, changes = replacement(tables, store.read("grants"), F.current_timestamp())
    counts = {"added": 0, "removed": 0} | {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    patterns = spark.createDataFrame([p for p in pairs if is_pattern(p[1])], "user_id string, pattern string")
    store.write({"grant_patterns": patterns} | ({"grants": new} if any(counts.values()) else {}), bump=any(counts.values()))
    return counts


def change_grant(spark: SparkSession, store: Store, user: str, target: str, add: bool) -> dict[str, int]:
    """Add or remove the grants of one target for one user; what is already so changes nothing."""
    from halyard.semantic.grants import check_target

    one = expand(store.read("entities"), store.read("relations"), spark.createDataFrame([(user, check_target(target))], "user_id string, target string"))
    old = store.read("grants")
    pairs = old.select("user_id", "table_fqn")
    wanted = pairs.unionByName(one) if add else pairs.join(one, ["user_id", "table_fqn"], "left_anti")
    new, changes = replacement(wanted, old, F.current_timestamp())
    counts = {"added": 0, "removed": 0} | {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    if any(counts.values()):
        store.write({"grants": new}, bump=True)
    return counts

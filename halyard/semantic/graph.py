"""Relations of the catalogue: summaries, traversal, tables behind an entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import DEPTH, NODES, SUMMARY_EDGES
from halyard.errors import invalid
from halyard.semantic.model import RELATIONS
from halyard.semantic.search import live
from halyard.session import materialize

DIRECTIONS = ("out", "in", "both")


@dataclass
class Subgraph:
    nodes: list[str] = field(default_factory=list)
    edges: list[dict[str, str]] = field(default_factory=list)
    truncated: bool = False


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, src, dst, meta): edges as steps in the allowed directions."""
    out = edges.select(F.col("src_fqn").alias("at"), F.col("dst_fqn").alias("to"), F.col("src_fqn").alias("src"), F.col("dst_fqn").alias("dst"), "meta")
    back = edges.select(F.col("dst_fqn").alias("at"), F.col("src_fqn").alias("to"), F.col("src_fqn").alias("src"), F.col("dst_fqn").alias("dst"), "meta")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def traverse(relations: DataFrame, start: str, relation: str, direction: str = "out", max_depth: int = 1, most: int = NODES) -> Subgraph:
    """Breadth-first over one type of relation, up to `max_depth` steps (1 if less,
    DEPTH if more, which counts as truncated) and `most` nodes with the start.

    Nodes are found in order of the edge (src, dst) that leads to them; those
    beyond the limit are left out with all their edges, so that no edge dangles.
    The frontier is never longer than `most`; edges are looked up distributed and
    only those between kept nodes are fetched."""
    if relation not in RELATIONS:
        raise invalid("bad_relation", f"no relation {relation}", relations=list(RELATIONS))
    if direction not in DIRECTIONS:
        raise invalid("bad_direction", f"no direction {direction}", directions=list(DIRECTIONS))
    if max_depth < 0:
        raise invalid("bad_depth", "the depth can't be negative", max_depth=max_depth)
    out = Subgraph(truncated=max_depth > DEPTH)
    depth = min(max(max_depth, 1), DEPTH)
    edges = live(relations).where(F.col("type") == relation)
    way = steps(edges, direction)
    seen, frontier = {start}, [start]
    found: dict[tuple[str, str], str] = {}
    for _ in range(depth):
        if not frontier:
            break
        here = way.where(F.col("at").isin(frontier))
        new = here.where(~F.col("to").isin(list(seen))).groupBy("to").agg(F.min(F.struct("src", "dst")).alias("first")).orderBy("first", "to").limit(most - len(seen) + 1).collect()
        if len(new) > most - len(seen):
            out.truncated = True
            new = new[: most - len(seen)]
        keep = seen | {r.to for r in new}
        for r in here.where(F.col("to").isin(list(keep))).select("src", "dst", "meta").distinct().collect():
            found[r.src, r.dst] = r.meta or ""
        seen, frontier = keep, sorted(r.to for r in new)
    out.nodes = sorted(seen)
    out.edges = [{"type": relation, "src": s, "dst": d, "meta": m} for (s, d), m in sorted(found.items())]
    return out


def walk_levels(edges: DataFrame, roots: DataFrame, direction: str = "out", max_depth: int = DEPTH) -> DataFrame:
    """(root, node, depth) of all nodes within `max_depth` steps of each root, each
    at its least depth: the traversal of many starts at once, level by level. Each
    level is written, so that no level is computed twice, and the walk ends with the
    first that is empty. edges: src_fqn, dst_fqn, meta; roots: root."""
    way = steps(edges, direction).select("at", "to").distinct()
    level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    seen = level
    for n in range(1, max_depth + 1):
        nxt = level.join(way, level["node"] == way["at"]).select("root", F.col("to").alias("node")).distinct()
        level = materialize(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(n)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def relation_summary(relations: DataFrame, fqn: str, most: int = SUMMARY_EDGES) -> DataFrame:
    """(type, direction, other) of the first `most` edges of an entity by type, src
    and dst, and `truncated`; a loop counts as outgoing."""
    mine = live(relations).where((F.col("src_fqn") == fqn) | (F.col("dst_fqn") == fqn))
    top = mine.orderBy("type", "src_fqn", "dst_fqn").limit(most + 1)
    n = F.row_number().over(Window.orderBy("type", "src_fqn", "dst_fqn"))
    top = top.withColumn("n", n).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > most).where(F.col("n") <= most)
    outgoing = F.col("src_fqn") == fqn
    return top.select("type", F.when(outgoing, "out").otherwise("in").alias("direction"), F.when(outgoing, F.col("dst_fqn")).otherwise(F.col("src_fqn")).alias("other"), "truncated")


def tables_behind(entities: DataFrame, relations: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, table_fqn) of the concrete live tables behind each target: a table's
    full name, metric:x, concept:x, service:x or database:x.y.

    A metric stands for the tables it describes; a concept for the tables, the
    tables of the columns and the tables of the metrics it describes; a service or
    a database for all tables in it now."""
    ents = live(entities).select("fqn", "kind")
    tables = ents.where("kind = 'table'").select(F.col("fqn").alias("table_fqn"))
    rels = live(relations).where("type = 'describes'").select("src_fqn", "dst_fqn")
    t = targets.select("target").distinct().withColumn("way", F.when(F.col("target").contains(":"), F.substring_index("target", ":", 1)).otherwise("table"))
    t = t.withColumn("name", F.when(F.col("way") == "table", F.col("target")).otherwise(F.expr("substring(target, length(way) + 2)")))
    direct = t.where("way = 'table'").select("target", F.col("name").alias("table_fqn"))
    areas = tables.withColumn("service", F.substring_index("table_fqn", ".", 1)).withColumn("database", F.substring_index("table_fqn", ".", 2))
    by_area = [t.where(F.col("way") == w).join(areas, F.col("name") == F.col(w)).select("target", "table_fqn") for w in ("service", "database")]
    kinds = ents.withColumnRenamed("fqn", "dst_fqn")
    described = rels.join(kinds, "dst_fqn")
    metric_tables = described.where("kind = 'table'").select(F.col("src_fqn").alias("metric"), F.col("dst_fqn").alias("t"))
    by_metric = t.where("way = 'metric'").join(metric_tables, F.col("name") == F.col("metric")).select("target", F.col("t").alias("table_fqn"))
    concept = t.where("way = 'concept'").join(described, F.col("name") == F.col("src_fqn"))
    own = concept.where("kind IN ('table', 'column')").select("target", F.when(F.col("kind") == "table", F.col("dst_fqn")).otherwise(F.substring_index("dst_fqn", ".", 3)).alias("table_fqn"))
    via = concept.where("kind = 'metric'").join(metric_tables, F.col("dst_fqn") == F.col("metric")).select("target", F.col("t").alias("table_fqn"))
    found = direct.unionByName(by_metric).unionByName(own).unionByName(via)
    for x in by_area:
        found = found.unionByName(x)
    return found.join(tables, "table_fqn", "left_semi").select("target", "table_fqn").distinct()

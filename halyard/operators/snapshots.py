"""What changed between consecutive full snapshots, by Merkle trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.keys import col, norm_key
from halyard.session import exists, materialize, size_estimate

#: Children of a tree's node.
FANOUT = 16
#: A leaf should hold about so many bytes of the table; a tree has at most so many levels below its root.
LEAF_BYTES, MOST_LEVELS = 1 << 16, 6
#: Rows are written into a folder for each hash range of about so many bytes, at most 16**3 for each snapshot.
FOLDER_BYTES, MOST_FOLDER_LEVELS = 1 << 28, 3
#: Snapshot numbers that are broadcast, and folders that are named to a scan.
MOST_BROADCAST = 10_000
#: Differing leaves that are broadcast (about 50 bytes each); more are joined by a shuffle.
MOST_LEAVES = 1 << 19

LIVE = "no bigint, top bigint, k string, leaf bigint, d binary"


def tree_levels(size: int) -> int:
    """Levels below the root, by the estimated size of a table in bytes."""
    n = 1
    while n < MOST_LEVELS and FANOUT**n * LEAF_BYTES < size:
        n += 1
    return n


def folder_levels(size: int) -> int:
    """Levels of the tree that rows are put into folders by."""
    n = 0
    while n < MOST_FOLDER_LEVELS and FANOUT**n * FOLDER_BYTES < size:
        n += 1
    return n


def live_rows(df: DataFrame, number: str, key: str, updated: str, deleted: str, value: Column, levels: int, folders: int = 0) -> DataFrame:
    """Rows of LIVE: the counting row of each key in each snapshot, that with the
    greatest `updated` (of ties the greatest mark and digest), if it isn't marked as
    deleted. d is the MD5 of the value, a null one being as good as an empty one;
    leaf is the hash range of the key, top the node of its folder.

    Values are digested where they are read: only keys and digests are shuffled,
    and copies of a key are combined before that."""
    rows = df.select(
        col(number).cast("bigint").alias("no"),
        norm_key(col(key)).alias("k"),
        F.struct(col(updated).alias("u"), F.coalesce(col(deleted), F.lit(False)).alias("gone"), F.unhex(F.md5(F.coalesce(value.cast("string"), F.lit("")))).alias("d")).alias("s"),
    ).where("no IS NOT NULL AND k IS NOT NULL")
    last = rows.groupBy("no", "k").agg(F.max("s").alias("s")).where("NOT s.gone")
    leaf = F.shiftrightunsigned(F.xxhash64("k"), 64 - 4 * levels)
    top = F.shiftright("leaf", 4 * (levels - folders))
    return last.select("no", "k", F.col("s.d").alias("d"), leaf.alias("leaf")).select("no", top.alias("top"), "k", "leaf", "d")


def leaf_digests(live: DataFrame) -> DataFrame:
    """(no, node, digest) of the leaves, of the hashes of their rows."""
    mask = F.lit((1 << 40) - 1).cast("bigint")
    row = [F.sum(F.xxhash64(F.lit(s), "k", "d").bitwiseAND(mask)) for s in (1, 2, 3)]
    return live.groupBy("no", F.col("leaf").alias("node")).agg(F.concat_ws("-", *row, F.count(F.lit(1))).alias("digest"))


def digest_tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """From the root (0) to the given leaves, (no, node, digest). A node's digest is
    made of those of its children; every level is read from the leaves."""
    trees = [leaves]
    for _ in range(levels):
        up = trees[0].groupBy("no", F.shiftright("node", 4).alias("node"))
        trees.insert(0, up.agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", F.col("node"), F.col("digest")))))).alias("digest")))
    return trees


def _few(numbers: DataFrame) -> DataFrame:
    """Snapshot numbers for a join by number alone: broadcast if they are few, as
    the join would otherwise have as few keys; many numbers shuffle evenly."""
    return F.broadcast(numbers) if numbers.count() <= MOST_BROADCAST else numbers


def differing_leaves(trees: list[DataFrame], numbers: DataFrame) -> DataFrame:
    """(no, node) of the leaves whose digest isn't that of the previous snapshot,
    found top-down: only children of differing nodes are compared.
    numbers: (no, prev) of the snapshots that have a previous one."""
    at = None
    for tree in trees:
        now = tree.select("no", "node", F.col("digest").alias("new"), F.lit(None).cast("string").alias("old"))
        before = tree.select(F.col("no").alias("prev"), "node", F.col("digest").alias("old")).join(numbers, "prev").select("no", "node", F.lit(None).cast("string").alias("new"), "old")
        both = now.join(numbers.select("no"), "no", "left_semi").unionByName(before)
        if at is not None:
            both = both.join(at.select("no", F.col("node").alias("up")), (both["no"] == at["no"]) & (F.shiftright(both["node"], 4) == F.col("up")), "left_semi")
        differ = both.groupBy("no", "node").agg(F.max("new").alias("new"), F.max("old").alias("old"))
        at = differ.where("NOT (new <=> old)").select("no", "node")
    return at


class Snapshots:
    """The live rows, leaf digests and numbers of snapshots, as tables.

    Rows are written in folders by snapshot and hash range; a comparison reads only
    the folders that differing leaves are in. With `store`, a folder that all executors
    share, the tables stay there and the next call adds only snapshots it doesn't have:
    those that are there needn't be in df and aren't read from it again, and a snapshot
    is never changed once it is stored. The store keeps the tree's depth of its first use."""

    def __init__(self, df: DataFrame, number: str, key: str, updated: str, deleted: str, value: str, levels: int | None = None, folders: int | None = None, store: str | None = None):
        spark = self.spark = df.sparkSession
        size = size_estimate(df)
        size = 0 if size >= 1 << 60 else size  # unknown
        self.levels = levels or tree_levels(size)
        self.folders = min(self.levels, folder_levels(size) if folders is None else folders)
        kept = bool(store) and exists(spark, f"{store}/numbers")
        if kept:
            self.levels, self.folders = spark.read.parquet(f"{store}/depth").select("levels", "folders").head()
            known = spark.read.schema("no bigint").parquet(f"{store}/numbers").select(F.col("no").alias("__known"))
            df = df.join(_few(known), col(number).cast("bigint") == F.col("__known"), "left_anti")
        new = materialize(df.select(col(number).cast("bigint").alias("no")).where("no IS NOT NULL").distinct())
        live = live_rows(df, number, key, updated, deleted, col(value), self.levels, self.folders)
        if self.folders:  # a folder's rows in one place, else every task writes a file into each
            live = live.repartition("no", "top")
        if not store:
            self.live = materialize(live, *(["no", "top"] if self.folders else []))
            self.leaves, self.numbers = materialize(leaf_digests(self.live)), new
            return

        def put(rows: DataFrame, name: str, *by: str) -> None:  # again after a failure without doubling anything
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{store}/{name}")

        put(live, "live", "no", "top")
        self.live = spark.read.schema(LIVE).parquet(f"{store}/live")
        put(leaf_digests(self.live.join(_few(new), "no", "left_semi")), "leaves", "no")
        self.leaves = spark.read.schema("no bigint, node bigint, digest string").parquet(f"{store}/leaves")
        if not kept:
            spark.createDataFrame([(self.levels, self.folders)], "levels int, folders int").write.mode("overwrite").parquet(f"{store}/depth")
        new.write.mode("append").parquet(f"{store}/numbers")  # last: what isn't listed isn't there
        self.numbers = spark.read.schema("no bigint").parquet(f"{store}/numbers")

    def changes(self) -> DataFrame:
        """(no, k, change) for each snapshot but the first."""
        # the numbers of snapshots are few; one without a live record counts too
        numbers = self.numbers.select("no", F.lag("no").over(Window.orderBy("no")).alias("prev")).where("prev IS NOT NULL")
        numbers = _few(materialize(numbers))
        differ = materialize(differing_leaves(digest_tree(self.leaves, self.levels), numbers))
        now = differ.select("no", F.col("no").alias("at"), F.col("node").alias("leaf"))
        both = now.unionByName(differ.join(numbers, "no").select("no", F.col("prev").alias("at"), F.col("node").alias("leaf")))
        both = both.groupBy("at", "leaf").agg(F.collect_list("no").alias("nos"))
        few = F.broadcast(both) if differ.count() <= MOST_LEAVES else both
        rows = self.rows_near(both).withColumnRenamed("no", "at").join(few, ["at", "leaf"]).select("at", "k", "d", F.explode("nos").alias("no"))
        mine = F.col("at") == F.col("no")
        pair = rows.groupBy("no", "k").agg(F.max(F.when(mine, F.col("d"))).alias("v"), F.max(F.when(~mine, F.col("d"))).alias("w"))
        change = F.when(F.col("w").isNull(), "added").when(F.col("v").isNull(), "removed").when(F.col("v") != F.col("w"), "changed")
        return pair.select("no", "k", change.alias("change")).where("change IS NOT NULL")

    def rows_near(self, leaves: DataFrame) -> DataFrame:
        """The live rows in the folders of the leaves (at, leaf). Folders are named to the
        scan if they are at most MOST_BROADCAST; of more, all are read."""
        if not self.folders:
            return self.live
        at = F.col("at") * FANOUT**MOST_FOLDER_LEVELS + F.shiftright("leaf", 4 * (self.levels - self.folders))
        names = [r[0] for r in leaves.select(at.alias("x")).distinct().limit(MOST_BROADCAST + 1).collect()]
        if len(names) > MOST_BROADCAST:
            return self.live
        return self.live.where((F.col("no") * FANOUT**MOST_FOLDER_LEVELS + F.col("top")).isin(names))


def snapshot_changes(df: DataFrame, number: str, key: str, updated: str, deleted: str, value: str, levels: int | None = None, folders: int | None = None, store: str | None = None) -> DataFrame:
    """(number, key, change) for each snapshot but the first: `added`, live in it
    and not in the previous one; `removed`, the reverse; `changed`, live in both
    with another value.

    A record is live in a snapshot if it is there and its counting row, that with
    the greatest `updated` (of ties the greatest mark), isn't marked as deleted; a
    null mark means it isn't. A null value is as good as an empty one. The previous
    snapshot is that with the next smaller number. Rows with a null number or key
    don't count. Empty tables and single snapshots give no rows.

    Keys are put into hash ranges; each snapshot gets a tree of digests over
    them, trees of consecutive snapshots are compared from the root down, and
    rows are compared, by digests of their values, only in ranges that differ.
    Ranges hold about LEAF_BYTES each. For `store`, see Snapshots.
    """
    c = Snapshots(df, number, key, updated, deleted, value, levels, folders, store).changes()
    return c.select(F.col("no").cast(df.schema[number].dataType).alias(number), F.col("k").alias(key), "change")

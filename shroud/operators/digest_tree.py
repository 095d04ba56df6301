"""A digest of a table that does not depend on its order, files or size class, and differences found from the root down.

Every distinct (key, line) has an address, the SHA-256 of both, so addresses spread evenly whatever keys repeat.
The tree is the 16-way tree of address prefixes in which a prefix with at most ``leaf`` entries is one node:
its digest is that of its sorted entries; the digest of a larger prefix is that of its children's. So the tree
is a function of the rows alone: one more row changes the nodes above it and no others.

Two trees are compared level by level from the root. Only children of differing nodes are looked at, and of the
entries only those under differing lowest nodes are read, from the files of their first two digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 64
#: Digits of the folders of entries.
FOLDER = 2


def counted(c: Column) -> Column:
    """``-`` for null, else bytes in UTF-8, ``:`` and the text, so parts cannot run into each other."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record(cells: Sequence[Column]) -> Column:
    """SHA-256 of several cells."""
    return F.sha2(F.concat(*[counted(c) for c in cells]), 256)


def entries(df: DataFrame, key: Column, line: Column) -> DataFrame:
    """(address, key, n): the distinct (key, line) of a table and how often each comes; texts are not moved."""
    rows = df.select(key.cast("string").alias("key"), F.sha2(line.cast("string"), 256).alias("line"))
    address = record([F.col("key"), F.col("line")])
    return rows.groupBy("key", "line").agg(F.count(F.lit(1)).alias("n")).select(address.alias("address"), "key", "n")


def _lowest(rows: DataFrame, depth: int) -> DataFrame:
    text = F.concat("address", F.lit(":"), F.col("n").cast("string"))
    groups = rows.groupBy(F.substring("address", 1, depth).alias("prefix"))
    return groups.agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(text)), ",").alias("text"))


def _digested(nodes: DataFrame, leaf: int) -> DataFrame:
    """``text`` holds sorted entries up to ``leaf`` of them, else the children's digits and digests."""
    small = F.col("entries") <= leaf
    return nodes.withColumn("digest", F.sha2(F.concat(F.when(small, "entries ").otherwise("nodes "), F.col("text")), 256))


def tree(rows: DataFrame, leaf: int = LEAF, about: int | None = None) -> list[DataFrame]:
    """(prefix, entries, n, text, digest) of all prefixes by depth, root first, from ``entries``.

    The lowest depth is so deep that its groups are small, a quarter of ``leaf`` on average, whatever the table; it
    shapes no digest. ``about`` is how many entries there are at most, else they are counted. Levels shrink by
    sixteen, and a level's text is bounded by ``leaf`` entries or sixteen digests.
    """
    total, depth = rows.count() if about is None else about, 0
    while total > leaf / 4 * 16**depth:
        depth += 1
    levels = [_digested(_lowest(rows, depth), leaf)]
    while depth:
        depth -= 1
        child = F.struct(F.substring("prefix", depth + 1, 1).alias("digit"), "entries", "text", "digest")
        groups = levels[0].groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(F.sum("entries").alias("entries"), F.sum("n").alias("n"), F.array_sort(F.collect_list(child)).alias("children"))
        part = lambda c: F.when(F.col("entries") <= leaf, c["text"]).otherwise(F.concat(c["digit"], c["digest"]))
        nodes = groups.select("prefix", "entries", "n", F.array_join(F.transform("children", part), ",").alias("text"))
        levels.insert(0, _digested(nodes, leaf))
    return levels


def nodes(levels: Sequence[DataFrame], leaf: int = LEAF) -> DataFrame:
    """(prefix, n, digest, inner) of the tree's own nodes: the root, and children of prefixes with more than ``leaf`` entries."""
    out = None
    for depth, level in enumerate(levels):
        here = level.select("prefix", "n", "digest", (F.col("entries") > leaf).alias("inner"))
        if depth:
            above = levels[depth - 1].where(F.col("entries") > leaf).select(F.col("prefix").alias("_above"))
            here = here.join(above, F.substring("prefix", 1, depth - 1) == F.col("_above"), "left_semi")
        out = here if out is None else out.unionByName(here)
    return out


@dataclass(frozen=True)
class StoredTree:
    """A tree on disk: ``nodes`` by depth, ``entries`` by the first digits of the address."""

    path: str

    def nodes(self, spark: SparkSession, depth: int) -> DataFrame:
        return spark.read.schema("prefix string, n long, digest string, inner boolean, depth int").parquet(f"{self.path}/nodes").where(F.col("depth") == depth)

    def root(self, spark: SparkSession) -> str | None:
        row = self.nodes(spark, 0).first()
        return row["digest"] if row else None

    def entries(self, spark: SparkSession, folders: Sequence[str] | None = None) -> DataFrame:
        rows = spark.read.schema("address string, key string, n long, folder string").parquet(f"{self.path}/entries")
        return rows if folders is None else rows.where(F.col("folder").isin(*folders))


def store(df: DataFrame, key: Column, line: Column, path: str, leaf: int = LEAF) -> StoredTree:
    """Write the tree of ``df``; its entries first, which the levels are then made from."""
    spark = df.sparkSession
    rows = entries(df, key, line).withColumn("folder", F.substring("address", 1, FOLDER))
    rows.repartition("folder").sortWithinPartitions("address").write.partitionBy("folder").parquet(f"{path}/entries")
    kept = StoredTree(path)
    all_nodes = nodes(tree(kept.entries(spark).select("address", "key", "n"), leaf), leaf)
    all_nodes.withColumn("depth", F.length("prefix")).repartition("depth").write.partitionBy("depth").parquet(f"{path}/nodes")
    return kept


def differing(spark: SparkSession, old: StoredTree, new: StoredTree, depth_limit: int = 64) -> tuple[list[DataFrame], int]:
    """Prefixes of the lowest differing nodes, a table a depth, and how many nodes were compared.

    A node that is inner on one side only is a lowest one; so is one that only one side has.
    """
    found, compared = [], 0
    open_ = spark.createDataFrame([("",)], "_open string")
    for depth in range(depth_limit):
        a, b = (tree_.nodes(spark, depth).join(open_, F.substring("prefix", 1, max(0, depth - 1)) == F.col("_open"), "left_semi") for tree_ in (old, new))
        a, b = (x.select("prefix", F.col("digest").alias(f"{s}_digest"), F.col("inner").alias(f"{s}_inner")) for x, s in ((a, "old"), (b, "new")))
        both = a.join(b, "prefix", "full_outer").cache()
        compared += both.count()
        changed = both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
        inner = F.coalesce(F.col("old_inner") & F.col("new_inner"), F.lit(False))
        found.append(changed.where(~inner).select("prefix"))
        open_ = changed.where(inner).select(F.col("prefix").alias("_open"))
        if open_.isEmpty():
            break
    return found, compared


def difference(spark: SparkSession, old: StoredTree, new: StoredTree) -> DataFrame:
    """(key, change): added, removed or changed keys between two stored trees; equal subtrees are not read."""
    found, _ = differing(spark, old, new)
    parts, folders = [], set()
    for depth, prefixes in enumerate(found):
        for r in prefixes.select(F.substring("prefix", 1, FOLDER).alias("f")).distinct().collect():  # at most 256
            folders |= {r["f"]} if len(r["f"]) == FOLDER else {f"{r['f']}{x:0{FOLDER - len(r['f'])}x}" for x in range(16 ** (FOLDER - len(r["f"])))}
        parts.append((depth, prefixes))
    if not folders:
        return spark.createDataFrame([], "key string, change string")

    def changed(tree_: StoredTree) -> DataFrame:
        rows, out = tree_.entries(spark, sorted(folders)), None
        for depth, prefixes in parts:
            here = rows.join(prefixes, F.substring("address", 1, depth) == F.col("prefix"), "left_semi")
            out = here if out is None else out.unionByName(here)
        return out

    a, b = changed(old), changed(new)
    a, b = (x.select("address", "key", F.col("n").alias(s)) for x, s in ((a, "was"), (b, "is")))
    both = a.join(b.withColumnRenamed("key", "_key"), "address", "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))
    sides = both.select(F.coalesce("key", "_key").alias("key"), F.col("was").isNotNull().alias("was"), F.col("is").isNotNull().alias("is"))
    kept = sides.groupBy("key").agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is"))
    return kept.select("key", F.when(F.col("was") & F.col("is"), "changed").when(F.col("is"), "added").otherwise("removed").alias("change"))

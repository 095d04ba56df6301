"""Merkle manifest of a table: a tree of digests a group, one root over the groups, a proof for every row.

A row's leaf is the SHA-256 of its cells, each ``-`` where null, else its bytes counted in UTF-8, ``:`` and
its text. In every group leaves ascend by key; while more than one node is left, every 16 consecutive nodes
become the SHA-256 of their digests (the last run may be shorter, even one). What is left is the group's
subroot; the subroots, by group (null first, bytewise), become the root in the same way.

Texts are read once, for the leaves; all else moves narrow rows. A range sort deals a group's leaves over
many tasks, counts of its runs give each leaf its exact place, and blocks of 4096 consecutive leaves of one
group are the unit of work: a task hands its blocks, as Arrow tables of a few blocks at a time, to DuckDB,
which runs the three lower levels as ordered ``string_agg`` and ``sha256``. Spark combines block roots level
by level, walks down again with the siblings met on the way, and sends each block its outer siblings as a
row ahead of its leaves, so DuckDB folds every leaf to the root in a second pass.

Nulls: a null key comes first in its group, a null group is a group of its own. Ties: rows of equal keys are
ordered by leaf; equal rows have equal leaves and may change places, but not digests. Empty and very long
texts are cells like others. An empty table has no rows, root or proofs. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table

FANOUT = 16
#: Levels inside a block: a full one has 4096 leaves.
INNER = 3
HEX = 64
#: Leaves that a task gathers before its whole blocks go to the engine.
HELD = 16384


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (tree, block, i, size, key, leaf, claim); ``heads``: (tree, block, path, subroot); ``root``: null without rows; ``inner``: levels of a block."""

    leaves: DataFrame
    heads: DataFrame
    root: str | None
    inner: int = INNER


def cell(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(cells: Sequence[Column]) -> Column:
    """SHA-256, lowercase hex, of the cells of a row."""
    return F.sha2(F.concat(*[cell(c) for c in cells]), 256)


def tree_name(group: Column) -> Column:
    """A text that is never null and sorts as the group does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def places(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, from 0, and ``size``, the rows of the tree.

    Rows are sorted by ranges, so a large tree is spread over tasks; a task's first place in a tree is the
    sum of the counts of the tasks before.
    """
    keys = [F.col("tree"), *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = write_table(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("num", F.monotonically_increasing_id()), "places")
    runs = numbered.groupBy("tree", F.shiftright("num", 33).alias("task")).agg(F.min("num").alias("least"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "task", (before - F.col("least")).alias("shift"), F.sum("n").over(tree).alias("size"))
    placed = numbered.withColumn("task", F.shiftright("num", 33)).join(runs, ["tree", "task"])
    return placed.withColumn("pos", F.col("num") + F.col("shift")).drop("num", "task", "shift")


def _blocks(batches: Iterator[pa.RecordBatch], start) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole blocks, with each row's block from 0 and the rows where blocks start."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(start(table))
        end = table.num_rows if last else int(starts[-1])
        of = np.zeros(table.num_rows, np.int32)
        of[starts] = 1
        held[:] = table.slice(end).to_batches()
        return table.slice(0, end), np.cumsum(of)[:end] - 1, starts[starts < end]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            table, of, starts = cut(False)
            n -= table.num_rows
            if table.num_rows:
                yield table, of, starts
    if held:
        yield cut(True)


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _runs(level: int) -> str:
    """The runs of a level, from the nodes of the one below; levels above a tree's only node have none."""
    return f"""runs{level} AS MATERIALIZED (
      SELECT b, i // {FANOUT} AS i, any_value(size) AS size, string_agg(h, '' ORDER BY i) AS kids FROM level{level - 1}
      WHERE size > {FANOUT ** (level - 1)} GROUP BY b, i // {FANOUT}),
    level{level} AS MATERIALIZED (SELECT b, i, size, sha256(kids) AS h FROM runs{level})"""


def _levels(inner: int) -> str:
    return f"WITH level0 AS (SELECT b, i, size, h FROM leaves), {', '.join(_runs(k + 1) for k in range(inner))}"


def _roots(inner: int) -> str:
    """A block's root is its highest node: the only one of a tree of one block, else the one that joins the outer levels."""
    nodes = " UNION ALL ".join(f"SELECT b, h, {k} AS up FROM level{k} WHERE i = 0" for k in range(inner + 1))
    return f"{_levels(inner)} SELECT b, arg_max(h, up) AS h FROM ({nodes}) GROUP BY b ORDER BY b"


def _proofs(inner: int, outer: int) -> str:
    """Every leaf folded with its siblings: inside its block by levels, then along the block's path."""
    rows = "SELECT n, b, i, c AS h, '' AS proof FROM leaves"
    for k in range(1, inner + 1):
        slot = f"{HEX} * (x.i // {FANOUT ** (k - 1)} % {FANOUT})"
        before, after = f"coalesce(left(r.kids, {slot}), '')", f"coalesce(substr(r.kids, {slot} + {HEX + 1}), '')"
        rows = f"SELECT x.n, x.b, x.i, CASE WHEN r.kids IS NULL THEN x.h ELSE sha256({before} || x.h || {after}) END AS h, x.proof || {before} || {after} AS proof FROM ({rows}) x LEFT JOIN runs{k} r ON r.b = x.b AND r.i = x.i // {FANOUT**k}"
    rows = f"SELECT x.n, x.h, x.proof, p.path FROM ({rows}) x JOIN heads p ON p.b = x.b"
    for k in range(1, outer + 1):
        rows = f"SELECT n, path, CASE WHEN len(path) >= {k} THEN sha256(path[{k}].before || h || path[{k}].after) ELSE h END AS h, CASE WHEN len(path) >= {k} THEN proof || path[{k}].before || path[{k}].after ELSE proof END AS proof FROM ({rows})"
    return f"{_levels(inner)} SELECT h, sha256(proof) AS proof FROM ({rows}) ORDER BY n"


def block_roots(placed: DataFrame, inner: int = INNER) -> DataFrame:
    """(tree, pos, n, hash): the root of each block of leaves and the blocks of its tree."""
    query, full = _roots(inner), FANOUT**inner

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for table, of, starts in _blocks(batches, lambda t: t["i"].to_numpy() == 0):
            con.register("leaves", pa.table({"b": of, "i": table["i"], "size": table["size"], "h": table["leaf"]}))
            found = con.sql(query).to_arrow_table()
            con.unregister("leaves")
            at = table.take(starts)
            n = (at["size"].to_numpy() + full - 1) // full
            yield pa.RecordBatch.from_arrays([at["tree"].combine_chunks(), at["block"].combine_chunks(), pa.array(n), found["h"].combine_chunks().cast(pa.string())], ["tree", "pos", "n", "hash"])

    dealt = placed.select("tree", "block", "i", "size", "leaf").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return dealt.mapInArrow(roots, "tree string, pos long, n long, hash string")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels from ``nodes`` (tree, pos, n, hash) up, each written; runs keep ``kids``, the digests they join."""
    out = [write_table(nodes.withColumn("kids", F.lit(None).cast("string")), "nodes")]
    left = out[0].agg(F.max("n").alias("n")).first()["n"] or 1
    while left > 1:
        runs = out[-1].where("n > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.ceil(F.max("n") / FANOUT).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("run"))
        kids = runs.select("tree", "pos", "n", F.array_join(F.transform("run", lambda s: s["hash"]), "").alias("kids"))
        out.append(write_table(kids.select("tree", "pos", "n", F.sha2("kids", 256).alias("hash"), "kids"), "nodes"))
        left = -(-left // FANOUT)
    return out


def tops(nodes: Sequence[DataFrame]) -> DataFrame:
    """(tree, hash) of the one node that each tree comes to."""
    found = [x.where("n = 1").select("tree", "hash") for x in nodes]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def paths(nodes: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, path) of the lowest level: siblings before and after, level by level, then the tree's own path ``above``.

    A run meets its path once and hands it to its nodes, so no key is joined with more than 16 rows.
    """
    open_ = None
    for k in range(len(nodes) - 1, -1, -1):
        here = nodes[k].where("n = 1").select("tree", "pos").join(above, "tree")
        here = here if open_ is None else here.unionByName(open_)
        if k == 0:
            return here
        runs = here.join(nodes[k].select("tree", "pos", "kids"), ["tree", "pos"])
        slot = F.explode(F.sequence(F.lit(0), (F.length("kids") / HEX).cast("int") - 1)).alias("slot")
        runs = runs.select("tree", "pos", "path", "kids", slot)
        sides = F.struct(F.expr(f"left(kids, {HEX} * slot)").alias("before"), F.expr(f"substring(kids, {HEX} * slot + {HEX + 1})").alias("after"))
        open_ = runs.select("tree", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), F.concat(F.array(sides), F.col("path")).alias("path"))
    return open_


PATH = "array<struct<before: string, after: string>>"


def build(rows: DataFrame, group: Column, key: Column, cells: Sequence[Column], claim: Column | None = None, inner: int = INNER) -> Manifest:
    """The manifest of ``rows``. ``claim`` is a leaf that someone claims for a row (null: its own), folded by ``prove``."""
    claim = F.lit(None).cast("string") if claim is None else claim
    narrow = rows.select(tree_name(group).alias("tree"), key.alias("key"), leaf(cells).alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("row"))
    narrow = write_table(narrow, "leaves")
    placed = places(narrow, [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]).drop("row")
    placed = placed.withColumn("block", F.floor(F.col("pos") / FANOUT**inner)).withColumn("i", F.col("pos") % FANOUT**inner).drop("pos")
    trees = levels(block_roots(placed, inner))
    subroots = tops(trees)
    forest = places(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), [F.col("name")])
    crown = levels(forest.select("tree", "pos", F.col("size").alias("n"), "hash"))
    top = tops(crown).first()
    ends = paths(crown, crown[0].sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}"))
    above = forest.select("pos", F.col("name").alias("tree"), F.col("hash").alias("subroot")).join(ends.select("pos", "path"), "pos").drop("pos")
    heads = paths(trees, above.select("tree", "path")).withColumnRenamed("pos", "block").join(above.select("tree", "subroot"), "tree")
    return Manifest(placed, heads, top["hash"] if top else None, inner)


def prove(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` is what the row's claim, or its own leaf, comes to with the siblings of the manifest.
    """
    kind = manifest.leaves.schema["key"].dataType.simpleString()
    root, inner = manifest.root, manifest.inner

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for table, of, starts in _blocks(batches, lambda t: t["i"].to_numpy() < 0):
            own = np.ones(table.num_rows, bool)
            own[starts] = False
            rows, of, heads = table.filter(pa.array(own)), of[own], table.take(starts)
            claim = pc.coalesce(rows["claim"], rows["leaf"])
            con.register("leaves", pa.table({"n": np.arange(rows.num_rows), "b": of, "i": rows["i"], "size": rows["size"], "h": rows["leaf"], "c": claim}))
            con.register("heads", pa.table({"b": np.arange(heads.num_rows, dtype=np.int32), "path": heads["path"]}))
            outer = max(pc.list_value_length(heads["path"]).to_pylist(), default=0)
            found = con.sql(_proofs(inner, outer)).to_arrow_table()
            con.unregister("leaves"), con.unregister("heads")
            n, folded = rows.num_rows, found["h"].combine_chunks().cast(pa.string())
            columns = [rows["key"].combine_chunks(), rows["leaf"].combine_chunks(), heads["subroot"].take(pa.array(of)).combine_chunks(), pa.array([root] * n, pa.string()), found["proof"].combine_chunks().cast(pa.string()), folded, pc.equal(folded, pa.scalar(root))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    heads = manifest.heads.withColumn("i", F.lit(-1).cast("long"))
    rows = manifest.leaves.unionByName(heads, allowMissingColumns=True)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return dealt.mapInArrow(fold, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

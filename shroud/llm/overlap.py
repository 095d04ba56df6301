"""Near-duplicates of a stated Jaccard similarity: SimHash proposes, exact word shingles decide.

Texts with the same set of shingles are one node. Nodes get a SimHash fingerprint over the same
shingles, and the Gray-order index of ``simhash`` links those within ``radius`` bits; a node is
compared with the representative that its links lead to, and pairs that the exact comparison
confirms make the first components. Fingerprints alone miss part of the
pairs at the limit, so an exact join follows for what they left apart: shingle hashes are dealt by
hash into parts, and a part keeps those that at least two nodes hold. A node with a partner at
``least`` shares at least that share of its shingles, so nodes with fewer shared ones are done. Of
the others, each in the global order from the rarest shingle on, the first ``n - ceil(least * n) + 1``
hold one in common with every partner: nodes meet by these, and each proposed pair is confirmed by
its exact intersection, so no pair is missed and none is linked wrongly.

Nodes are first compared with one representative of each shingle, so a large group of near copies
becomes one component from a few pairs a member. Pairs that are still in different components follow,
by a join on the shingle that takes only those whose sizes are near and whose shingles from this one on
are enough: at the first shingle that two partners share, all that they share is still to come. It also takes
only those whose parity sketches differ in few enough bits, a bound that drops no partners. Shingles
that more than ``HOT`` nodes meet by are salted. Components are joined on Spark.

Defined cases: texts shorter than a shingle are one shingle, null and wordless texts are one node.
A null id takes part but is not a component's smallest id unless no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.components import components
from shroud.llm.scratch import write_table
from shroud.llm.simhash import fingerprint, shingle_hashes
from shroud.llm.simhash import link as gray_links

#: Rounding of ``least * n``; limits are lowered by it, and the exact test decides.
SLACK = 1e-9
#: Nodes that meet by one shingle in one task; more are dealt to several.
HOT = 256
#: Words of 64 bits of a node's parity sketch.
SKETCH = 8
#: Characters of texts that a task holds shingles of at once, but for one longer text.
SLICE = 1 << 21


def slices(batches: Iterator[pd.DataFrame], text_col: str, chars: int = SLICE) -> Iterator[pd.DataFrame]:
    """The rows of each batch in runs of about ``chars`` characters."""
    for batch in batches:
        run = np.cumsum([len(t or "") for t in batch[text_col]], dtype=np.int64) // chars
        cut = np.flatnonzero(np.diff(run, prepend=-1))
        for a, z in zip(cut, np.r_[cut[1:], len(run)][: len(cut)], strict=True):
            yield batch.iloc[a:z]


def shingle_set(text: str | None, words: int, seed: int) -> tuple[int, np.ndarray]:
    """Node of a text, and its distinct shingle hashes."""
    hashes = np.unique(shingle_hashes(text, words, seed))
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed), hashes


def nodes(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(_id, node, fp) a row of ``docs``; ``_id`` is (none, id, digest of the text), which tells unlike texts of one
    id apart and sorts null ids last; ``fp`` is the fingerprint of the node's distinct shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, "_text"):
            made = [(node, fingerprint(h)) for node, h in (shingle_set(t, words, seed) for t in batch["_text"])]
            node, fp = np.array(made, np.uint64).reshape(-1, 2).view(np.int64).T
            yield pd.DataFrame({"_id": batch["_id"], "digest": batch["digest"], "node": node, "fp": fp})

    rows = docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("_text"))
    made = rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, digest long, node long, fp long")
    return made.select(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "digest").alias("_id"), "node", "fp")


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def proposed_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs that connect all nodes whose fingerprints lie within ``radius`` bits, by the Gray-order index."""
    prints = rows.select("node", "fp").distinct()
    codes = write_table(prints.groupBy("fp").agg(F.min("node").alias("rep")), "codes")
    same = prints.join(codes, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    side = lambda x: codes.select(F.col("fp").alias(f"fp_{x}"), F.col("rep").alias(x))
    near = gray_links(codes.select("fp"), radius).toDF("fp_a", "fp_b").join(side("a"), "fp_a").join(side("b"), "fp_b")
    return same.unionByName(near.select("a", "b")).distinct()


def shared_shingles(docs: DataFrame, text_col: str, words: int, seed: int, part_chars: int = 8 << 20) -> DataFrame:
    """(node, n, hash, df): each node's shingles that ``df`` > 1 nodes hold; ``n`` counts all of the node's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("_text"))
    chars = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // part_chars))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, "_text"):
            sets = dict(shingle_set(t, words, seed) for t in batch["_text"])
            node, n = np.array(list(sets), np.uint64), np.array([len(h) for h in sets.values()], np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *sets.values()])
            owner, part = np.repeat(np.arange(len(n), dtype=np.int32), n), (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            flat, owner, part = flat[order], owner[order], part[order]
            found = []
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(cut, np.r_[cut[1:], len(part)][: len(cut)], strict=True):
                who, at = np.unique(owner[a:z], return_inverse=True)
                found.append((int(part[a]), node[who].tobytes(), n[who].tobytes(), at.astype(np.int32).tobytes(), flat[a:z].tobytes()))
            yield pd.DataFrame(found, columns=["part", "node", "n", "owner", "hash"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        at = np.cumsum([0, *(len(h) // 8 for h in group["hash"])])
        node, n, hashes = (np.empty(at[-1], np.int64) for _ in range(3))
        for a, z, r in zip(at, at[1:], group.itertuples(), strict=False):
            owner = np.frombuffer(r.owner, np.int32)
            node[a:z] = np.frombuffer(r.node, np.int64)[owner]
            n[a:z] = np.frombuffer(r.n, np.int64)[owner]
            hashes[a:z] = np.frombuffer(r.hash, np.int64)
        order = np.lexsort((node, hashes))
        node, n, hashes = node[order], n[order], hashes[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (hashes[1:] != hashes[:-1])
        node, n, hashes = node[new], n[new], hashes[new]
        start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        df = np.diff(np.r_[start, len(hashes)])
        df = np.repeat(df, df)
        return pd.DataFrame({"node": node, "n": n, "hash": hashes, "df": df})[df > 1]

    dealt = rows.mapInPandas(deal, "part long, node binary, n binary, owner binary, hash binary")
    return dealt.groupBy("part").applyInPandas(count, "node long, n long, hash long, df long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose Jaccard similarity is at least ``least``."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")) >= least).select("a", "b")


def sketch(hashes: Column) -> list[Column]:
    """Words of a bitmap that holds, for each bit, whether an odd number of ``hashes`` fall on it.

    Two sets' sketches differ in at most as many bits as one set has and the other lacks.
    """

    def word(j: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
        mine = lambda h: F.pmod(F.shiftright(h, 6), F.lit(SKETCH)) == j
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.when(mine(h), bit(h)).otherwise(F.lit(0).cast("long"))))

    return [word(j).alias(f"w{j}") for j in range(SKETCH)]


def link(docs: DataFrame, text_col: str, words: int, least: float, seed: int, proposed: DataFrame, stars: int = 1) -> DataFrame:
    """(node, root) of every node that has a partner; pairs ``proposed`` are compared first."""
    need = F.ceil(F.col("n") * least - SLACK)
    held = shared_shingles(docs, text_col, words, seed).groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("h"))
    sets = write_table(held.where(F.size("h") >= need).select("node", "n", F.col("h.hash").alias("shared")), "shared")
    first = F.slice("shared", 1, (F.size("shared") - need + 1).cast("int"))
    words_ = [f"w{j}" for j in range(SKETCH)]
    tokens = write_table(sets.select("node", "n", F.size("shared").alias("s"), first.alias("first"), *sketch(F.col("shared"))).select("node", "n", "s", *words_, F.posexplode("first").alias("pos", "token")), "tokens")
    near = F.least("n", "m") >= F.greatest("n", "m") * least - SLACK
    edges = write_table(confirmed(proposed, sets, least), "pairs")
    for i in range(stars):
        heads = tokens.groupBy("token").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))).alias("head"))
        pairs = tokens.join(heads.select("token", F.col("head.node").alias("b"), F.col("head.n").alias("m")), "token").where((F.col("node") != F.col("b")) & near)
        found = confirmed(pairs.select(F.col("node").alias("a"), "b").distinct(), sets, least)
        edges = write_table(edges.unionByName(found).distinct(), "pairs")
    roots = components(edges)
    rooted = tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hot = tokens.groupBy("token").count().where(F.col("count") > HOT)
    salts = F.coalesce(F.ceil(F.col("count") / HOT), F.lit(1))
    dealt = write_table(rooted.join(hot, "token", "left").select("token", "node", "n", "root", "s", *words_, (F.col("s") - F.col("pos")).alias("rest"), salts.alias("salts")), "dealt")
    one = dealt.select("token", F.col("node").alias("a"), "n", "root", "rest", "s", *words_, F.pmod(F.xxhash64("node"), "salts").alias("salt"))
    other = dealt.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("rest").alias("left"), F.col("s").alias("z"), *[F.col(w).alias(f"v{w}") for w in words_], F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    common = F.ceil((F.col("n") + F.col("m")) * least / (1 + least) - SLACK)
    differ = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}"))) for w in words_)
    enough = (F.least("rest", "left") >= common) & (F.col("s") + F.col("z") - differ >= 2 * common)
    pairs = one.join(other, ["token", "salt"]).where((F.col("root") < F.col("other")) & near & enough).select("a", "b").distinct()
    return components(edges.unionByName(confirmed(pairs, sets, least)))


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, least: float, radius: int, seed: int) -> DataFrame:
    """(_id, least) a row of ``docs``; ``least`` is the smallest ``_id`` of its component."""
    rows = write_table(nodes(docs, id_col, text_col, words, seed), "nodes")
    smallest = rows.groupBy("node").agg(F.min("_id").alias("least"))
    roots = link(docs, text_col, words, least, seed, proposed_pairs(rows, radius))
    joined = write_table(smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    components_ = joined.groupBy("root").agg(F.min("least").alias("least"))
    of_node = joined.select("node", "root").join(components_, "root").select("node", "least")
    return rows.join(of_node, "node").select("_id", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, component_id) a row of ``docs``; ``component_id`` is the smallest id of its component."""
    return grouped(docs, id_col, text_col, words, least, radius, seed).select(F.col("_id.id").alias(id_col), F.col("least.id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id and, of one id, the smallest text digest; rows with a null id stay.

    The rows to keep are the build side of the join, so texts are shuffled once and not sorted; only where a
    row repeats are its copies sorted to take one.
    """
    groups = write_table(grouped(docs, id_col, text_col, words, least, radius, seed), "groups")
    keep = groups.where((F.col("_id") == F.col("least")) & F.col("_id.id").isNotNull()).groupBy(F.col("_id.id").alias("_kept"), F.col("_id.digest").alias("_of")).count()
    digest, side = text_digest(F.col(text_col)), keep.select("_kept", "_of").hint("shuffle_hash")
    kept = docs.join(side, (docs[id_col] == side["_kept"]) & (text_digest(docs[text_col]) == side["_of"]), "left_semi")
    if not keep.where("count > 1").isEmpty():
        mark = "_digest"
        while mark in docs.columns:
            mark += "_"
        kept = kept.withColumn(mark, digest).dropDuplicates([id_col, mark])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))

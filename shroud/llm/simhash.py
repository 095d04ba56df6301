"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt by ranges of Gray rank into cells and sorted in them. Neighbours in that order share long
masked bit patterns; within a cell, groups of eight consecutive fingerprints are factored into a
node with the bits on which all agree, nodes into upper nodes, and so on. A search adds up a
query's differences on the bits that each node adds and drops a whole group once the sum passes
the limit. The cells' own patterns are the top of the index: a fingerprint visits only the later
cells whose pattern it fits. Cells with many visitors are dealt to several tasks. A task sends on a
spanning forest of the links it found, so a large group of near copies leaves a few rows a
member, and components of these forests are joined on Spark.

Defined cases: null and wordless texts have fingerprint zero and link like any other. Repeated rows
and ids are each returned. A null id takes part but is not a component's smallest id unless no other is
there. An empty table gives an empty table.
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

FANOUT = 8
OPEN = 1 << 17
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; A-Z lower-cased, ASCII white space splits."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n, digest = min(words, len(w)), xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
    return np.fromiter((digest(x, seed) for x in runs), np.uint64, len(w) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; of none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) a row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t, words, seed)) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "fp": np.array(fp, np.uint64).view(np.int64)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, as a long whose signed order is that order."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Nodes over patterns that come in Gray order, each with the mask of bits that it fixes."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None):
        mask = np.full(len(pattern), ALL) if mask is None else mask
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: patterns, own masks
        while len(pattern) > FANOUT:
            pad = -len(pattern) % FANOUT
            p, m = (np.concatenate([x, np.repeat(x[-1:], pad)]).reshape(-1, FANOUT) for x in (pattern, mask))
            shared = np.bitwise_and.reduce(m, 1)
            shared &= ~(np.bitwise_and.reduce(p, 1) ^ np.bitwise_or.reduce(p, 1))
            self.levels.append((pattern, mask & ~np.repeat(shared, FANOUT)[: len(pattern)]))
            pattern, mask = p[:, 0], shared
        self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, leaf) positions whose accumulated differences stay within ``radius``.

        A level's nodes are opened ``OPEN`` at a time, so memory is bounded however many there are.
        """
        top = len(self.levels[-1][0])
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def descend(depth: int, q: np.ndarray, node: np.ndarray, diff: np.ndarray) -> None:
            pattern, mask = self.levels[depth]
            diff = diff + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = np.flatnonzero(diff <= radius)
            q, node, diff = q[keep], node[keep], diff[keep]
            if not depth:
                found.append((q, node))
                return
            below = len(self.levels[depth - 1][0])
            for i in range(0, len(q), OPEN):
                child = (node[i : i + OPEN, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = np.flatnonzero(child < below)
                descend(depth - 1, np.repeat(q[i : i + OPEN], FANOUT)[real], child[real], np.repeat(diff[i : i + OPEN], FANOUT)[real])

        descend(len(self.levels) - 1, np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries)), np.zeros(top * len(queries), np.uint8))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; every set's parent is its least member."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        parent[np.maximum(ra, rb)[differ]] = np.minimum(ra, rb)[differ]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(home: np.ndarray, visitors: np.ndarray, radius: int, block: int = 2048) -> pd.DataFrame:
    """Links of a spanning forest over all pairs of home with home or visitor within ``radius``."""
    index, codes = GrayIndex(home), np.concatenate([home, visitors])
    parent = np.arange(len(codes))
    for i in range(0, len(codes), block):
        q, leaf = index.search(codes[i : i + block], radius)
        merge(parent, q + i, leaf)
    linked = np.flatnonzero(parent != np.arange(len(codes)))
    return pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[parent[linked]].view(np.int64)})


def cell_bounds(codes: DataFrame, cells: int) -> np.ndarray:
    """Least Gray ranks of all cells but the first, so that cells hold about equally many codes."""
    if cells < 2:
        return np.empty(0, np.int64)
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    bounds = codes.agg(F.percentile_approx("rank", shares, max(10_000, 20 * cells)).alias("b")).first()["b"]
    return np.unique(np.array(bounds or [], np.int64))


def link(codes: DataFrame, radius: int = 2, cells: int = 64, cell_codes: int = 1 << 22, max_cells: int = 4096, task_visitors: int = 1 << 19) -> DataFrame:
    """(a, b): links that connect all distinct ``codes.fp`` within ``radius`` bits, chains included.

    There are ``cells`` cells, more once they would hold over ``cell_codes`` codes; how many cells
    a code visits depends on their number alone. Driver: bounds, patterns and visitor counts of at
    most ``max_cells`` cells.
    """
    cells = max(cells, min(max_cells, -(-codes.count() // cell_codes)))
    by_rank = codes.select("fp", gray_rank(F.col("fp")).alias("rank"))
    bounds = cell_bounds(by_rank, cells)

    def place_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=np.searchsorted(bounds, batch["rank"].to_numpy(np.int64), side="right"))

    ranked = write_table(by_rank.mapInPandas(place_codes, "fp long, rank long, cell long"), "gray")
    tops = ranked.groupBy("cell").agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")).orderBy("cell").toPandas()
    pattern = tops["every"].to_numpy(np.int64).view(np.uint64)
    mask = ~(pattern ^ tops["some"].to_numpy(np.int64).view(np.uint64))
    names = tops["cell"].to_numpy(np.int64)
    place = {int(c): i for i, c in enumerate(names)}

    def visits(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, home cells, and (code, cell) positions of the later cells to visit."""
        fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
        home = np.array([place[c] for c in batch["cell"]], np.int64)
        found = [GrayIndex(pattern, mask).search(fp[i : i + 4096], radius) for i in range(0, len(fp), 4096)]
        q = np.concatenate([x + 4096 * i for i, (x, _) in enumerate(found)]) if found else np.empty(0, np.int64)
        cell = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        later = cell > home[q]
        return fp, home, np.stack([q[later], cell[later]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            total += np.bincount(visits(batch)[2][1], minlength=len(names))
        yield pd.DataFrame({"cell": np.flatnonzero(total), "n": total[total > 0]})

    counts = {r["cell"]: r["n"] for r in ranked.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    salts = np.array([max(1, -(-counts.get(i, 0) // task_visitors)) for i in range(len(names))], np.int64)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, home, (q, cell) = visits(batch)
            copies = salts[home]
            own = np.repeat(np.arange(len(fp)), copies)
            salt = np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
            code = np.concatenate([fp[own], fp[q]])
            yield pd.DataFrame(
                {
                    "cell": np.concatenate([home[own], cell]),
                    "salt": np.concatenate([salt, (fp[q] % salts[cell].astype(np.uint64)).astype(np.int64)]),
                    "fp": code.view(np.int64),
                    "home": np.arange(len(code)) < len(own),
                }
            )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        at_home = group["home"].to_numpy(bool)
        home = fp[at_home]
        rank = home.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        return forest(home[np.argsort(rank)], fp[~at_home], radius)

    routed = ranked.mapInPandas(route, "cell long, salt long, fp long, home boolean")
    return routed.groupBy("cell", "salt").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) a row of ``docs``; ``component_id`` is the smallest id of its component."""
    prints = write_table(fingerprints(docs, id_col, text_col, words, seed), "prints")
    codes = write_table(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "codes")
    roots = components(link(codes, radius))
    joined = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(of_code, "fp").select(id_col, "fp", "component_id")


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the smallest id of each component, once; rows with a null id cannot be told apart and stay.

    The ids to keep are the build side of the join, so texts are shuffled once and not sorted; only
    where an id repeats are its rows sorted to take one.
    """
    keep = groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count()
    kept = docs.join(keep.select(id_col).hint("shuffle_hash"), id_col, "left_semi")
    if not keep.where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with the smallest id of each component, once; rows with a null id cannot be told apart and stay."""
    return keep_least(docs, write_table(near_duplicates(docs, id_col, text_col, words, radius, seed), "groups"), id_col)


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A first pass over the documents counts in how many each n-gram of the test items occurs; all that
occur are seeds. A second pass joins the passages around seeds to their items, and
each passage is aligned locally with its item: word matches gain, mismatches and gaps lose, and the
best score is divided by that of a verbatim copy. Passages that hold too few of the item's words to
reach the least score, however they are ordered, are left out before. A copy without one intact n-gram of
its item has no seed and is not found.

The items are worked through in blocks of at most ``block_chars`` characters, each held by every
task; a larger test set makes more passes and no larger broadcast.

Defined cases: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; items
without words match nothing, shorter items than the n-gram are one seed of their own length. Null
texts match nothing, null ids are allowed. Repeated rows give one result an id. Empty tables give
empty tables.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def grams(words: list[bytes], n: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[i:] for i in range(n)), strict=False)


class ItemBlock:
    """Distinct word sequences of a block's items and their n-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        texts: dict[tuple[bytes, ...], list] = defaultdict(list)
        for id_, text in items:
            if words := tuple(words_of(text)):
                texts[words].append(id_)
        self.n, self.words, self.ids = n, list(texts), list(texts.values())
        self.sizes = sorted({min(n, len(w)) for w in self.words})
        self.number: dict[tuple[bytes, ...], int] = {}
        for w in self.words:
            for g in grams(list(w), min(n, len(w))):
                self.number.setdefault(g, len(self.number))

    def seeds(self, count: np.ndarray) -> dict[tuple[bytes, ...], list[tuple[int, int]]]:
        """Seed -> (sequence, offset): every n-gram that occurs in a document."""
        out: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for j, g in enumerate(grams(list(w), min(self.n, len(w)))):
                if count[self.number[g]]:
                    out[g].append((i, j))
        return dict(out)


def hits(words: list[bytes], known: dict, sizes: list[int]) -> list[tuple[int, tuple[bytes, ...]]]:
    return [(i, g) for n in sizes for i, g in enumerate(grams(words, n)) if g in known]


def passages(found: list[tuple[int, int, int]], length: int, slack: float, n_words: int) -> list[tuple[int, int]]:
    """Windows of a document that may hold an item: its length around each seed, overlaps joined."""
    room = 2 + int(slack * length)
    out: list[list[int]] = []
    for pos, offset in sorted((p, o) for p, _, o in found):
        a, b = max(0, pos - offset - room), min(n_words, pos - offset + length + room)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def bound(tally: dict[bytes, int], window: list[bytes]) -> float:
    """No alignment of an item with ``window`` scores more: the share of the item's words, by ``tally``, that are in it."""
    return sum(tally[w] for w in tally.keys() & set(window)) / sum(tally.values())


def local_scores(item: np.ndarray, windows: list[np.ndarray], mismatch: float = 0.5, gap: float = 0.5) -> list[float]:
    """Best local alignment of ``item`` with each window; a match gains 1. All windows at once, an item word a step."""
    width = max(map(len, windows))
    x = np.full((len(windows), width), -1, np.int64)
    for i, w in enumerate(windows):
        x[i, : len(w)] = w
    slope = gap * np.arange(width)
    above, best = np.zeros((len(windows), width)), np.zeros(len(windows))
    for word in item:
        diagonal = np.concatenate([np.zeros((len(windows), 1)), above[:, :-1]], 1) + np.where(x == word, 1.0, -mismatch)
        row = np.maximum(np.maximum(diagonal, above - gap), 0)
        row = np.maximum.accumulate(row + slope, 1) - slope  # gaps along the window
        above = row
        best = np.maximum(best, row.max(1))
    return best.tolist()


def align(item: tuple[bytes, ...], windows: list[list[bytes]]) -> list[float]:
    """Alignment scores as shares of a verbatim copy's."""
    known = {w: i for i, w in enumerate(dict.fromkeys(item))}
    code = np.array([known[w] for w in item])
    return [s / len(item) for s in local_scores(code, [np.array([known.get(w, -1) for w in win], np.int64) for win in windows])]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 3,
    least: float = 0.4,
    slack: float = 0.25,
    block_chars: int = 8 << 20,
) -> DataFrame:
    """(doc id, item id, score) of every document that holds an item with a score of ``least`` or more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    doc_type, item_type = (x.schema[c].dataType.simpleString() for x, c in ((docs, id_col), (items, item_id)))
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    dealt = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"), F.pmod(F.xxhash64(item_text), F.lit(blocks)).alias("block"))
    out = None
    for b in range(blocks):
        block = ItemBlock([(r["id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()], n)
        shared = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            total = np.zeros(len(block.number), np.int64)
            for batch in batches:
                for text in batch["text"]:
                    for g in {g for _, g in hits(words_of(text), block.number, block.sizes)}:
                        total[block.number[g]] += 1
            some = np.flatnonzero(total)
            yield pd.DataFrame({"gram": some, "n": total[some]})

        counts = np.zeros(len(block.number), np.int64)
        for r in rows.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            counts[r["gram"]] = r["n"]
        seeds = spark.sparkContext.broadcast(block.seeds(counts))

        def find(batches: Iterator[pd.DataFrame], shared=shared, seeds=seeds) -> Iterator[pd.DataFrame]:
            block, known = shared.value, seeds.value
            tallies: dict[int, Counter] = {}
            for batch in batches:
                found = []
                for doc, text in zip(batch["doc"], batch["text"], strict=True):
                    words = words_of(text)
                    by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                    for pos, g in hits(words, known, block.sizes):
                        for item, offset in known[g]:
                            by_item[item].append((pos, item, offset))
                    for item, where in by_item.items():
                        if item not in tallies:
                            tallies[item] = Counter(block.words[item])
                        for a, z in passages(where, len(block.words[item]), slack, len(words)):
                            if bound(tallies[item], words[a:z]) >= least:
                                found.append((doc, item, b" ".join(words[a:z])))
                yield pd.DataFrame(found, columns=["doc", "item", "passage"])

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            for batch in batches:
                found = []
                for item, group in batch.groupby("item"):
                    windows = [p.split() for p in group["passage"]]
                    scores = [s for i in range(0, len(windows), 256) for s in align(block.words[item], windows[i : i + 256])]
                    found += [(doc, id_, s) for doc, s in zip(group["doc"], scores, strict=True) if s >= least for id_ in block.ids[item]]
                yield pd.DataFrame(found, columns=["doc", "item", "score"])

        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        candidates = rows.mapInPandas(find, f"doc {doc_type}, item long, passage binary").repartition(parts)
        scored = candidates.mapInPandas(score, f"doc {doc_type}, item {item_type}, score double")
        out = scored if out is None else out.unionByName(scored)
    best = out.groupBy("doc", "item").agg(F.max("score").alias("score"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "score")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item, told by the digests of their texts, so ids may be null or repeat."""
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    keyed = docs.withColumn(digest, F.sha2(F.col(text_col), 256))
    leaks = write_table(contaminated(keyed.select(digest, text_col), items, digest, text_col, **options).select(digest).distinct(), "leaks")
    return keyed.join(leaks.hint("shuffle_hash"), digest, "left_anti").select(docs.columns)

"""Packing along a space-filling curve.

Token ids are hashed into a signed document vector, projected to a few dimensions and quantised;
its Hilbert key orders the documents by ``repartitionByRange``. The concatenation in that order is
cut every ``seq_len`` tokens, so neighbours on the curve share sequences and only the last one has
room left; that rest is cut into powers of two, which need no padding.

Defined cases: null texts are empty, an empty document is its end token. Documents with the same
vector follow by id. Repeated rows are each packed. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shroud.llm.scratch import write_table

CACHE_WORDS = 1 << 19
#: The byte-level pattern that both libraries cut texts with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordTokens(dict):
    """Word -> ids, as little-endian unsigned 32-bit bytes, of the word with a space before it.

    The byte-level pattern never joins a single space to what stands before it, so a text's ids are
    those of its parts, each from one such space up to the next. Words repeat; the ids of up to
    ``CACHE_WORDS`` are kept. A word that is empty or has white space at an end is kept as None,
    which sends its text the slower way. With ``ranks`` the same vocabulary's merges are done by
    ``tiktoken`` for words of Latin letters, whose classes in the pattern all libraries agree on.
    A text that holds one of the file's added tokens is left to the tokenizer as a whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merges = None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.merges = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def direct(self, text: str) -> bytes:
        if self.merges and (text.isascii() or max(text) < "\u0250"):
            ids = self.merges.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes | None:
        ids = None if not word or word[0].isspace() or word[-1].isspace() else self.direct(" " + word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        if not rest:
            return self.direct(first) if first else b""
        last = rest.pop()
        if first and last and not first[-1].isspace() and not last[0].isspace():
            try:
                return b"".join([self.direct(first), *map(self.__getitem__, rest), self.direct(" " + last) if last[-1].isspace() else self[last]])
            except TypeError:  # a None: white space stands next to a space
                pass
        cuts = [0, *[m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)], len(text)]
        return b"".join(self.direct(text[a:z]) for a, z in zip(cuts, cuts[1:], strict=False))


@functools.lru_cache(maxsize=2)
def word_tokens(path: str, ranks: str | None = None) -> WordTokens:
    """One for each Python worker."""
    return WordTokens(path, ranks)


def document_vectors(ids: list[bytes], projection: np.ndarray) -> np.ndarray:
    """Signed hashed counts of each document's ids, damped and scaled to length one, projected.

    ``projection`` has a power of two of rows; the highest bits of a token's hash are its slot and sign.
    """
    width, tokens = len(projection), np.frombuffer(b"".join(ids), "<u4")
    known = np.arange(int(tokens.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = (known >> np.uint64(64 - (2 * width).bit_length() + 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)) * 2 * width, [len(x) // 4 for x in ids])
    counts = np.bincount(doc + slot[tokens], minlength=len(ids) * 2 * width).reshape(len(ids), width, 2)
    v = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ projection


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of non-negative integers below 2**bits: Gray decoding with axis exchanges."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, 0) ^ swap
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, ranks: str | None, end_id: int, id_col: str, text_col: str, dims: int, bits: int, width: int, seed: int) -> DataFrame:
    """(id, curve, n_tokens, ids) a row of ``docs``; ``ids`` are little-endian unsigned 32-bit."""
    rng = np.random.default_rng(seed)
    projection = rng.standard_normal((width, dims))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokens(tokenizer, ranks)
        for batch in batches:
            for i in range(0, max(len(batch), 1), 512):  # bounds what a batch of long texts holds at once
                part = batch.iloc[i : i + 512]
                ids = [words.encode(t or "") + end for t in part["_text"]]
                cells = np.clip((document_vectors(ids, projection) + 2) / 4 * (1 << bits), 0, (1 << bits) - 1)
                yield pd.DataFrame({"_id": part["_id"], "curve": hilbert_key(cells, bits), "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, curve long, n_tokens long, ids binary")


def rest_cuts(rest: int) -> list[int]:
    """The last, short sequence as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    seq_len: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: int = 4,
    bits: int = 8,
    width: int = 256,
    seed: int = 0,
    with_ids: bool = False,
    ranks: str | None = None,
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Token ids are computed once, into the shared folder. The order is found on narrow rows; each
    document's place in the whole is its place in its range plus the ranges before it, of which
    there are as many as shuffle partitions. Ids then meet their places by row number.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, ranks, end_id, id_col, text_col, dims, bits, width, seed)
    tokens = write_table(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = tokens.select("_id", "curve", "row", "n_tokens").repartitionByRange(parts, "curve", "_id", "row").sortWithinPartitions("curve", "_id", "row")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for b in batches:
            ends = at + b["n_tokens"].cumsum()
            yield pd.DataFrame({"row": b["row"], "part": b["part"], "local": ends - b["n_tokens"], "n": b["n_tokens"]})
            at = int(ends.iloc[-1]) if len(ends) else at

    placed = write_table(narrow.select("row", "n_tokens", F.spark_partition_id().alias("part")).mapInPandas(places, "row long, part int, local long, n long"), "places")
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    total = sums.agg(F.sum("n")).first()[0] or 0
    whole, rest = total - total % seq_len, rest_cuts(total % seq_len)
    rest_starts = whole + np.concatenate([[0], np.cumsum(rest)]).astype(np.int64)
    at = placed.join(F.broadcast(before), "part").select("row", (F.col("local") + F.col("before")).alias("at"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, ids, begin in zip(batch["_id"], batch["ids"], batch["at"], strict=True):
                n, done = len(ids) // 4, 0
                while done < n:
                    pos = begin + done
                    if pos < whole:
                        seq, seq_start = pos // seq_len, pos - pos % seq_len
                        seq_end = seq_start + seq_len
                    else:
                        k = int(np.searchsorted(rest_starts, pos, side="right")) - 1
                        seq, seq_start, seq_end = whole // seq_len + k, rest_starts[k], rest_starts[k + 1]
                    size = min(n - done, seq_end - pos)
                    piece = ids[4 * done : 4 * (done + size)]
                    out.append((id_, done, size, zlib.crc32(piece), n, seq, pos - seq_start, piece if with_ids else None))
                    done += size
            yield pd.DataFrame(out, columns=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = tokens.select("_id", "row", "ids").join(at.hint("shuffle_hash"), "row").select("_id", "ids", "at")
    kind = tokens.schema["_id"].dataType.simpleString()
    out = joined.mapInPandas(pieces, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    out = out.withColumnRenamed("_id", id_col)
    return out if with_ids else out.drop("ids")

"""Katz backoff scores of documents under an n-gram model of the training documents.

Counts up to five are discounted by Good-Turing, larger ones lose half a count, so every history
keeps something for words that it was not seen with. The backoff weight of a history is that rest,
divided by the probability that the shorter history gives to those words. A token's probability is
evaluated recursively: the discounted n-gram, else the weight times the token's probability one
order below, down to single words and one class for unknown words.

On Spark: whole documents are gathered into chunks of about ``chunk_tokens`` tokens, and for every
order a chunk sends each of its distinct n-grams once, with its count, to the bucket of its history.

1. ``words``: the chunks' words meet by hash; each word gets its count and a number.
2. ``grams`` of order 2, 3, ...: n-grams meet by history. A bucket knows all followers of its
   histories, stores their counts, and answers each chunk with the counts of what it sent. A history
   that occurs over ``bucket_tokens`` / 4 times is dealt out by the following word; the sums for its
   weight are then added up by a group-by and joined back.
3. Each chunk adds up its documents' scores from the answers.

How tokens are dealt changes no result. The model is stored in the shared folder by order and
bucket: ``words`` (bucket; words, counts), ``grams`` (order, bucket; histories, words, counts) and
``weights`` (order, bucket; histories, weights); ``KatzModel`` reads them as plain rows, and
``score_with`` scores other documents with them. Numbers travel as packed arrays. The driver gets
counts of counts.

Defined cases: null texts are empty, and an empty text is its end token. A history that training
lacks backs off with weight one. Without training rows every score is that of unknown words.
Repeated rows are each scored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.scratch import drop, new_path, save

K = 5
LARGE = 0.5  # what counts over K lose
END = b" end"  # no word holds a space
MIX = np.uint64(0x9E3779B97F4A7C15)
STORED = -1  # the chunk number of a stored model's rows


PRESS, UNPRESS = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def packed(a: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Runs of non-negative integers, each run with the least significant bytes of all first, compressed."""
    a = np.ascontiguousarray(a, "<u8")
    wide = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes, flat = np.empty((wide, len(a)), np.uint8), a.view(np.uint8)
    for i in range(wide):
        planes[i] = flat[i::8]
    head = bytes([wide])
    return [head + PRESS.compress(np.ascontiguousarray(planes[:, a:z])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def pack(a: np.ndarray) -> bytes:
    return packed(a, np.array([0, len(a)]))[0]


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(UNPRESS.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = raw[0].astype(np.int64)
    for i in range(1, b[0]):
        out |= raw[i].astype(np.int64) << 8 * i
    return out


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a + np.uint64(1)) * MIX
    return (a ^ (a >> np.uint64(29))) * MIX >> np.uint64(11)


def katz_discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount of counts 1 to K from ``n``, the numbers of items of count 0 to K + 1.

    Where the counts of counts allow none between zero and one, half a count is taken off instead.
    """
    out = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (ratio - common) / (1 - common) if common != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def taken_off(n: np.ndarray) -> np.ndarray:
    """What each count from 0 to K, and any larger one, loses."""
    return np.append(np.arange(K + 1) * (1 - katz_discounts(n)), LARGE)


def kept(off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return count - off[np.minimum(count, K + 1)]


def ordered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, new): places of rows of non-negative integers, sorted, equal rows by place, and whether each starts new values.

    Columns that fit into one number together with the place are sorted as such numbers, which takes a
    tenth of the time of an argsort; wider rows take several sorts, from the last column on.
    """
    size = len(columns[0])
    bits, rest, places, key = size.bit_length(), list(columns), None, np.zeros(size, np.int64)
    while rest:
        key = rest.pop()
        wide = int(key.max(initial=0)).bit_length()
        while rest and wide + (more := int(rest[-1].max(initial=0)).bit_length()) + bits <= 63:
            key, wide = key | rest.pop() << wide, wide + more
        key = key if places is None else key[places]
        if wide + bits <= 63:
            key = key << bits | np.arange(size)
            key.sort()
            step = key & (1 << bits) - 1
            key >>= bits
        else:
            step = np.argsort(key, kind="stable")
            key = key[step]
        once, places = places is None, step if places is None else places[step]
    new = np.ones(size, bool)
    new[1:] = key[1:] != key[:-1]
    if not once:
        for column in columns:
            column = column[places]
            new[1:] |= column[1:] != column[:-1]
    return places, new


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): a place of every distinct row, in order, and each row's number among them."""
    places, new = ordered(*columns)
    number = np.empty(len(places), np.int64)
    number[places] = np.cumsum(new) - 1
    return places[new], number


def _ends(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a.astype(np.int64))


# ---- chunks of documents

CHUNK = "chunk long, ids array<{id}>, train binary, lengths binary, tokens binary, {words}, n_tokens long"
SPELLED = "words binary, hashes binary, counts binary"
NUMBERED = "numbers binary, counts array<binary>, weights array<binary>"


def _words(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, lengths, first): the words between white space, no word going over a start, and the first word from each start on."""
    data = np.frombuffer(raw, np.uint8)
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = starts[starts < len(data)]
    opens[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    closes[cut] = inside[cut]
    at = np.flatnonzero(opens)
    return data[inside], np.flatnonzero(closes) + 1 - at, np.searchsorted(at, starts)


def _numbers(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number among the distinct words, and these."""
    ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def chunked(docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    """Rows of whole documents with about ``chunk_tokens`` tokens: ids, lengths, tokens as places in the chunk's words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type = rows.schema["id"].dataType.simpleString()

    def row(chunk: int, parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        train, lengths, letters, wide = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        number, names = _numbers(letters, wide)
        words = np.append(names.to_numpy(zero_copy_only=False), END)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.tolist()), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens, end = np.empty(int(lengths.sum()), np.int64), np.zeros(int(lengths.sum()), bool)
        end[_ends(lengths) - 1] = True
        tokens[end], tokens[~end] = place[-1], place[number]
        count = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(order))
        binary = [pack(train), pack(lengths), pack(tokens), zstandard.compress(b"\n".join(words[order].tolist()), 1), hashes[order].tobytes(), pack(count)]
        columns = [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([b], pa.binary()) for b in binary], pa.array([len(tokens)])]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "train", "lengths", "tokens", "words", "hashes", "counts", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            ids, train = batch.column("id"), batch.column("train").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
            starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2][starts[0] : starts[-1]].to_pybytes().lower() if starts[-1] > starts[0] else b""
            letters, wide, first = _words(raw, starts - starts[0])
            lengths, at_letter = np.diff(first) + 1, np.append(0, _ends(wide))
            upto, a = np.append(0, _ends(lengths)), 0
            while a < len(ids):
                z = min(len(ids), int(np.searchsorted(upto, upto[a] + chunk_tokens - held)))
                z = max(z, a + 1)
                x, y = first[a], first[z]
                parts.append((ids.slice(a, z - a), train[a:z], lengths[a:z], letters[at_letter[x] : at_letter[y]], wide[x:y]))
                held, a = held + int(upto[z] - upto[a]), z
                if held >= chunk_tokens:
                    yield row(base + made, parts)
                    made, held, parts = made + 1, 0, []
        if parts:
            yield row(base + made, parts)

    return rows.mapInArrow(run, CHUNK.format(id=id_type, words=SPELLED))


class Order:
    """A chunk's distinct n-grams of one order.

    ``at``: each token's n-gram; ``first``: a token of each; ``history``, ``word``: its parts, the
    history as an n-gram of the order below, of which the last number is the start of a document.
    Counts arrive later.
    """

    def __init__(self, chunk: Chunk, below: Order | None):
        self.below = below
        if below is None:
            self.at, self.size = chunk.tokens, len(chunk.numbers)
            self.n = np.full(self.size, chunk.total)
            self.count = chunk.counts[0]
            return
        history = np.roll(below.at, 1)
        history[chunk.first] = below.size
        self.first, self.at = distinct(history, chunk.tokens)
        self.size = len(self.first)
        self.history, self.word = history[self.first], chunk.tokens[self.first]
        self.history_n = np.append(below.count, chunk.documents)
        self.n = self.history_n[self.history]
        order = below.order
        self.count = chunk.counts[order] if order < len(chunk.counts) else None

    @property
    def order(self) -> int:
        return 1 if self.below is None else self.below.order + 1

    def words(self, chunk: Chunk) -> list[np.ndarray]:
        """The words' numbers of each n-gram, and of the start."""
        if self.below is None:
            return [np.append(chunk.numbers, 0)]
        return [np.append(w[self.history], 0) for w in self.below.words(chunk)] + [np.append(chunk.numbers[self.word], 0)]

    def dealt(self, chunk: Chunk, columns: list[np.ndarray], buckets: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams with a history that training has, and their buckets; in order of bucket and the history's
        last word, by which what travels with a history compresses best."""
        at = np.zeros(len(self.history_n), np.uint64)
        for column in columns:
            at = mixed(at ^ column.astype(np.uint64))
        bucket = (at % np.uint64(buckets)).astype(np.int64)[self.history]
        spread = np.flatnonzero(self.n >= limit)
        salts = (1 + self.n[spread] // limit).astype(np.uint64)
        at = mixed(at[self.history[spread]] + mixed(chunk.numbers[self.word[spread]].astype(np.uint64)) % salts)
        bucket[spread] = (at % np.uint64(buckets)).astype(np.int64)
        asked = np.flatnonzero(self.n > 0)
        asked = asked[ordered(bucket[asked], columns[-1][self.history[asked]])[0]]
        return asked, bucket[asked]


class Chunk:
    def __init__(self, row, total: int, documents: int):
        self.total, self.documents = total, documents
        self.tokens, self.lengths, self.numbers = unpack(row.tokens), unpack(row.lengths), unpack(row.numbers)
        self.train = unpack(row.train).astype(bool)
        self.first = _ends(self.lengths) - self.lengths
        self.counts = [unpack(c) for c in row.counts]
        self.weights = [np.frombuffer(zstandard.decompress(w), np.float64) for w in row.weights]

    def orders(self, upto: int) -> list[Order]:
        out = [Order(self, None)]
        while len(out) < upto:
            out.append(Order(self, out[-1]))
        return out


def _cuts(bucket: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start, and the end."""
    return np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))


# ---- words

WORD_PIECE = "bucket int, chunk long, words binary, counts binary"
WORDS = "bucket int, words binary, counts binary, size long, total long, n array<long>, answers array<struct<chunk:long,numbers:binary,counts:binary>>"


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(count, K + 2), minlength=K + 3)[: K + 2].tolist()


def words_of(chunks: DataFrame, buckets: int, stored: DataFrame | None) -> DataFrame:
    """A row a bucket of words: their counts in order of their numbers, and the answers to the chunks."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, words, hashes, counts in batch[["chunk", "words", "hashes", "counts"]].itertuples(index=False):
                words, counts = np.array(zstandard.decompress(words).split(b"\n"), object), unpack(counts)
                bucket = ((np.frombuffer(hashes, np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = _cuts(bucket)
                spelled = [zstandard.compress(b"\n".join(words[a:z]), 1) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({"bucket": bucket[cuts[:-1]], "chunk": chunk, "words": spelled, "counts": packed(counts, cuts)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(pd.concat(batches).itertuples(index=False)) if (batches := list(batches)) else []
        if not rows:
            return
        words = [zstandard.decompress(r.words) for r in rows]
        data = np.frombuffer(b"\n".join(words), np.uint8)
        wide = np.diff(np.flatnonzero(data == 10), prepend=-1, append=len(data)) - 1
        place, names = _numbers(data[data != 10], wide)
        total = np.bincount(place, weights=np.concatenate([unpack(r.counts) for r in rows])).astype(np.int64)
        order = pc.sort_indices(pa.table({"total": total, "name": names}), sort_keys=[("total", "descending"), ("name", "ascending")]).to_numpy().astype(np.int64)
        bucket, given = int(rows[0].bucket), np.empty(len(names), np.int64)
        given[order] = np.arange(len(names)) * buckets + bucket + 1  # small numbers for frequent words; zero is the start
        places = np.split(place, _ends(np.array([w.count(b"\n") + 1 for w in words]))[:-1])
        answers = [{"chunk": r.chunk, "numbers": pack(given[p]), "counts": pack(total[p])} for r, p in zip(rows, places, strict=True) if r.chunk != STORED]
        seen = order[total[order] > 0]
        spelled = zstandard.compress(b"\n".join(names.to_numpy(zero_copy_only=False)[seen].tolist()), 3)
        yield pd.DataFrame([{"bucket": bucket, "words": spelled, "counts": pack(total[seen]), "size": len(seen), "total": int(total.sum()), "n": _counts_of_counts(total), "answers": answers}])

    pieces = chunks.select("chunk", "words", "hashes", "counts").mapInPandas(deal, WORD_PIECE)
    if stored is not None:
        pieces = pieces.unionByName(stored.where("size > 0").select("bucket", F.lit(STORED).cast("long").alias("chunk"), "words", "counts"))
    return pieces.repartitionById(buckets, "bucket").mapInPandas(count, WORDS)


def numbered(chunks: DataFrame, words: DataFrame, id_type: str) -> DataFrame:
    """Chunks with the answers: numbers and counts of their words, frequent words first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pieces = sorted(row.pieces, key=lambda p: p["bucket"])
                number, count = (np.concatenate([unpack(p[c]) for p in pieces]) for c in ("numbers", "counts"))
                order = np.argsort(number)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                out = {"tokens": pack(place[unpack(row.tokens)]), "numbers": pack(number[order]), "counts": [pack(count[order])], "weights": []}
                yield pd.DataFrame([{**{c: getattr(row, c) for c in ("chunk", "train", "lengths", "n_tokens")}, "ids": list(row.ids), **out}])

    answers = words.select("bucket", F.explode("answers").alias("a")).groupBy("a.chunk").agg(F.collect_list(F.struct("bucket", "a.numbers", "a.counts")).alias("pieces"))
    joined = chunks.drop("words", "hashes", "counts").join(answers.hint("shuffle_hash"), "chunk")
    return joined.mapInPandas(run, CHUNK.format(id=id_type, words=NUMBERED))


# ---- n-grams

GRAM_COLUMNS = "history array<binary>, followers binary, n binary, lower_n binary, words binary, counts binary, lowers binary"
GRAM_PIECE = f"bucket int, chunk long, {GRAM_COLUMNS}"
STORED_GRAMS = f"bucket int, {GRAM_COLUMNS}, cc array<long>"
GRAMS = f"{STORED_GRAMS}, answers array<struct<chunk:long,counts:binary,histories:binary,open:binary>>"
NAMES = [c.split()[0] for c in GRAM_COLUMNS.split(", ")]


@dataclass(frozen=True)
class Meta:
    """What a model is, besides its tables: ``off`` holds what counts lose, by order."""

    total: int
    size: int
    documents: int
    word_buckets: int
    buckets: int
    limit: int
    rest: float  # of unknown words
    off: tuple[np.ndarray, ...]

    @property
    def order(self) -> int:
        return len(self.off)


def grams_of(chunks: DataFrame, order: int, meta: Meta, stored: DataFrame | None) -> DataFrame:
    """A row a bucket of histories: the followers' counts, and the answers to the chunks."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk = Chunk(row, meta.total, meta.documents)
                grams = chunk.orders(order)[-1]
                columns = grams.below.words(chunk)
                asked, bucket = grams.dealt(chunk, columns, meta.buckets, meta.limit)
                if not len(asked):
                    continue
                count = np.bincount(grams.at[np.repeat(chunk.train, chunk.lengths)], minlength=grams.size)
                history, cuts = grams.history[asked], _cuts(bucket)
                new = np.diff(history, prepend=-1) != 0
                new[cuts[:-1]] = True
                runs = np.flatnonzero(new)
                h, run_cuts = history[runs], np.searchsorted(runs, cuts)
                lower = grams.below.at[grams.first[asked]]
                out = {"bucket": bucket[cuts[:-1]], "chunk": row.chunk, "history": list(map(list, zip(*[packed(c[h], run_cuts) for c in columns], strict=True)))}
                out |= {"followers": packed(np.diff(runs, append=len(asked)), run_cuts), "n": packed(grams.history_n[h], run_cuts), "lower_n": packed(grams.below.n[lower[runs]], run_cuts)}
                out |= {"words": packed(chunk.numbers[grams.word[asked]], cuts), "counts": packed(count[asked], cuts), "lowers": packed(grams.below.count[lower], cuts)}
                yield pd.DataFrame(out)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(pd.concat(batches).itertuples(index=False)) if (batches := list(batches)) else []
        if not rows:
            return
        join = lambda c: np.concatenate([unpack(getattr(r, c)) for r in rows])
        history = [np.concatenate([unpack(r.history[j]) for r in rows]) for j in range(order - 1)]
        first_run, run_rank = distinct(*history)
        each = [unpack(r.words) for r in rows]
        rank, words, cuts = np.repeat(run_rank, join("followers")), np.concatenate(each), np.append(0, _ends(np.array([len(w) for w in each])))
        first, at = distinct(rank, words)
        count = np.bincount(at, weights=join("counts")).astype(np.int64)
        seen = first[count > 0]
        told = {"followers": pack(np.bincount(rank[seen], minlength=len(first_run))), "n": pack(join("n")[first_run]), "lower_n": pack(join("lower_n")[first_run])}
        told |= {"words": pack(words[seen]), "counts": pack(count[count > 0]), "lowers": pack(join("lowers")[seen])}
        answers, ask = [], [i for i, r in enumerate(rows) if r.chunk != STORED]
        if ask:
            mine = count[at]
            zero = np.flatnonzero(mine == 0)
            zero_cuts = np.searchsorted(zero, cuts)
            piece = np.repeat(np.arange(len(rows)), np.diff(zero_cuts))
            first, number = distinct(piece, rank[zero])
            own_cuts = np.searchsorted(piece[first], np.arange(len(rows) + 1))
            parts = [packed(mine, cuts), packed(rank[zero][first], own_cuts), packed(number - own_cuts[piece], zero_cuts)]
            answers = [{"chunk": rows[i].chunk, "counts": parts[0][i], "histories": parts[1][i], "open": parts[2][i]} for i in ask]
        yield pd.DataFrame([{"bucket": int(rows[0].bucket), "history": [pack(h[first_run]) for h in history], **told, "cc": _counts_of_counts(count), "answers": answers}])

    pieces = chunks.mapInPandas(deal, GRAM_PIECE)
    if stored is not None:
        pieces = pieces.unionByName(stored.select("bucket", F.lit(STORED).cast("long").alias("chunk"), *NAMES))
    return pieces.repartitionById(meta.buckets, "bucket").mapInPandas(meet, GRAMS)


def _sums(row, off: np.ndarray, lower_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count of each history of a bucket, the probability that its followers have, and their probability one order below."""
    n, followers = unpack(row.n), unpack(row.followers)
    rank = np.repeat(np.arange(len(n)), followers)
    own = np.bincount(rank, weights=kept(off, unpack(row.counts)), minlength=len(n)) / n
    lower = np.bincount(rank, weights=kept(lower_off, unpack(row.lowers)) / unpack(row.lower_n)[rank], minlength=len(n))
    return n, own, lower


def dealt_weights(grams: DataFrame, meta: Meta, off: np.ndarray, lower_off: np.ndarray) -> DataFrame:
    """(history, weight) of histories that are dealt to several buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n, own, lower = _sums(row, off, lower_off)
                some = np.flatnonzero(n >= meta.limit)
                names = np.stack([unpack(h)[some] for h in row.history], 1)
                yield pd.DataFrame({"history": pd.Series(list(names), dtype=object), "own": own[some], "lower": lower[some]})

    rows = grams.drop("answers").mapInPandas(run, "history array<long>, own double, lower double")
    sums = rows.groupBy("history").agg(F.sum("own").alias("own"), F.sum("lower").alias("lower"))
    return sums.select("history", ((1 - F.col("own")) / (1 - F.col("lower"))).alias("weight"))


ANSWER = "chunk long, bucket int, counts binary, open binary, weights binary, asks array<struct<at:int,history:array<long>>>"


def answers_of(grams: DataFrame, meta: Meta, off: np.ndarray, lower_off: np.ndarray) -> DataFrame:
    """Counts and weights for each chunk; ``asks`` are the histories whose weights other buckets share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n, own, lower = _sums(row, off, lower_off)
                with np.errstate(divide="ignore", invalid="ignore"):  # parts of dealt histories are answered apart
                    weight = (1 - own) / (1 - lower)
                history, out = [unpack(h) for h in row.history], []
                for a in row.answers:
                    h = unpack(a["histories"])
                    asks = [{"at": int(i), "history": [int(c[h[i]]) for c in history]} for i in np.flatnonzero(n[h] >= meta.limit)]
                    out.append((a["chunk"], row.bucket, a["counts"], a["open"], zstandard.compress(weight[h].tobytes(), 1), asks))
                yield pd.DataFrame(out, columns=["chunk", "bucket", "counts", "open", "weights", "asks"])

    return grams.mapInPandas(run, ANSWER)


def _with_answers(chunks: DataFrame, answers: DataFrame, dealt: DataFrame) -> DataFrame:
    asks = answers.select("chunk", "bucket", F.explode("asks").alias("a")).select("chunk", "bucket", "a.at", "a.history")
    told = asks.join(dealt, "history").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "at", "weight")).alias("told"))
    pieces = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "open", "weights")).alias("pieces"))
    return chunks.join(pieces.join(told, "chunk", "left").hint("shuffle_hash"), "chunk", "left")


def _learned(row, chunk: Chunk, grams: Order, meta: Meta) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the chunk's n-grams, and the weights of those whose history is known but not they themselves."""
    asked, bucket = grams.dealt(chunk, grams.below.words(chunk), meta.buckets, meta.limit)
    count, weight = np.zeros(grams.size, np.int64), np.ones(grams.size)
    told: dict[int, list] = defaultdict(list)
    for t in row.told if row.told is not None else ():
        told[t["bucket"]].append((t["at"], t["weight"]))
    pieces = {p["bucket"]: p for p in (row.pieces if row.pieces is not None else ())}
    counts, opens, weights, held = [], [], [], 0
    for b in bucket[_cuts(bucket)[:-1]].tolist():
        p = pieces[b]
        w = np.frombuffer(zstandard.decompress(p["weights"]), np.float64)
        if b in told:
            w = w.copy()
            for at, value in told[b]:
                w[at] = value
        counts.append(unpack(p["counts"]))
        opens.append(unpack(p["open"]) + held)
        weights.append(w)
        held += len(w)
    if counts:
        found = np.concatenate(counts)
        count[asked] = found
        weight[asked[found == 0]] = np.concatenate(weights)[np.concatenate(opens)]
    return count, weight[(count == 0) & (grams.n > 0)]


def extended(chunks: DataFrame, order: int, meta: Meta, id_type: str) -> DataFrame:
    """Chunks that hold the answers of one order more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk = Chunk(row, meta.total, meta.documents)
                count, weight = _learned(row, chunk, chunk.orders(order)[-1], meta)
                more = {"counts": [*row.counts, pack(count)], "weights": [*row.weights, zstandard.compress(weight.tobytes(), 1)]}
                yield pd.DataFrame([{**{c: getattr(row, c) for c in ("chunk", "train", "lengths", "tokens", "numbers", "n_tokens")}, "ids": list(row.ids), **more}])

    return chunks.mapInPandas(run, CHUNK.format(id=id_type, words=NUMBERED))


SCORES = "id {id}, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(chunks: DataFrame, meta: Meta, id_type: str) -> DataFrame:
    """Scores of the documents of chunks that come with the answers of the highest order (if above one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk = Chunk(row, meta.total, meta.documents)
                levels = chunk.orders(meta.order)
                count = chunk.counts[0]
                p = np.log10(np.where(count > 0, kept(meta.off[0], count) / max(1, meta.total), meta.rest))[chunk.tokens]
                for i, grams in enumerate(levels[1:], 1):
                    last = i + 1 == meta.order
                    count, weight = _learned(row, chunk, grams, meta) if last else (chunk.counts[i], chunk.weights[i - 1])
                    seen = count > 0
                    step = np.zeros(grams.size)
                    step[seen] = np.log10(kept(meta.off[i], count[seen]) / grams.n[seen])
                    step[~seen & (grams.n > 0)] = np.log10(weight)
                    p = step[grams.at] + np.where(seen[grams.at], 0, p)
                known = (chunk.counts[0] > 0).astype(np.int64)[chunk.tokens]
                base = np.log10((chunk.counts[0] + 1.0) / (meta.total + 1 * (meta.size + 1)))[chunk.tokens]
                add = lambda x: np.add.reduceat(x, chunk.first)
                yield pd.DataFrame({"id": list(row.ids), "n_tokens": chunk.lengths, "n_known": add(known), "train_tokens": meta.total, "base_score": add(base), "score": add(p)})

    return chunks.mapInPandas(run, SCORES.format(id=id_type))


def weights_of(grams: DataFrame, dealt: DataFrame, meta: Meta, off: np.ndarray, lower_off: np.ndarray) -> DataFrame:
    """Stored weights: (bucket, history, weights) of histories that one bucket has, and rows of bucket -1 for those dealt out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n, own, lower = _sums(row, off, lower_off)
                whole = np.flatnonzero(n < meta.limit)
                weight = (1 - own[whole]) / (1 - lower[whole])
                yield pd.DataFrame([{"bucket": row.bucket, "history": [pack(unpack(h)[whole]) for h in row.history], "weights": zstandard.compress(weight.tobytes(), 1)}])

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                columns = np.stack(batch["history"].to_numpy()).T
                yield pd.DataFrame([{"bucket": -1, "history": [pack(c) for c in columns], "weights": zstandard.compress(batch["weight"].to_numpy(np.float64).tobytes(), 1)}])

    schema = "bucket int, history array<binary>, weights binary"
    return grams.mapInPandas(run, schema).unionByName(dealt.mapInPandas(shared, schema))


# ---- models


@dataclass(frozen=True)
class KatzModel:
    """A trained model: tables under ``path`` and what is known of them."""

    path: str
    meta: Meta

    def words(self, spark: SparkSession) -> DataFrame:
        """(number, word, count)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    if r.size:
                        count = unpack(r.counts)
                        yield pd.DataFrame({"number": np.arange(len(count)) * self.meta.word_buckets + r.bucket + 1, "word": [w.decode("utf-8", "replace") for w in zstandard.decompress(r.words).split(b"\n")], "count": count})

        return spark.read.schema(WORDS).parquet(f"{self.path}/words").select("bucket", "words", "counts", "size").mapInPandas(run, "number long, word string, count long")

    def grams(self, spark: SparkSession, order: int) -> DataFrame:
        """(history, word, count, discounted, probability): numbers of words, zero for a text's start."""
        off = self.meta.off[order - 1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    rank = np.repeat(np.arange(len(unpack(r.n))), unpack(r.followers))
                    history, count = np.stack([unpack(h)[rank] for h in r.history], 1), unpack(r.counts)
                    discounted = kept(off, count)
                    yield pd.DataFrame({"history": pd.Series(list(history), dtype=object), "word": unpack(r.words), "count": count, "discounted": discounted, "probability": discounted / unpack(r.n)[rank]})

        rows = spark.read.schema(STORED_GRAMS).parquet(f"{self.path}/grams/order={order}")
        return rows.mapInPandas(run, "history array<long>, word long, count long, discounted double, probability double")

    def weights(self, spark: SparkSession, order: int) -> DataFrame:
        """(history, weight) of every history of ``order`` - 1 words."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    history = np.stack([unpack(h) for h in r.history], 1)
                    yield pd.DataFrame({"history": pd.Series(list(history), dtype=object), "weight": np.frombuffer(zstandard.decompress(r.weights), np.float64)})

        return spark.read.parquet(f"{self.path}/weights/order={order}").select("history", "weights").mapInPandas(run, "history array<long>, weight double")


def _run(docs: DataFrame, train: Column, id_col: str, text_col: str, order: int, chunk_tokens: int, bucket_tokens: int, model: KatzModel | None) -> tuple[DataFrame, KatzModel]:
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base, path = new_path(spark, "katz"), model.path if model else new_path(spark, "model")
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = save(chunked(docs, train, id_col, text_col, chunk_tokens), f"{base}/chunks", "none")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    documents = _train_documents(chunks)
    size = max(parts, -(-tokens // bucket_tokens))
    buckets = model.meta.buckets if model else size
    word_buckets = model.meta.word_buckets if model else size
    words = save(words_of(chunks, word_buckets, spark.read.schema(WORDS).parquet(f"{path}/words") if model else None), f"{base}/words", "none")
    if model:
        meta = model.meta
    else:
        found = words.agg(F.sum("total").alias("total"), F.sum("size").alias("size"), *[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(1, K + 2)]).first()
        n = np.array([0] + [found[f"n{i}"] or 0 for i in range(1, K + 2)])
        total, known, off = found["total"] or 0, found["size"] or 0, taken_off(n)
        rest = float((n[: K + 1] * off[: K + 1]).sum() + (known - n[: K + 1].sum()) * LARGE) / total if total else 1.0
        meta = Meta(total, known, documents, word_buckets, buckets, max(1, bucket_tokens // 4), rest, (off,))
        save(words.withColumn("answers", F.array().cast(words.schema["answers"].dataType)), f"{path}/words", "none")
    now = save(numbered(chunks, words, id_type), f"{base}/chunks1", "none")
    drop(spark, f"{base}/chunks", f"{base}/words")
    result = None
    for n in range(2, order + 1):
        grams = save(grams_of(now, n, meta, spark.read.schema(STORED_GRAMS).parquet(f"{path}/grams/order={n}") if model else None), f"{base}/grams{n}", "none")
        if not model:
            cc = grams.agg(*[F.sum(F.get("cc", F.lit(i))).alias(f"n{i}") for i in range(1, K + 2)]).first()
            meta = Meta(**{**meta.__dict__, "off": (*meta.off, taken_off(np.array([0] + [x or 0 for x in cc])))})
        off, below = meta.off[n - 1], meta.off[n - 2]
        dealt = save(dealt_weights(grams, meta, off, below), f"{base}/dealt{n}")
        answers = save(answers_of(grams, meta, off, below), f"{base}/answers{n}", "none")
        answered = _with_answers(now, answers, dealt)
        if not model:
            save(grams.drop("answers"), f"{path}/grams/order={n}", "none")
        drop(spark, f"{base}/grams{n}")
        if n < order:
            now = save(extended(answered, n, meta, id_type), f"{base}/chunks{n}", "none")
        else:
            result = save(scores(answered, meta, id_type), f"{base}/scores")
        drop(spark, f"{base}/chunks{n - 1}", f"{base}/answers{n}")
    if result is None:
        result = save(scores(now, meta, id_type), f"{base}/scores")
        drop(spark, f"{base}/chunks1")
    if not model:
        for n in range(2, order + 1):
            grams, dealt = (spark.read.schema(s).parquet(p) for s, p in ((STORED_GRAMS, f"{path}/grams/order={n}"), ("history array<long>, weight double", f"{base}/dealt{n}")))
            save(weights_of(grams, dealt, meta, meta.off[n - 1], meta.off[n - 2]), f"{path}/weights/order={n}", "none")
    return result.withColumnRenamed("id", id_col), model or KatzModel(path, meta)


def train_and_score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, chunk_tokens: int = 3 << 18, bucket_tokens: int = 3 << 18
) -> tuple[DataFrame, KatzModel]:
    """(id, n_tokens, n_known, train_tokens, base_score, score) a row of ``docs``, and the model of those for which ``train`` holds."""
    return _run(docs, train, id_col, text_col, order, chunk_tokens, bucket_tokens, None)


def score_with(model: KatzModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 3 << 18) -> DataFrame:
    """The same columns for documents that took no part in training, by the stored tables."""
    return _run(docs, F.lit(False), id_col, text_col, model.meta.order, chunk_tokens, 4 * model.meta.limit, model)[0]


def _train_documents(chunks: DataFrame) -> int:
    """How many documents training has: the count of the start as a history."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [int(unpack(t).sum()) for t in batch["train"]]})

    return int(chunks.select("train").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0)

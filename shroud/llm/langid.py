"""Language of words and documents by a linear-chain conditional random field.

A text is the sequence of its lower-cased words, runs of letters. A word's evidence for each language is the
sum of weights of its affixes and character n-grams, hashed to a fixed number of places, and of a lexicon
score: how much more often its hashed word occurs in that language. Learned transitions join the words, so a
foreign passage is labelled as one and a lone strange word is not. Forward-backward gives every word's
distribution over languages; a document's are their mean.

The lexicon counts every word of every training document on Spark, added up by task before they are shuffled;
its size is ``BUCKETS`` a language, whatever the corpus. The weights are fitted on a bounded sample, at most
``sample`` whole texts of at most ``longest`` characters a language, those of the smallest text hashes: their
words are spliced in runs into sequences that switch between languages, so that there are switches to learn
from. Labels are the documents' languages. The model is broadcast; its size is 4 * (PLACES + BUCKETS) bytes a
language. Texts are labelled where they lie, without a shuffle.

Nulls: a text that is null or has no letter is ``und`` with score 0, as is every text where no training
document has a language. Training documents without a language or text are left out. Repeated rows count as
often as they come. Very long texts are read whole, a megabyte at a time. Ties go to the language that is
first by name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES, BUCKETS = 1 << 16, 1 << 17
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Characters of a text that are split into words at once, words whose evidence a task keeps, and words that are run through the chain at once.
PIECE, CACHED, CHAINED = 1 << 20, 300_000, 1_000_000


def words(text: str) -> Iterator[list[str]]:
    """Lists of the text's lower-cased words; a long text is cut between words."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        found = WORD.findall(text[at:end].lower())
        yield [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]
        at = end


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def places(word: str) -> list[int]:
    """Hashed prefixes and suffixes of up to three letters, and bigrams and trigrams with the word's ends."""
    ends = f"^{word}$"
    affixes = [f"{kind}{part}" for n in range(1, min(3, len(word)) + 1) for kind, part in (("<", word[:n]), (">", word[-n:]))]
    grams = [ends[i : i + n] for n in (2, 3) for i in range(len(ends) - n + 1)]
    return [zlib.crc32(f.encode()) % PLACES for f in affixes + grams]


@dataclass(frozen=True)
class Model:
    """``weights`` by place and language, ``lexicon`` by bucket and language, both with what the lexicon counts for; ``first`` and ``moves`` in the chain."""

    languages: tuple[str, ...]
    weights: np.ndarray
    lexicon: np.ndarray
    trust: float
    first: np.ndarray
    moves: np.ndarray

    def evidence(self, found: list[str]) -> np.ndarray:
        """Scores of words by language; a word's places count as a vector of length one."""
        each = [places(w) for w in found]
        sizes = np.array([len(p) for p in each])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.weights[np.concatenate([np.array(p) for p in each])], starts, axis=0) if found else np.zeros((0, len(self.languages)))
        return (sums / np.sqrt(sizes)[:, None] + self.trust * self.lexicon[[bucket(w) for w in found]]).astype(np.float32)


class _Words(dict):
    """The row of each word met, in the order met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Chain:
    """Runs texts through a model; keeps the evidence of words between batches."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, _Words()
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.first, self.moves = np.exp(model.first).astype(np.float32), np.exp(model.moves).astype(np.float32)

    def _read(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.rows.__getitem__, found), np.int32, len(found)) for found in words(text or "")]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _learn(self) -> None:
        new = list(self.rows)[len(self.scores) :]
        for i in range(0, len(new), 50_000):
            more = self.model.evidence(new[i : i + 50_000])
            self.scores = np.concatenate([self.scores, np.exp(more - more.max(axis=1, keepdims=True))])

    def shares(self, texts: Iterable[str | None], marginals: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """By text: words, expected share of words by language and, if asked for, every word's distribution."""
        if len(self.rows) > CACHED:
            self.rows, self.scores = _Words(), self.scores[:0]
        ids = [self._read(t) for t in texts]
        self._learn()
        sizes = np.array([len(x) for x in ids], np.int64)
        out, each = np.zeros((len(ids), len(self.model.languages))), [np.zeros((0, len(self.model.languages)), np.float32)] * len(ids)
        order, at = np.argsort(-sizes, kind="stable"), 0
        order = order[sizes[order] > 0]
        while at < len(order):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), CHAINED, "right")))
            group, at = order[at:end], end
            out[group], every = self._group([ids[i] for i in group], sizes[group], marginals)
            for i, m in zip(group, every, strict=False):
                each[i] = m
        return sizes, out / np.maximum(sizes, 1)[:, None], each

    def _group(self, ids: list[np.ndarray], sizes: np.ndarray, marginals: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Forward-backward over texts by falling size, all at one position at a time."""
        place = np.concatenate([np.arange(n) for n in sizes])
        by_place = np.argsort(place, kind="stable")
        seen = self.scores[np.concatenate(ids)[by_place]]
        active = np.bincount(place)
        ends = np.cumsum(active)
        forward, now = np.empty_like(seen), None
        for k, end in zip(active, ends, strict=True):
            now = (self.first if now is None else now[:k] @ self.moves) * seen[end - k : end]
            now /= now.sum(axis=1, keepdims=True)
            forward[end - k : end] = now
        total, back, turned = np.zeros((len(sizes), seen.shape[1])), np.ones((len(sizes), seen.shape[1]), np.float32), self.moves.T.copy()
        for k, end in zip(active[::-1], ends[::-1], strict=True):
            both = forward[end - k : end] * back[:k]
            both /= both.sum(axis=1, keepdims=True)
            total[:k] += both
            if marginals:
                forward[end - k : end] = both
            after = (seen[end - k : end] * back[:k]) @ turned
            back[:k] = after / after.sum(axis=1, keepdims=True)
        if not marginals:
            return total, []
        flat = np.empty_like(forward)
        flat[by_place] = forward
        return total, np.split(flat, np.cumsum(sizes)[:-1])


def lexicon(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): words of all ``docs`` by language and hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        met: dict[str, Counter] = {}

        def settle() -> None:
            for name, counter in met.items():
                np.add.at(tables.setdefault(name, np.zeros(BUCKETS, np.int64)), [bucket(w) for w in counter], list(counter.values()))
            met.clear()

        for batch in batches:
            for name, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                counter = met.setdefault(name, Counter())
                for found in words(t):
                    counter.update(found)
                if sum(map(len, met.values())) > CACHED:
                    settle()
        settle()
        for name, table in tables.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(table[used])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def sample_texts(docs: DataFrame, text: str, lang: str, sample: int, longest: int) -> list[tuple[str, str]]:
    """(language, text): at most ``sample`` different texts a language, of the smallest hashes."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("text").between(1, longest)).withColumn("hash", F.xxhash64("text"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("hash"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= sample).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in first.collect())


def splice(texts: list[tuple[str, str]], languages: list[str], length: int = 64, switch: float = 0.2, seed: int = 1) -> tuple[list[list[str]], list[list[int]]]:
    """Sequences of words and their languages: runs of 4 to 16 words, each of the language before or, at ``switch``, of another."""
    rng = np.random.default_rng(seed)
    runs: list[list[list[str]]] = [[] for _ in languages]
    for name, t in texts:
        found = [w for part in words(t) for w in part]
        at = 0
        while at < len(found):
            n = int(rng.integers(4, 17))
            runs[languages.index(name)].append(found[at : at + n])
            at += n
    used, sequences, labels = [0] * len(languages), [], []
    now = 0
    while any(used[k] < len(r) for k, r in enumerate(runs)):
        seq, lab = [], []
        while len(seq) < length:
            left = [k for k, r in enumerate(runs) if used[k] < len(r)]
            if not left:
                break
            if now not in left or (len(left) > 1 and rng.random() < switch):
                now = int(rng.choice([k for k in left if k != now] or left))
            run = runs[now][used[now]]
            used[now] += 1
            seq, lab = seq + run, lab + [now] * len(run)
        sequences.append(seq), labels.append(lab)
    return sequences, labels


def fit(sequences: list[list[str]], labels: list[list[int]], lex: np.ndarray, rounds: int = 60, decay: float = 0.01, rate: float = 0.2) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, trust in the lexicon, first scores and moves that make the labels likely; all words at once, by Adam."""
    k = lex.shape[1]
    rows = _Words()
    ids = [np.fromiter(map(rows.__getitem__, s), np.int64, len(s)) for s in sequences]
    kinds = list(rows)
    each = [np.array(places(w)) for w in kinds]
    sizes = np.array([len(e) for e in each])
    flat, of = np.concatenate(each), np.repeat(np.arange(len(kinds)), sizes)
    starts, worth = np.concatenate([[0], np.cumsum(sizes)[:-1]]), 1 / np.sqrt(sizes)
    known = lex[[bucket(w) for w in kinds]]
    order = np.argsort([-len(s) for s in ids], kind="stable")
    ids, gold = [ids[i] for i in order], [np.array(labels[i]) for i in order]
    place = np.concatenate([np.arange(len(s)) for s in ids])
    by_place = np.argsort(place, kind="stable")
    word, truth = np.concatenate(ids)[by_place], np.concatenate(gold)[by_place]
    active = np.bincount(place)
    ends, n = np.cumsum(active), len(word)
    true_moves = np.zeros((k, k))
    for s in gold:
        np.add.at(true_moves, (s[:-1], s[1:]), 1)
    params = [np.zeros((PLACES, k)), np.array(1.0), np.zeros(k), np.zeros((k, k))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        weights, trust, first, moves = params
        scores = np.add.reduceat(weights[flat], starts, axis=0) * worth[:, None] + trust * known
        seen = np.exp(scores - scores.max(axis=1, keepdims=True))[word]
        go, now, forward = np.exp(moves), None, np.empty_like(seen)
        for a, end in zip(active, ends, strict=True):
            now = (np.exp(first) if now is None else now[:a] @ go) * seen[end - a : end]
            now /= now.sum(axis=1, keepdims=True)
            forward[end - a : end] = now
        back, surplus, moved = np.ones((active[0], k)), np.empty_like(seen), np.zeros((k, k))
        for t in range(len(active) - 1, -1, -1):
            a, end = active[t], ends[t]
            both = forward[end - a : end] * back[:a]
            surplus[end - a : end] = both / both.sum(axis=1, keepdims=True)
            if t:
                before = forward[ends[t - 1] - active[t - 1] : ends[t - 1]][:a]
                here = seen[end - a : end] * back[:a]
                norm = np.einsum("ni,ij,nj->n", before, go, here)
                moved += go * (before.T @ (here / norm[:, None]))
                after = here @ go.T
                back[:a] = after / after.sum(axis=1, keepdims=True)
        surplus[np.arange(n), truth] -= 1
        by_kind = np.stack([np.bincount(word, surplus[:, j], len(kinds)) for j in range(k)], axis=1)
        spread = (by_kind * worth[:, None])[of]
        slope = [
            np.stack([np.bincount(flat, spread[:, j], PLACES) for j in range(k)], axis=1) / n + decay / PLACES * weights,
            np.array((by_kind * known).sum() / n),
            surplus[: active[0]].sum(axis=0) / n,
            (moved - true_moves) / n,
        ]
        for i, g in enumerate(slope):
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return params[0].astype(np.float32), float(params[1]), params[2], params[3]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 150, longest: int = 20_000) -> Model:
    """The model of ``docs``, all of which are training documents."""
    counted = lexicon(docs, text, lang).toArrow()  # at most BUCKETS rows a language
    names = counted["lang"].combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist(), key=str.encode)
    column = np.array([languages.index(n) for n in names.dictionary.to_pylist()], np.int64)
    counts = np.zeros((BUCKETS, len(languages)))
    counts[counted["bucket"].to_numpy(), column[names.indices.to_numpy()]] = counted["n"].to_numpy()
    odds = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    lex = np.clip(odds - odds.mean(axis=1, keepdims=True), -4, 4).astype(np.float32) if languages else odds.astype(np.float32)
    texts = [x for x in sample_texts(docs, text, lang, sample, longest) if x[0] in languages]
    sequences, labels = splice(texts, languages)
    if not sequences:
        flat = np.zeros(len(languages))
        return Model(tuple(languages), np.zeros((PLACES, len(languages)), np.float32), lex, 1.0, flat, np.zeros((len(languages),) * 2))
    weights, trust, first, moves = fit(sequences, labels, lex)
    return Model(tuple(languages), weights, lex, trust, first, moves)


def predict(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """struct(lang, score) of each row's text, the language of most expected words and their share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = Chain(shared.value)
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for texts in batches:
            if len(names) == 1:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            sizes, shares, _ = chain.shares(texts)
            best = np.where(sizes > 0, shares.argmax(axis=1), len(names) - 1)
            yield pd.DataFrame({"lang": names[best], "score": np.where(sizes > 0, np.clip(shares.max(axis=1), 0, 1), 0.0)})

    return run(F.col(text).cast("string"))


def tag_words(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """array of struct(word, lang, score): every word of the text with its likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<word: string, lang: string, score: double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = Chain(shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                found = [w for part in words(t or "") for w in part]
                each = chain.shares([t], marginals=True)[2][0] if found and chain.model.languages else []
                rows.append([{"word": w, "lang": chain.model.languages[int(m.argmax())], "score": float(m.max())} for w, m in zip(found, each, strict=False)])
            yield pd.Series(rows)

    return run(F.col(text).cast("string"))

from __future__ import annotations

import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import lm


class Plain:
    """The model by dictionaries of whole n-grams."""

    def __init__(self, docs, train, order):
        self.order, self.tokens = order, {d: (t or "").encode().lower().split() + [b" end"] for d, t in docs}
        self.count, self.follow = [Counter() for _ in range(order + 1)], [defaultdict(Counter) for _ in range(order + 1)]
        for d, w in self.tokens.items():
            if train(d):
                padded = [None] * (order - 1) + w
                for i in range(order - 1, len(padded)):
                    for n in range(1, order + 1):
                        self.follow[n][tuple(padded[i - n + 1 : i])][padded[i]] += 1
        self.words = self.follow[1][()]
        self.total = sum(self.words.values())
        self.off = [None]
        for n in range(1, order + 1):
            c = Counter(r for f in self.follow[n].values() for r in f.values())
            d = lm.katz_discounts(np.array([0] + [c[r] for r in range(1, 7)]))
            self.off.append([r * (1 - d[r]) for r in range(6)])
        self.unknown = sum(self.cut(1, r) for r in self.words.values()) / self.total if self.total else 1.0
        self.memo = {}

    def cut(self, n, r):
        return self.off[n][r] if r <= 5 else 0.5

    def weight(self, h):
        if h not in self.memo:
            f = self.follow[len(h) + 1][h]
            n = sum(f.values())
            self.memo[h] = (1 - sum((r - self.cut(len(h) + 1, r)) / n for r in f.values())) / (1 - sum(self.p(w, h[1:]) for w in f))
        return self.memo[h]

    def p(self, w, h):
        n = len(h) + 1
        f = self.follow[n].get(h)
        if n == 1:
            return (f[w] - self.cut(1, f[w])) / self.total if f and f[w] else self.unknown
        if not f:
            return self.p(w, h[1:])
        return (f[w] - self.cut(n, f[w])) / sum(f.values()) if w in f else self.weight(h) * self.p(w, h[1:])

    def scores(self):
        out, size = {}, len(self.words)
        for d, w in self.tokens.items():
            padded = [None] * (self.order - 1) + w
            score = sum(np.log10(self.p(padded[i], tuple(padded[i - self.order + 1 : i]))) for i in range(self.order - 1, len(padded)))
            base = sum(np.log10((self.words[x] + 1) / (self.total + size + 1)) for x in w)
            out[d] = (len(w), sum(self.words[x] > 0 for x in w), self.total, base, score)
        return out


def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, 4000) if i < 500]
    docs, at = [], 0
    for i in range(80):
        n = int(rng.integers(0, 60))
        docs.append((i, " ".join(words[at : at + n]) or None))
        at = (at + n) % 2500
    return docs + [(90, "always paired"), (91, "w1 new words here"), (92, "always paired " * 40), (94, "W1\x00x é w2\x1cw3 w1")]


def held_in(d):
    return d % 4 != 1


def agrees(rows, want):
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == set(want)
    for d, (n, known, total, base, score) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert np.isclose(r["base_score"], base, rtol=1e-9) and np.isclose(r["score"], score, rtol=1e-9), d


@pytest.mark.parametrize(("order", "chunk", "bucket", "parts"), [(3, 1 << 20, 1 << 20, 4), (3, 400, 150, 16), (2, 900, 100, 5), (4, 1500, 400, 4)])
def test_scores_are_those_of_dictionaries_however_tokens_are_dealt(spark, order, chunk, bucket, parts):
    """Small buckets deal the frequent histories to many; every score is compared at each size."""
    docs = corpus()
    want = Plain(docs, held_in, order).scores()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows, model = lm.train_and_score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.col("doc_id") % 4 != 1, order=order, chunk_tokens=chunk, bucket_tokens=bucket)
        agrees(rows.collect(), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert model.meta.order == order


def test_stored_tables_sum_to_one_and_score_other_documents(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = F.col("doc_id") % 4 != 1
    rows, model = lm.train_and_score(df.where(train), F.lit(True), chunk_tokens=400, bucket_tokens=150)
    plain = Plain(docs, held_in, 3)
    words = {r["number"]: (r["word"], r["count"]) for r in model.words(spark).collect()}
    assert {w.encode(): c for w, c in words.values()} == {w: c for w, c in plain.words.items()}
    names = {n: w.encode() for n, (w, _) in words.items()} | {0: None}
    for order in (2, 3):
        grams, weights = model.grams(spark, order).collect(), {tuple(r["history"]): r["weight"] for r in model.weights(spark, order).collect()}
        assert {(*[names[h] for h in r["history"]], names[r["word"]]): r["count"] for r in grams} == {(*h, w): c for h, f in plain.follow[order].items() for w, c in f.items()}
        by_history = defaultdict(dict)
        for r in grams:
            by_history[tuple(r["history"])][names[r["word"]]] = r["probability"]
        assert set(by_history) == set(weights)
        for h, seen in by_history.items():
            shorter = tuple(names[x] for x in h[1:])
            rest = sum(plain.p(w, shorter) for w in plain.words if w not in seen) + plain.p(b"not a word", shorter)
            assert abs(sum(seen.values()) + weights[h] * rest - 1) < 1e-9
    want = plain.scores()
    agrees(lm.score_with(model, df.where(~train), chunk_tokens=200).collect(), {d: v for d, v in want.items() if not held_in(d)})
    agrees(rows.collect(), {d: v for d, v in want.items() if held_in(d)})


def test_katz_edges(spark, awkward, nothing):
    rows = lm.train_and_score(awkward, F.lit(True))[0].collect()
    assert len(rows) == 9 and all(np.isfinite(r["score"]) for r in rows) and sorted(r["n_tokens"] for r in rows)[:3] == [1, 1, 1]
    assert all(np.isfinite(r["score"]) and r["train_tokens"] == 0 for r in lm.train_and_score(awkward, F.lit(False))[0].collect())
    assert lm.train_and_score(nothing, F.lit(True))[0].count() == 0


def test_packed_integers():
    for a in ([], [0], [1, 2**31, 2**32 - 1], [2**62, 5]):
        assert lm.unpack(lm.pack(np.array(a, np.int64))).tolist() == a


@pytest.mark.parametrize("widest", [(3, 4), (1 << 20, 1 << 20), (1 << 40, 1 << 40), (5, 1 << 62, 2), (1 << 62,)])
def test_distinct_rows_of_any_width(widest):
    rng = np.random.default_rng(5)
    pool = np.stack([rng.integers(0, w, 300) for w in widest], 1)
    for size in (0, 1, 1000):
        rows = pool[rng.integers(0, 300, size)]
        first, number = lm.distinct(*rows.T)
        want = sorted(set(map(tuple, rows.tolist())))
        assert list(map(tuple, rows[first].tolist())) == want
        assert [want[i] for i in number] == list(map(tuple, rows.tolist()))
        assert all(f == number.tolist().index(i) for i, f in enumerate(first))


def test_distinct_rows_cost_less_than_an_argsort():
    """Most of the CPU seconds of op6_katz were argsorts of n-grams."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 19, 3 << 18), rng.integers(0, 1 << 17, 3 << 18)

    def least(f):
        spent = []
        for _ in range(5):
            began = time.process_time()
            f()
            spent.append(time.process_time() - began)
        return min(spent)

    assert least(lambda: lm.distinct(a, b)) < least(lambda: np.unique(a << 17 | b, return_index=True, return_inverse=True))


def test_words_are_those_of_split():
    texts = ["", " ", "a", "a b", "b ", " c", "\t\r\nd\x0b\x0ce", "f\x1cg\x85h\u00a0i \u3000j", "\x00", "é É", "k", "", "l  m", ""]
    raw = [t.encode().lower() for t in texts]
    letters, lengths, first = lm._words(b"".join(raw), np.append(0, np.cumsum([len(r) for r in raw])))
    ends = np.cumsum(lengths)
    words = [letters[z - n : z].tobytes() for n, z in zip(lengths, ends, strict=True)]
    assert [words[a:z] for a, z in zip(first, first[1:], strict=False)] == [r.split() for r in raw]


def test_scores_of_many_small_batches_of_rows(spark):
    docs, name = corpus(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        rows, _ = lm.train_and_score(df, F.col("doc_id") % 4 != 1, chunk_tokens=400, bucket_tokens=150)
        agrees(rows.collect(), Plain(docs, held_in, 3).scores())
        chunks = lm.chunked(df, F.lit(True), "doc_id", "text", 400).collect()
    finally:
        spark.conf.set(name, before)
    held, want = 0, [[]]
    for d, t in docs:
        want[-1].append(d)
        held += len((t or "").split()) + 1
        if held >= 400:
            held, want = 0, [*want, []]
    assert [c["ids"] for c in chunks] == [w for w in want if w]

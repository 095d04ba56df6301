from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shroud.llm import overlap


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(docs, least=0.8):
    """Least id of each component of all pairs by plain Jaccard; a pair without a common shingle is not looked at."""
    sets, of = [shingles(t) for _, t in docs], list(range(len(docs)))
    holders = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders.setdefault(x, []).append(i)

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in {k for x in a or [None] for k in holders[x] if k < i}:
            b = sets[j]
            if a == b or len(a & b) / len(a | b) >= least:
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    return {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}


def edited_documents():
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice([f"v{i}" for i in range(300)], n)) for n in (120, 90, 60, 40, 25, 200)]
    docs = []
    for i in range(240):
        w = base[i % 6].split() if i % 3 else base[0].split()
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"edit{int(rng.integers(0, 40))}"
        docs.append((i, " ".join(w) + (" one common closing line of all these documents" if i % 4 == 0 else "")))
    return docs + [(400, None), (401, ""), (402, "Two Words"), (403, "two words"), (404, "one")]


def test_components_are_those_of_all_pairs(spark):
    docs = edited_documents()
    want = brute_components(docs)
    assert 10 < len(set(want.values())) < 200
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(df).collect()} == want


def test_salted_shingles_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 3)
    docs = edited_documents()[:150]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(df).collect()} == brute_components(docs)


def test_similarity_on_the_limit_links(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles; one word less at the end: 8 of 9
    docs = [(0, " ".join(words)), (1, " ".join(words[:-1])), (2, " ".join(words[:-2])), (3, "a b c d e f g h"), (4, "a b c d e f g h i"), (5, "k l m n o p q r s"), (6, "k l m n o p q x")]
    want = brute_components(docs)
    assert want[4] == 3 and want[6] == 6
    assert {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_stage_drops_edited_copies_only(spark):
    """Copies with few changed words go; a document that shares three quarters stays."""
    rng = np.random.default_rng(9)
    docs = []
    for i in range(30):
        w = [f"d{i}x{int(k)}" for k in rng.integers(0, 400, 160)]
        copy, half = list(w), list(w)
        copy[40], copy[110] = "changed", "changed"
        half[100:140] = [f"o{i}x{k}" for k in range(40)]
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(half))]
    want = {c for d, c in brute_components(docs).items()}
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == want == {3 * i for i in range(30)} | {3 * i + 2 for i in range(30)}


def test_proposals_are_those_of_the_gray_index(spark):
    """Proposed pairs connect the nodes within the radius, and no others."""
    docs = edited_documents()
    rows = overlap.nodes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5, 42)
    fp = {r["node"]: np.int64(r["fp"]).view(np.uint64) for r in rows.collect()}
    of = {n: n for n in fp}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    pairs = [(r["a"], r["b"]) for r in overlap.proposed_pairs(rows, 3).collect()]
    for a, b in pairs:
        of[find(a)] = find(b)
    proposed = {n: find(n) for n in fp}
    of = {n: n for n in fp}
    for a in fp:
        for b in fp:
            if int(fp[a] ^ fp[b]).bit_count() <= 3:
                of[find(a)] = find(b)
    assert pairs and all((proposed[a] == proposed[b]) == (find(a) == find(b)) for a in fp for b in fp)


def test_edited_copies_below_the_limit_are_told_apart_by_sketches(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(80):  # five edits each: two texts that share one are 0.76 alike, those that share two 0.81
        words = list(base)
        for at in (10, 40, 70, 100, 130):
            words[at] = f"x{rng.randrange(20)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, real = [], overlap.confirmed
    monkeypatch.setattr(overlap, "confirmed", lambda pairs, sets, least: asked.append(pairs.count()) or real(pairs, sets, least))
    got = {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(docs).collect()}
    sets = [overlap.shingle_set(t, 5, 42)[1] for t in texts]
    near = [(i, j) for j in range(80) for i in range(j) if (c := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - c) >= 0.8]
    want = list(range(80))
    for _ in near:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))
    assert asked[-1] <= 150


def test_sketches_differ_in_no_more_bits_than_sets_do(spark):
    rng = random.Random(6)
    draw = lambda k: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(k)]
    rows = [((shared := draw(rng.randrange(300))) + draw(rng.randrange(20)), shared + draw(rng.randrange(20))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    bits = lambda r: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(r["a"], r["b"], strict=True))
    for (a, b), r in zip(rows, df.select(F.array(*overlap.sketch(F.col("a"))).alias("a"), F.array(*overlap.sketch(F.col("b"))).alias("b")).collect(), strict=True):
        d = len(set(a) ^ set(b))
        assert bits(r) <= d and bits(r) >= d - 10 and (d - bits(r)) % 2 == 0

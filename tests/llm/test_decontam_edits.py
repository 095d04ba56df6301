from __future__ import annotations

import numpy as np
import pytest

from shroud.llm import decontam


@pytest.mark.parametrize("step", [4, 5])
def test_single_edited_copies_are_found(spark, step):
    """One copy of each item with every fourth or fifth word replaced, in a corpus that holds nothing else of it."""
    rng = np.random.default_rng(step)
    items = [[f"i{k}w{int(w)}" for w in rng.integers(0, 500, 24 + k)] for k in range(20)]
    docs = []
    for k, words in enumerate(items):
        copy = list(words)
        copy[step - 1 :: step] = [f"new{k}x{j}" for j in range(len(copy[step - 1 :: step]))]
        docs.append((k, " ".join(["before"] * 30 + copy + ["after"] * 30)))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, k) for k in range(20)}


def test_every_ngram_that_occurs_is_a_seed():
    block = decontam.ItemBlock([(0, "a b c d e f g h")], 3)
    count = np.array([0, 0, 9, 7, 0, 5])
    assert sorted(o for at in block.seeds(count).values() for _, o in at) == [2, 3, 5]


def test_bound_is_not_below_the_score():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item = tuple(bytes([65 + c]) for c in rng.integers(0, 6, rng.integers(1, 12)))
        window = [bytes([65 + c]) for c in rng.integers(0, 9, rng.integers(1, 20))]
        assert decontam.bound(decontam.Counter(item), window) >= decontam.align(item, [window])[0]

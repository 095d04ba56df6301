"""Quality scores from a sparse rule ensemble.

A forest of shallow trees is grown on text statistics; every path from a root is a conjunctive rule.
A logistic model with a lasso penalty weighs the rules, and those that keep a weight are compiled
into one Spark column expression over the statistics. Both fits run on Spark over all labelled
training rows, dealt by id over a fixed number of partitions, a parameter, so that the model depends on the
rows alone: not on files, settings or the order of tasks. Statistics count characters and words of the whole text and never see labels, ids,
languages or sources.

Defined cases: null texts are empty, and empty texts have statistics of zero and are scored. Labels
that repeat are averaged, null labels left out. With no or only one kind of label the score is
their smoothed mean. Repeated rows are each scored; an empty table gives an empty table.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm.scratch import write_table

STATS = (
    "log_bytes",
    "log_words",
    "mean_word",
    "log_longest_word",
    "upper_share",
    "digit_share",
    "symbol_share",
    "pipe_share",
    "bang_share",
    "stop_share",
    "comma_share",
    "other_share",
    "line_share",
    "distinct_words",
    "distinct_lines",
    "repeated_next",
    "upper_words",
    "words_a_stop",
)
_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\/_=+`", b"|", b"!", b".?", b",;:", b"\n")):
    _CLASS[list(_chars), _i] = 1


def statistics_of(text: str | None) -> list[float]:
    """STATS of one text."""
    b = (text or "").encode("utf-8", "replace")
    words, lines = b.split(), b.splitlines()
    if not words:
        return [float(np.log1p(len(b)))] + [0.0] * (len(STATS) - 1)
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    upper, digit, symbol, pipe, bang, stop, comma, line = (count @ _CLASS).tolist()
    solid = sum(map(len, words))
    n = len(words)
    return [
        float(np.log1p(len(b))),
        float(np.log1p(n)),
        solid / n,
        float(np.log1p(max(map(len, words)))),
        upper / solid,
        digit / solid,
        symbol / solid,
        pipe / solid,
        bang / solid,
        stop / solid,
        comma / solid,
        float(count[128:].sum()) / solid,
        line / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        n / (1 + stop),
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t) for t in text], columns=list(STATS), dtype=float)


Condition = tuple[int, bool, float]  # statistic, whether above, threshold
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """``intercept`` and the rules that the lasso kept, with their weights."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(stats, rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [" and ".join(f"{STATS[f]} {'>' if above else '<='} {t:.6g}" for f, above, t in rule) + f": {w:+.4f}" for rule, w in self.rules]


def rule_column(stats: Column, rule: Rule) -> Column:
    out = F.lit(True)
    for feature, above, threshold in rule:
        value = stats[STATS[feature]]
        out = out & ((value > threshold) if above else (value <= threshold))
    return out


def tree_rules(node, path: Rule = ()) -> Iterator[Rule]:
    """Every path of a tree, inner ones too; a statistic's conditions of one kind are reduced to the tightest."""
    if path:
        yield path
    if node.numDescendants() == 0:
        return
    split = node.split()
    f, t = int(split.featureIndex()), float(split.threshold())
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        kept = tuple(c for c in path if c[:2] != (f, above))
        yield from tree_rules(child, tuple(sorted((*kept, (f, above, t)))))


#: Partitions of the fits, and decimals of the kept weights: sums of tasks may differ in their last bits.
PARTS, DECIMALS = 8, 6


def fit(labelled: DataFrame, stats_col: str = "stats", label_col: str = "label", trees: int = 20, depth: int = 3, penalty: float = 0.0005, seed: int = 17) -> RuleEnsemble:
    """Fit on all rows of ``labelled`` (stats, label 0 or 1)."""
    counts = {r[label_col]: r["count"] for r in labelled.groupBy(label_col).count().collect()}
    ones, total = counts.get(1.0, 0), sum(counts.values())
    if not ones or ones == total:
        p = (ones + 1) / (total + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    stats = F.col(stats_col)
    rows = labelled.select(F.col(stats_col), F.col(label_col).alias("label"), array_to_vector(F.array(*[stats[s] for s in STATS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=seed).fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"))})
    held = rows.select("label", array_to_vector(F.array(*[rule_column(stats, r).cast("double") for r in rules])).alias("features")) if rules else None
    if held is None:
        p = ones / total
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray().round(DECIMALS), strict=True) if w)
    return RuleEnsemble(round(float(lasso.intercept), DECIMALS), kept)


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", parts: int = PARTS, **options) -> RuleEnsemble:
    """Fit on the rows of ``stats`` (id, stats) that have a label and aren't held out.

    Trees draw rows by partition and place, so the rows are dealt by id over ``parts`` partitions and sorted
    before each fit, whatever the session's own number is; raise ``parts`` with the labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    rows = stats.where(~held_out(id_col)).join(known, id_col).select(F.col(id_col).alias("_id"), "stats", "label")
    rows = write_table(rows, "labelled")
    return fit(rows.repartition(parts, "_id").sortWithinPartitions("_id", "stats"), **options)


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, RuleEnsemble]:
    """(id, stats, held_out, score, predicted) a row of ``docs``, and the model."""
    stats = write_table(docs.select(id_col, statistics(F.col(text_col)).alias("stats")), "stats")
    model = train(stats, labels, label_col, id_col, **options)
    scored = stats.select(id_col, "stats", held_out(id_col).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model

"""Verification of a release against expectations and against its source."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[^A-Za-z0-9@.'\-]+"
# Shapes of what each action may leave in a cell.
SHAPES = {"cap_age_90": r"^(90\+|[0-8]?[0-9])$", "year_only": r"^\d{4}$", "zip3_truncate": r"^\d{3}$", "hash": r"^[0-9a-f]{16}$", "pseudonymize": r"^P[0-9a-f]{8}$"}


def shape_verdicts(df: DataFrame, actions: Mapping[str, str]) -> DataFrame:
    """(column, ok): whether every non-empty cell has its action's shape; dropped columns must be empty."""
    checks = []
    for c, action in actions.items():
        cell = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        if action == "drop":
            good = cell == ""
        elif action in SHAPES:
            good = (cell == "") | cell.rlike(SHAPES[action])
        else:
            continue
        checks.append(F.struct(F.lit(c).alias("column"), F.bool_and(good).alias("ok")))
    one = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(checks))])).alias("c")).select("c.column", F.coalesce("c.ok", F.lit(True)).alias("ok"))


def compare_rows(source: DataFrame, written: DataFrame, row_no: str, columns: Sequence[str]) -> DataFrame:
    """Rows that differ or exist on one side only, joined on an explicit row number."""
    a = source.select(F.col(row_no), F.struct(*columns).alias("a"))
    b = written.select(F.col(row_no), F.struct(*columns).alias("b"))
    return a.join(b, row_no, "full_outer").where("not (a <=> b)")


def pseudonym_faults(pairs: DataFrame, source: str, token: str) -> DataFrame:
    """(fault, value, n): sources with more than one token, tokens with more than one source."""
    both = pairs.select(source, token).distinct()
    split = both.groupBy(F.col(source).alias("value")).count().where("count > 1").select(F.lit("split").alias("fault"), "value", F.col("count").alias("n"))
    merged = both.groupBy(F.col(token).alias("value")).count().where("count > 1").select(F.lit("collision").alias("fault"), "value", F.col("count").alias("n"))
    return split.unionByName(merged)


#: A set of so many short literals or passages is sent to all tasks; a larger one meets the cells by a shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leak_tokens(cells: DataFrame, cell_id: str, text: str, literals: DataFrame, literal: str, least: int = 4, most: int = 256) -> DataFrame:
    """(cell id, literal): literals of one token that a cell holds, by an equi-join on distinct tokens.

    Literals have ``least`` to ``most`` characters, so a set below ``BROADCAST_ROWS`` has a bounded size.
    """
    words = cells.select(F.col(cell_id).alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), TOKEN))).alias("token")).where(F.length("token") >= least)
    wanted = literals.select(F.lower(F.col(literal)).alias("token")).where(~F.col("token").rlike(TOKEN) & F.length("token").between(least, most)).distinct()
    return words.join(_small(wanted), "token").select("id", F.col("token").alias("literal"))


def leak_passages(cells: DataFrame, cell_id: str, text: str, passages: DataFrame, passage: str, block: int = 50_000) -> DataFrame:
    """(cell id, passage): passages that a cell contains, lower-cased.

    Cells and passages meet by the longest word inside the passage; ids and words travel alone, and
    the texts of ids that met are searched. Passages without an inner word are searched by one pass
    of an automaton over the texts for every ``block`` of them.
    """
    wanted = passages.select(F.lower(F.col(passage)).alias("passage")).where("length(passage) > 0").distinct()
    tokens = F.split("passage", r"\s+")
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))  # the ends may cut a word
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = wanted.withColumn("key", key)
    base = cells.select(F.col(cell_id).alias("id"), F.lower(F.col(text)).alias("text"))
    words = base.select("id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key"))
    met = words.join(_small(wanted.where("key is not null").select(F.xxhash64("passage").alias("no"), "key")), "key").select("id", "no").distinct()
    met = met.join(wanted.select(F.xxhash64("passage").alias("no"), "passage"), "no").select(F.col("id").alias("_id"), "passage")
    out = base.join(met.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id"))).where(F.col("text").contains(F.col("passage"))).select("id", "passage")
    short = wanted.where("key is null").select("passage")
    kind = base.schema["id"].dataType.simpleString()
    for i in range(-(-short.count() // block)):
        part = [r["passage"] for r in short.orderBy("passage").offset(i * block).limit(block).collect()]

        def search(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            found = ahocorasick.Automaton()
            for p in part:
                found.add_word(p, p)
            found.make_automaton()
            for b in batches:
                hits = [(id_, p) for id_, t in zip(b["id"], b["text"], strict=True) if t for p in {p for _, p in found.iter(t)}]
                yield pd.DataFrame(hits, columns=["id", "passage"])

        out = out.unionByName(base.mapInPandas(search, f"id {kind}, passage string"))
    return out.distinct()


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def confusion(df: DataFrame, by: Sequence[str], expected: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy by group; empty denominators give 1, 1, 0 and 1."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = df.groupBy(*by).agg(
        count(expected & predicted).alias("tp"), count(~expected & predicted).alias("fp"), count(expected & ~predicted).alias("fn"), count(~expected & ~predicted).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        out.withColumn("precision", F.round(ratio(tp, tp + fp, 1.0), 6))
        .withColumn("recall", F.round(ratio(tp, tp + fn, 1.0), 6))
        .withColumn("f1", F.round(ratio(2.0 * tp, 2 * tp + fp + fn, 0.0), 6))
        .withColumn("accuracy", F.round(ratio(tp + tn, tp + fp + fn + tn, 1.0), 6))
    )


def first_planted(planted: DataFrame, keys: Sequence[str], row_no: str) -> DataFrame:
    """The first planted cell of each column; the rank limits rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(row_no)
    return planted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def check_expectation(kind: Column, cell: Column, literal: Column, pattern: Column, must: Column | None = None, must_not: Column | None = None) -> Column:
    """Whether an exported cell is as expected, trailing space and one leading quote aside.

    Scrubbed texts must hold all of ``must`` and none of ``must_not``, arrays of text.
    """
    c = F.regexp_replace(F.regexp_replace(cell, r"\s+$", ""), "^'", "")
    return F.when(kind == "literal", c == literal).when(kind == "regex", F.regexp_like(c, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))).when(kind == "human_review", c == "[HUMAN_REVIEW_PENDING]").when(
        kind == "text_scrub",
        (F.forall(must, lambda m: F.contains(c, m)) if must is not None else F.lit(True)) & (F.forall(must_not, lambda m: ~F.contains(c, m)) if must_not is not None else F.lit(True)),
    )


def calibration(df: DataFrame, confidence: Column, correct: Column, edges: Sequence[float] = (0.0, 0.5, 0.8, 0.95, 1.0)) -> DataFrame:
    """(bucket, n, accuracy) of every half-open bucket, the last one closed; 1 where it is empty."""
    spark = df.sparkSession
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        top = confidence <= edges[i + 1] if i == len(edges) - 2 else confidence < edges[i + 1]
        bucket = F.when((confidence >= edges[i]) & top, i).otherwise(bucket)
    sums = df.select(bucket.alias("bucket"), correct.cast("long").alias("ok")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(sums, "bucket", "left")
    return joined.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.col("ok") / F.col("n"), F.lit(1.0)), 6).alias("accuracy"))


def regulation_coverage(planted: DataFrame, leaked: DataFrame, violated: DataFrame) -> DataFrame:
    """(key, planted, neutralised): plant ids by regulation key, without those that leaked or were violated."""
    each = planted.select("plant_id", F.explode("keys").alias("key"))
    good = each.join(leaked.select("plant_id"), "plant_id", "left_anti").join(violated.select("plant_id"), "plant_id", "left_anti").select("plant_id", F.lit(1).alias("good"))
    joined = each.join(good.distinct(), "plant_id", "left")
    return joined.groupBy("key").agg(F.count_distinct("plant_id").alias("planted"), F.count_distinct(F.when(F.col("good") == 1, F.col("plant_id"))).alias("neutralised"))

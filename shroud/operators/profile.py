"""Column profiles in one pass: counts and shapes, never values, but for closed categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions import dates, numeric
from shroud.functions.patterns import BLOCKING, WARN


def unpivot_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value) of every cell as text."""
    names = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = 10) -> DataFrame:
    """Non-empty and distinct cells, hits and shapes a column.

    Cells first group by (column, value), which combines before the shuffle and makes the distinct
    count exact; only patterns of distinct values are tested.
    """
    cells = unpivot_text(df, columns).withColumn("value", numeric.strip(F.col("value"))).where("value <> ''")
    values = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    any_of = lambda patterns: F.greatest(*[F.col("value").rlike(p.regex).cast("int") for p in patterns], F.lit(0))
    tested = values.select("column", "n", "value", any_of(BLOCKING).alias("b"), any_of(WARN).alias("w"), dates.looks_like_date(F.col("value")).cast("int").alias("d"), numeric.coerce_numeric(F.col("value")).isNotNull().cast("int").alias("x"))
    total = lambda c: F.sum(F.col("n") * F.col(c))
    out = tested.groupBy("column").agg(
        F.sum("n").alias("non_empty"), F.count(F.lit(1)).alias("distinct"), total("b").alias("blocking_hits"), total("w").alias("warn_hits"), total("d").alias("date_shaped"), total("x").alias("numeric")
    )
    out = out.withColumn("closed_categorical", (F.col("distinct") <= max_categories) & (F.col("blocking_hits") == 0))
    return out.withColumn("value_conflict", (F.col("blocking_hits") > 0.5 * F.col("non_empty")) | (F.col("date_shaped") > 0.5 * F.col("non_empty")))


def categories(df: DataFrame, column: str, most: int = 10) -> list[str]:
    """Sorted values of a closed column; empty if it has more than ``most``."""
    rows = df.select(numeric.strip(F.col(column).cast("string")).alias("v")).where("v <> ''").distinct().limit(most + 1).collect()
    return sorted(r["v"] for r in rows) if len(rows) <= most else []


def column_stats(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, rows, distinct); an empty cell is a value, null counts as empty."""
    cells = unpivot_text(df, columns).withColumn("value", F.coalesce("value", F.lit("")))
    distinct = F.approx_count_distinct("value") if approximate else F.count_distinct("value")
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), distinct.alias("distinct"))

"""Decisions: the latest one, exact coverage, overrides, durations and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; the rank limits rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coverage_faults(columns: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fault): columns without a decision, decisions without a column, columns decided twice."""
    keys = list(keys)
    missing = columns.select(*keys).distinct().join(decisions, keys, "left_anti").withColumn("fault", F.lit("missing"))
    invented = decisions.select(*keys).distinct().join(columns, keys, "left_anti").withColumn("fault", F.lit("invented"))
    twice = decisions.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("fault"))
    return missing.unionByName(invented).unionByName(twice)


def overridden(classified: DataFrame, reviews: DataFrame) -> DataFrame:
    """Actions after review: a review of the header, whatever its case, replaces the action."""
    r = reviews.select(F.upper("header").alias("_h"), F.col("action").alias("_a"))
    joined = classified.join(r, F.upper(F.col("header")) == F.col("_h"), "left")
    return joined.withColumn("action", F.coalesce("_a", "action")).drop("_h", "_a")


def durations(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Seconds from each event to the key's next one; null for the last."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("seconds", F.unix_seconds(following.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")))


def sliding_counts(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """How many of the key's events fall in the ``seconds`` up to each event."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("hits", F.count(F.lit(1)).over(w))


def unique_names(df: DataFrame, stem: str, order: str) -> DataFrame:
    """Names made unique: the second of a stem gets ``__2`` and so on."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return df.withColumn("name", F.when(n == 1, F.col(stem)).otherwise(F.concat_ws("__", F.col(stem), n.cast("string"))))


def blocked_attempts(df: DataFrame, keys: Sequence[str], order: str, limit: int = 3) -> DataFrame:
    """Running number of blocking verdicts a column and whether it now needs a human."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("blocked").cast("int")).over(w)
    return df.withColumn("attempts", n).withColumn("escalate", n >= limit)

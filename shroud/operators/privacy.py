"""Anonymity of a release: k-anonymity, l-diversity, small cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def with_null_sentinel(df: DataFrame, columns: Sequence[str], sentinel: str = "<NULL>") -> DataFrame:
    """Null and blank cells as one value."""
    cell = lambda c: F.trim(F.col(c).cast("string"))
    return df.withColumns({c: F.when(F.col(c).isNull() | (cell(c) == ""), F.lit(sentinel)).otherwise(F.col(c).cast("string")) for c in columns})


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """Classes of equal quasi-identifiers with fewer than ``k`` rows; nulls are equal to each other."""
    classes = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("size"))
    return classes.where(F.col("size") < k).select(class_key(quasi).alias("class"), "size")


def smallest_class(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """One row: k, and the number of classes; k is 0 for no rows."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("size")).agg(F.coalesce(F.min("size"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("classes"))


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], least: int = 2) -> DataFrame:
    """(attribute, class, values) of classes with fewer than ``least`` values of a sensitive attribute; null is a value."""
    counts = [(F.count_distinct(s) + F.max(F.col(s).isNull().cast("int"))).alias(f"_n{i}") for i, s in enumerate(sensitive)]
    classes = df.groupBy(*quasi).agg(*counts)
    each = F.array(*[F.struct(F.lit(s).alias("attribute"), F.col(f"_n{i}").cast("long").alias("values")) for i, s in enumerate(sensitive)])
    return classes.select(class_key(quasi).alias("class"), F.explode(each).alias("e")).select("e.attribute", "class", "e.values").where(F.col("values") < least)

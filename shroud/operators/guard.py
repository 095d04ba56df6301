"""Guards over a release: residual identifiers by cell, line or text, with capped reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.patterns import BLOCKING, GUARD_US, SUBJECT_ID, WARN, Pattern, fires, is_hit
from shroud.functions.text import mask_sample, opaque_token

#: What ends a line of text: also form feeds, separators and next-line characters.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def hit_flags(text: Column, patterns: Sequence[Pattern] = BLOCKING) -> list[Column]:
    """One boolean a pattern."""
    return [is_hit(p, text).alias(p.name) for p in patterns]


def count_hits(df: DataFrame, text: Column, by: Sequence[str], patterns: Sequence[Pattern] = BLOCKING) -> DataFrame:
    """Rows with a hit of each pattern, by group, in one scan."""
    flags = [F.sum(is_hit(p, text).cast("long")).alias(p.name.lower()) for p in patterns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *flags)


def gate(df: DataFrame, text: Column, allowed: Column | None = None) -> DataFrame:
    """Rows with ``blocked`` and ``warned``: the names of patterns hit, sorted; warnings spare allowed texts."""
    names = lambda patterns: F.array_sort(F.array_compact(F.array(*[F.when(is_hit(p, text), F.lit(p.name)) for p in patterns])))
    warned = names(WARN)
    if allowed is not None:
        warned = F.when(allowed, F.array().cast("array<string>")).otherwise(warned)
    return df.withColumn("blocked", names(BLOCKING)).withColumn("warned", warned)


def tree_findings(df: DataFrame, date_columns: frozenset[str] = frozenset(), patterns: Sequence[Pattern] = BLOCKING + SUBJECT_ID) -> DataFrame:
    """(column, pattern) of string columns with any hit; date patterns spare columns whose dates are shifted."""
    checks = []
    for c, kind in df.dtypes:
        if kind != "string":
            continue
        for p in patterns:
            if not (p.name.startswith("DATE_") and c in date_columns):
                checks.append((c, p))
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, pattern string")
    hits = df.agg(*[F.bool_or(is_hit(p, F.col(f"`{c}`"))).alias(f"h{i}") for i, (c, p) in enumerate(checks)])
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p.name).alias("pattern"), F.col(f"h{i}").alias("hit")) for i, (c, p) in enumerate(checks)])
    return hits.select(F.explode(found).alias("f")).where("f.hit").select("f.column", "f.pattern")


def is_clean(df: DataFrame, **options) -> bool:
    return tree_findings(df, **options).isEmpty()


def cell_findings(df: DataFrame, file_col: str, categories: Mapping[str, str | None], patterns: Sequence[Pattern] = GUARD_US) -> DataFrame:
    """(file, column, pid, category, match) of every cell and pattern that fires in its column."""
    hits = [
        F.struct(F.lit(c).alias("column"), F.lit(p.name).alias("pid"), F.lit(p.category).alias("category"), fires(p, F.col(f"`{c}`").cast("string"), category).alias("match"))
        for c, category in categories.items()
        for p in patterns
    ]
    found = F.filter(F.array(*hits), lambda h: h["match"].isNotNull())
    return df.select(F.col(file_col).alias("file"), F.explode(found).alias("f")).select("file", "f.column", "f.pid", "f.category", "f.match")


def line_findings(df: DataFrame, file_col: str, text_col: str, patterns: Sequence[Pattern] = GUARD_US) -> DataFrame:
    """(file, line, pid, category, match) of texts, line by line, without a column's context."""
    lines = df.select(F.col(file_col).alias("file"), F.posexplode(F.split(text_col, LINES)).alias("line", "cell"))
    hits = [F.struct(F.lit(p.name).alias("pid"), F.lit(p.category).alias("category"), fires(p, F.col("cell"), None).alias("match")) for p in patterns]
    found = F.filter(F.array(*hits), lambda h: h["match"].isNotNull())
    return lines.select("file", (F.col("line") + 1).alias("line"), F.explode(found).alias("f")).select("file", "line", "f.pid", "f.category", "f.match")


def top_findings(findings: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` distinct (pid, match) of each file, by pid and match, masked.

    The rank limits each file's rows before the shuffle.
    """
    distinct = findings.select("file", "pid", "match").distinct()
    rank = F.row_number().over(Window.partitionBy("file").orderBy("pid", "match"))
    return distinct.withColumn("n", rank).where(F.col("n") <= most).select("file", "pid", mask_sample(F.col("match")).alias("sample"), "n")


def export_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file, status, findings): clean or blocked, for every file scanned."""
    counts = findings.groupBy("file").agg(F.count(F.lit(1)).alias("findings"))
    joined = files.select("file").distinct().join(counts, "file", "left")
    n = F.coalesce("findings", F.lit(0))
    return joined.select("file", F.when(n > 0, "blocked").otherwise("clean").alias("status"), n.alias("findings"))


def name_findings(df: DataFrame, file_col: str, text_col: str, names: Sequence[str]) -> DataFrame:
    """Capitalised word pairs of which one is a listed name, but for generated tokens."""
    pairs = F.regexp_extract_all(F.col(text_col), F.lit(WARN[2].regex), F.lit(0))
    listed = F.array(*[F.lit(n.lower()) for n in names])
    found = df.select(F.col(file_col).alias("file"), F.explode(pairs).alias("match")).where(~opaque_token(F.col("match")))
    return found.where(F.arrays_overlap(F.split(F.lower("match"), r"\s+"), listed))

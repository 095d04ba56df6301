"""Reading and writing tables, texts and packages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.functions.numeric import is_blank
from shroud.operators.shaping import as_text

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Cells as text, none inferred as missing; rows that do not parse are in ``read_csv_rejects``."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return as_text(reader.csv(path))


def read_csv_rejects(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Lines with another number of cells than ``columns``."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), f"{CORRUPT} string"])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    # all cells must be parsed for one too many to show, and Spark does not read rejected lines alone: a cell is read, nothing of it kept
    line = F.concat(F.substring(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), 1, 0), F.col(CORRUPT))
    return rows.where(F.col(CORRUPT).isNotNull()).select(line.alias(CORRUPT))


def read_jsonl(spark: SparkSession, path: str, strict: bool = False, schema: str | None = None) -> DataFrame:
    """One object a line, scalars as text; lenient reading skips what is no object."""
    reader = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """csv, tsv, jsonl or parquet as text cells."""
    if extension in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if extension == "tsv" else ",")
    if extension in ("json", "jsonl"):
        return as_text(read_jsonl(spark, path))
    if extension == "parquet":
        return as_text(spark.read.parquet(path))
    raise ValueError(f"unsupported extension {extension!r}")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def discover(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """(path, bytes, modified) of files with one of the extensions, hidden ones aside, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*[e.lower() for e in extensions])).orderBy("path")


# Extensions of a package's components.
COMPONENTS: Mapping[str, tuple[str, ...]] = {"datasets": ("csv", "tsv", "xlsx", "xls", "parquet", "jsonl"), "dictionary_mapping": ("csv", "xlsx", "xls", "docx", "pdf"), "forms": ("pdf", "docx", "xlsx")}


def classify_package(files: DataFrame) -> DataFrame:
    """Files with ``component``: the first folder named like one, if the extension suits; else null, which blocks."""
    parts = F.split(F.lower("path"), "/")
    ext = F.element_at(F.split(F.element_at(parts, -1), r"\."), -1)
    component = F.lit(None).cast("string")
    for name, extensions in COMPONENTS.items():
        component = F.when(F.array_contains(parts, name) & ext.isin(*extensions), name).otherwise(component)
    return files.withColumn("component", component)


def package_faults(files: DataFrame, max_files: int = 4096, max_bytes: int = 4 << 30) -> DataFrame:
    """Faults of a classified package: no datasets, neither forms nor dictionary, unclassified files, too many or too large."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = files.agg(
        n(F.col("component") == "datasets").alias("d"),
        n(F.col("component").isin("forms", "dictionary_mapping")).alias("s"),
        n(F.col("component").isNull()).alias("u"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"),
    )
    faults = {"no_datasets": F.col("d") == 0, "no_support": F.col("s") == 0, "unclassified": F.col("u") > 0, "too_many_files": F.col("n") > max_files, "too_large": F.col("b") > max_bytes}
    return one.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]))).alias("fault"))


def first_rows(df: DataFrame, row_no: Column, n: int = 5000) -> DataFrame:
    """The first ``n`` rows that have a cell, in the order of ``row_no``; a bounded look, which is its feature."""
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | ~is_blank(F.col(f"`{c}`").cast("string"))
    return df.where(filled).orderBy(row_no).limit(n)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, without null fields; the committer publishes all or nothing."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, header: str, path: str, mode: str = "overwrite") -> None:
    """Lines as they are, a header ahead of those of each file; no task holds more than it reads. Lines hold no U+0001 and no line breaks."""
    lines.toDF(header).write.mode(mode).option("header", True).option("sep", "\u0001").option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_split(kept: DataFrame, quarantine: DataFrame, path: str, strict: bool = False) -> int:
    """Kept rows and, by reason, quarantined ones; returns how many were held and raises on any if strict."""
    write_jsonl(kept, f"{path}/kept")
    quarantine.write.mode("overwrite").partitionBy("reason").json(f"{path}/quarantine")
    held = kept.sparkSession.read.schema(quarantine.schema).json(f"{path}/quarantine").count()
    if strict and held:
        raise ValueError(f"{held} rows were quarantined")
    return held

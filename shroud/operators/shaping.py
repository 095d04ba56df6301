"""Shapes of tables: long and wide cells, blank-row segments, header promotion, value maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.numeric import is_blank, strip


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, nulls as empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables by name, columns in the order first seen, absent cells empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return as_text(out)


def to_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column_index, value) of every cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.column_index", "c.value")


def to_cell_map(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cells: map of column index to text)."""
    pairs = F.collect_list(F.struct("column_index", "value"))
    return cells.groupBy(*keys).agg(F.map_from_entries(pairs).alias("cells"))


def blank_row_segments(df: DataFrame, group: str, row_no: str, columns: Sequence[str]) -> DataFrame:
    """Non-blank rows with ``segment``: runs between blank rows, numbered from 1 within ``group`` (a sheet)."""
    blank = F.lit(True)
    for c in columns:
        blank = blank & is_blank(F.col(f"`{c}`").cast("string"))
    w = Window.partitionBy(group).orderBy(row_no)
    marked = df.withColumn("_blank", blank).withColumn("_start", (~F.col("_blank") & F.coalesce(F.lag("_blank").over(w), F.lit(True))).cast("int"))
    return marked.withColumn("segment", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not _blank").drop("_blank", "_start")


def sheet_blocks(cells: DataFrame, sheet: str = "sheet", row: str = "row_no", column: str = "column_index", value: str = "value", strips: bool = True) -> DataFrame:
    """(sheet, table, row, column, value): the tables of sheets of long cells, numbered from 1 by strip and place.

    A sheet falls into strips between blank rows, and a strip into blocks between columns that are blank in all of
    it; ``strips``: else a sheet is one strip. Rows of a block without a cell of its own are left out. Blank cells
    of the input say nothing, so sheets may be sparse; cells without a row or column have no place and are left out.
    Cells are shuffled once, by sheet, and sorted by row, by column and by table and row; a sheet is one task's,
    which spills where it is large. Tasks are as many as ``spark.sql.shuffle.partitions`` says, as a task keeps
    several sorts and cells compress too well for their size to tell.
    """
    cells = cells.select(F.col(sheet).alias("sheet"), F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("string").alias("value"))
    full = cells.where(~is_blank(F.col("value")) & F.col("r").isNotNull() & F.col("c").isNotNull()).repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sheet")
    strip = F.col("r") - F.dense_rank().over(Window.partitionBy("sheet").orderBy("r")) if strips else F.lit(0)
    by_column = Window.partitionBy("sheet").orderBy("strip", "c")
    so_far = by_column.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(F.struct("strip", "c")).over(by_column)
    starts = before.isNull() | (before["strip"] != F.col("strip")) | (F.col("c") - before["c"] > 1)
    marked = full.withColumn("strip", strip).withColumn("left", F.when(starts, F.col("c")))
    placed = marked.select("sheet", "r", "c", "value", F.count("left").over(so_far).cast("int").alias("table"), F.last("left", True).over(so_far).alias("left"))
    at = F.dense_rank().over(Window.partitionBy("sheet", "table").orderBy("r"))
    return placed.select("sheet", "table", at.alias("row"), (F.col("c") - F.col("left")).alias("column"), "value")


def promote_header(df: DataFrame, row_no: str, columns: Sequence[str], footer: str | None = None) -> DataFrame:
    """The first row with more than one value names the columns, rows before it and footers go; else the first row."""
    filled = sum((~is_blank(F.col(f"`{c}`").cast("string"))).cast("int") for c in columns)
    first = df.withColumn("_filled", filled).agg(F.coalesce(F.min(F.when(F.col("_filled") > 1, F.col(row_no))), F.min(row_no)).alias("at")).first()["at"]
    head = df.where(F.col(row_no) == first).select(*columns).first()
    names = [str(v).strip() if v is not None and str(v).strip() else f"Unnamed: {i}" for i, v in enumerate(head or columns)]
    body = df.where(F.col(row_no) > first) if first is not None else df
    body = body.withColumn("_filled", filled).where("_filled > 0").drop("_filled")
    if footer:
        lead = F.coalesce(*[F.when(~is_blank(F.col(f"`{c}`").cast("string")), F.col(f"`{c}`").cast("string")) for c in columns])
        body = body.where(~lead.startswith(footer))
    return body.select(row_no, *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])


def value_map(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, label) of a code list; no rows at all if a code has two labels."""
    pairs = df.select(strip(F.col(code)).alias("code"), strip(F.col(label)).alias("label")).where("code <> '' and label <> ''").distinct()
    clash = pairs.groupBy("code").count().where("count > 1").limit(1)
    return pairs.join(clash.select(F.lit(1).alias("_one")), F.lit(True), "left_anti")


def headers_table(df: DataFrame, artifact: str, sha: str) -> DataFrame:
    """(header_id, column_index, raw_name, normalized_name) of a table's columns."""
    from shroud.functions.hashing import header_id
    from shroud.functions.text import normalize_header

    rows = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "column_index int, raw_name string")
    return rows.select(header_id(F.lit(artifact), F.lit(sha), F.col("column_index")).alias("header_id"), "column_index", "raw_name", normalize_header(F.col("raw_name")).alias("normalized_name"))


def match_headers(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """(raw_name, artifact): headers that a support table's cell names exactly, after normalising."""
    from shroud.functions.text import normalize_header

    values = cells.select("artifact", normalize_header(F.col("value")).alias("normalized_name")).where("normalized_name <> ''").distinct()
    return headers.join(values, "normalized_name").select("raw_name", "artifact").distinct()


def match_forms(datasets: DataFrame, forms: DataFrame) -> DataFrame:
    """Dataset to form by stem, else by leading code where one form has it; null where neither."""
    code = lambda c: F.regexp_extract(c, r"^([a-z]+[0-9]*)", 1)
    by_stem = forms.select(F.col("stem"), F.col("form").alias("_by_stem"))
    single = forms.groupBy(code(F.col("stem")).alias("_code")).agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("_by_code")).where("n = 1").drop("n")
    joined = datasets.join(by_stem, "stem", "left").withColumn("_code", code(F.col("stem"))).join(single, "_code", "left")
    return joined.select("dataset", "stem", F.coalesce("_by_stem", "_by_code").alias("form"))

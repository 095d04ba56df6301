"""JSON of any shape: leaves by path, scans of leaves, and texts rebuilt after their leaves changed.

Documents are parsed to VARIANT. One pass finds how deep the deepest goes; the leaves are then a chain of so
many lateral explodes, in one stage. To rebuild, a document's leaves meet once by its number and are written
in their order: what closes and opens between two neighbours follows from their paths. Keys come sorted, as
VARIANT keeps them, so the rebuilt text is canonical.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.patterns import BLOCKING, SUBJECT_ID, Pattern, is_hit
from shroud.functions.persisted import scrub_persisted

# Keys whose texts identify records of the audit itself and stay.
AUDIT_KEYS = ("reviewer", "reviewed_at", "session_review", "id", "session_id", "file_id", "ts", "updated_at", "created_at")
# Date patterns that a dictionary's help texts may hold.
DICTIONARY_DATES = ("DATE_ISO", "DATE_MDY")


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and no spaces; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")


def nesting(json: Column) -> Column:
    """How many containers lie within each other at most, of a canonical text."""
    bare = F.regexp_replace(F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


STEPS = "array<struct<pos: int, key: string>>"


def _walk(df: DataFrame, json: str) -> DataFrame:
    """``df`` a row a leaf, with ``_steps`` to it and ``_leaf``, its VARIANT; empty containers and texts that do not parse are leaves."""
    parsed = df.withColumn("_leaf", F.try_parse_json(F.col(json))).withColumn("_steps", F.array().cast(STEPS))
    depth = parsed.agg(F.max(nesting(F.to_json("_leaf")))).first()[0] or 0
    spark = df.sparkSession
    for _ in range(depth):
        grown = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("_leaf").outer()))
        inner = F.col("pos").isNotNull()
        steps = F.when(inner, F.concat("_steps", F.array(F.struct("pos", "key")))).otherwise(F.col("_steps"))
        parsed = grown.select(*df.columns, F.when(inner, F.col("value")).otherwise(F.col("_leaf")).alias("_leaf"), steps.alias("_steps"))
    return parsed


def path_text(steps: Column) -> Column:
    """Dotted path with list places in brackets."""
    parts = F.transform(steps, lambda s: F.when(s["key"].isNull(), F.concat(F.lit("["), s["pos"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["key"])))
    return F.regexp_replace(F.array_join(parts, ""), r"^\.", "")


def nearest_key(steps: Column) -> Column:
    """The key that a leaf stands under, also within lists; null at the top."""
    return F.try_element_at(F.filter(steps, lambda s: s["key"].isNotNull()), F.lit(-1))["key"]


def leaves(df: DataFrame, json: str, keys: Sequence[str]) -> DataFrame:
    """(keys, path, key, json, text) of every leaf; ``text`` is null unless the leaf is a string."""
    packed = df.select(F.struct(*keys).alias("_others") if keys else F.lit(None).alias("_others"), F.col(json).alias("_doc"))
    rows = _walk(packed, "_doc").withColumn("_json", F.to_json("_leaf"))
    text = F.when(F.col("_json").startswith('"'), F.col("_leaf").cast("string"))
    return rows.select(*[F.col(f"_others.`{k}`").alias(k) for k in keys], path_text(F.col("_steps")).alias("path"), nearest_key(F.col("_steps")).alias("key"), F.col("_json").alias("json"), text.alias("text"))


def _rebuilt(leaves: Column) -> Column:
    """The JSON text of a document's leaves (place, steps, json), which are in order."""
    name = lambda s: F.when(s["key"].isNull(), F.lit("")).otherwise(F.concat(quoted(s["key"]), F.lit(":")))
    opened = lambda s: F.when(s["key"].isNull(), F.lit("[")).otherwise(F.lit("{"))
    closed = lambda s: F.when(s["key"].isNull(), F.lit("]")).otherwise(F.lit("}"))
    closers = lambda steps, kept: F.array_join(F.reverse(F.transform(F.slice(steps, kept + 1, F.greatest(F.size(steps) - kept, F.lit(0))), closed)), "")

    def part(leaf: Column, i: Column) -> Column:
        steps, before = leaf["steps"], F.get(leaves, i - 1)["steps"]
        shared = F.array_position(F.zip_with(before, steps, lambda a, b: a["pos"].eqNullSafe(b["pos"])), F.lit(False)).cast("int") - 1
        deeper = F.transform(F.slice(steps, shared + 2, F.greatest(F.size(steps) - shared - 1, F.lit(0))), lambda s: F.concat(opened(s), name(s)))
        here = F.concat(closers(before, shared + 1), F.lit(","), name(F.get(steps, shared)), F.array_join(deeper, ""))
        first = F.array_join(F.transform(steps, lambda s: F.concat(opened(s), name(s))), "")
        return F.concat(F.when(i == 0, first).otherwise(here), leaf["json"])

    return F.concat(F.array_join(F.transform(leaves, part), ""), closers(F.element_at(leaves, -1)["steps"], F.lit(0)))


def change_leaves(df: DataFrame, json: str, change: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``df`` with its JSON column rebuilt after ``change(text, key, path)`` of every string leaf.

    Texts that do not parse become null. Other columns travel with a document's first leaf only.
    """
    others = [c for c in df.columns if c != json]
    rows = _walk(df.select(F.monotonically_increasing_id().alias("_record"), F.struct(*others).alias("_others") if others else F.lit(None).alias("_others"), F.col(json).alias("_doc")), "_doc")
    rows = rows.withColumn("_json", F.to_json("_leaf"))
    text, steps = F.col("_leaf").cast("string"), F.col("_steps")
    new = F.when(F.col("_json").startswith('"'), quoted(change(text, nearest_key(steps), path_text(steps)))).otherwise(F.col("_json"))
    first = ~F.exists(steps, lambda s: s["pos"] != 0)
    leaf = F.struct(F.transform(steps, lambda s: s["pos"]).alias("place"), steps.alias("steps"), new.alias("json"))
    whole = rows.groupBy("_record").agg(F.first(F.when(first, F.col("_others")), ignorenulls=True).alias("_others"), F.array_sort(F.collect_list(leaf)).alias("_leaves"))
    made = F.when(F.get("_leaves", F.lit(0))["json"].isNotNull(), _rebuilt(F.col("_leaves"))).alias(json)
    return whole.select(*[made if c == json else F.col(f"_others.`{c}`").alias(c) for c in df.columns])


def scrub_nested(df: DataFrame, json: str, keep: Sequence[str] = AUDIT_KEYS) -> DataFrame:
    """``df`` with identifiers replaced in every string of its JSON column, but under the keys to keep."""
    return change_leaves(df, json, lambda text, key, path: F.when(F.coalesce(key.isin(*keep), F.lit(False)), text).otherwise(scrub_persisted(text)))


def json_findings(df: DataFrame, json: str, keys: Sequence[str], date_columns: Sequence[str] = (), dictionary: Column | None = None, patterns: Sequence[Pattern] = BLOCKING + SUBJECT_ID) -> DataFrame:
    """(keys, path, column, pattern) of every string leaf and pattern that hits it; no values.

    Dates are spared in ``date_columns``, whose dates were moved, and in the time of extraction; where
    ``dictionary`` holds, the dates of help texts are spared too.
    """
    dictionary = F.lit(False) if dictionary is None else dictionary
    rows = leaves(df.withColumn("_dictionary", dictionary), json, [*keys, "_dictionary"]).where("text is not null")
    rows = rows.withColumn("column", F.regexp_extract(F.element_at(F.split("path", r"\."), -1), r"^[^\[]*", 0))
    spared = (F.col("column").isin(*date_columns) if date_columns else F.lit(False)) | ((F.col("column") == "extraction_utc") & F.col("path").startswith("_provenance."))
    hits = []
    for p in patterns:
        hit = is_hit(p, F.col("text"))
        if p.name.startswith("DATE_"):
            hit = hit & ~spared
        if p.name in DICTIONARY_DATES:
            hit = hit & ~F.col("_dictionary")
        hits.append(F.when(hit, F.lit(p.name)))
    return rows.select(*keys, "path", "column", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


def scrub_cells(df: DataFrame) -> DataFrame:
    """A dictionary table with identifiers replaced in every cell, all as text."""
    return df.select(*[scrub_persisted(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


#: How the second pass of the gate reads its patterns: letters in either case, lines one by one, a dot also for line ends.
SECOND_FLAGS = "(?ims)"


def gate_findings(df: DataFrame, json: str, keys: Sequence[str], date_columns: Sequence[str] = (), dictionary: Column | None = None) -> DataFrame:
    """(keys, path, column, pattern, pass) of the two passes over JSON leaves that a release must come through.

    The second reads the blocking patterns in either case; in ``date_columns`` it spares numeric dates only, so a date with
    a month's name there is found, where the first spares all dates.
    """
    first = json_findings(df, json, keys, date_columns, dictionary)
    loose = [Pattern(p.name, SECOND_FLAGS + p.regex) for p in BLOCKING]
    numeric, worded = [p for p in loose if p.name in DICTIONARY_DATES], [p for p in loose if p.name not in DICTIONARY_DATES]
    second = json_findings(df, json, keys, date_columns, dictionary, numeric).unionByName(json_findings(df, json, keys, (), dictionary, worded))
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))


def gate_verdicts(df: DataFrame, json: str, keys: Sequence[str], date_columns: Sequence[str] = (), dictionary: Column | None = None) -> DataFrame:
    """(keys, passed): a document comes through where neither pass finds anything."""
    found = gate_findings(df, json, keys, date_columns, dictionary).select(*keys).distinct().withColumn("_found", F.lit(True))
    return df.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.col("_found").isNull().alias("passed"))

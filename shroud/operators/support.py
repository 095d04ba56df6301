"""Evidence from support files: which dictionaries belong to which columns, and the code maps that follow from them.

A dictionary belongs to a data set where one of its cells is, after normalising, the name of a column. Each link
has a basis, the digest of all that it rests on, and a decision holds for a link only while the basis is the one
it was made on. Code maps come from eligible links alone, and only where all evidence agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.text import normalize_header
from shroud.operators.digest_tree import record

EXACT, STEM = "exact_header_match", "same_stem_companion"
KEYS = ["dataset", "artifact"]


def _hits(headers: DataFrame, cells: DataFrame) -> DataFrame:
    names = headers.withColumn("_name", normalize_header(F.col("raw_name"))).where("_name <> ''")
    values = cells.select("artifact", "row", "column", normalize_header(F.col("value")).alias("_name")).where("_name <> ''")
    return names.join(values, "_name")


def dictionary_links(headers: DataFrame, cells: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(link_id, dataset, artifact, reason, level, header_ids, basis) of ``headers`` (dataset, dataset_sha, header_id, raw_name),
    ``cells`` (artifact, row, column, value) and ``artifacts`` (artifact, artifact_sha)."""
    ids = F.array_sort(F.collect_set("header_id")).alias("header_ids")
    found = _hits(headers, cells).groupBy(*KEYS).agg(F.min("dataset_sha").alias("dataset_sha"), ids).join(artifacts, "artifact")
    return _linked(found, EXACT, "helpful")


def companion_links(datasets: DataFrame, forms: DataFrame) -> DataFrame:
    """The same for ``datasets`` (dataset, dataset_sha, stem) and ``forms`` (artifact, artifact_sha, stem): a form of the data set's
    stem, else the only one of its leading code; these are needed."""
    code = lambda c: F.regexp_extract(c, r"^([a-z]+[0-9]*)", 1)
    by_stem = datasets.join(forms, "stem").select("dataset", "dataset_sha", "artifact", "artifact_sha")
    single = forms.groupBy(code(F.col("stem")).alias("_code")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("artifact", "artifact_sha")).alias("f")).where("_n = 1 and _code <> ''")
    rest = datasets.join(by_stem.select("dataset").distinct(), "dataset", "left_anti").withColumn("_code", code(F.col("stem")))
    by_code = rest.join(single, "_code").select("dataset", "dataset_sha", "f.artifact", "f.artifact_sha")
    return _linked(by_stem.unionByName(by_code).withColumn("header_ids", F.array().cast("array<string>")), STEM, "required")


def _linked(found: DataFrame, reason: str, level: str) -> DataFrame:
    basis = record([F.col("dataset"), F.col("dataset_sha"), F.col("artifact"), F.col("artifact_sha"), F.lit(reason), F.array_join("header_ids", ",")])
    link = record([F.col("dataset"), F.col("artifact"), F.lit(reason)])
    return found.select(link.alias("link_id"), *KEYS, F.lit(reason).alias("reason"), F.lit(level).alias("level"), "header_ids", basis.alias("basis"))


def decided(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """``links`` with ``current``, whether a decision (link_id, basis, level) still holds, ``decided``, its level, and ``eligible``.

    Without a decision that holds, an exact match that is only helpful is eligible, and nothing else is.
    """
    made = decisions.select("link_id", F.col("basis").alias("_basis"), F.col("level").alias("decided")).dropDuplicates(["link_id", "_basis"])
    met = links.join(made, (links["link_id"] == made["link_id"]) & (links["basis"] == made["_basis"]), "left").drop(made["link_id"]).drop("_basis")
    current = F.col("decided").isNotNull()
    eligible = F.when(current, F.col("decided").isin("required", "helpful")).otherwise((F.col("level") == "helpful") & (F.col("reason") == EXACT))
    return met.withColumn("current", current).withColumn("eligible", eligible)


def stale(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose link is gone or rests on something else now."""
    return decisions.join(links.select("link_id", "basis"), ["link_id", "basis"], "left_anti")


def code_entries(links: DataFrame, headers: DataFrame, cells: DataFrame) -> DataFrame:
    """(dataset, artifact, header_id, map_name, code, label) of eligible links to ``headers``, whose columns are to be generalised.

    The first column of a dictionary that names the header is the naming one; the first two others of the rows
    that name it are code and label. A header with two labels for a code in a dictionary has none there.
    """
    usable = links.where("eligible").select("dataset", "artifact", F.explode("header_ids").alias("header_id"))
    hits = _hits(headers.select("dataset", "header_id", "raw_name"), cells).join(usable, [*KEYS, "header_id"])
    naming = hits.groupBy(*KEYS, "header_id").agg(F.min("column").alias("_naming"))
    widths = cells.groupBy("artifact").agg(F.array_sort(F.collect_set("column")).alias("_columns"))
    plan = naming.join(widths, "artifact").withColumn("_others", F.filter("_columns", lambda c: c != F.col("_naming"))).where(F.size("_others") >= 2)
    plan = plan.select(*KEYS, "header_id", "_naming", F.get("_others", F.lit(0)).alias("_code"), F.get("_others", F.lit(1)).alias("_label"))
    rows = hits.join(plan, [*KEYS, "header_id"]).where(F.col("column") == F.col("_naming")).select(*KEYS, "header_id", F.lower("raw_name").alias("map_name"), "row", "_code", "_label")
    side = lambda at, name: cells.select("artifact", "row", F.col("column").alias(at), F.trim("value").alias(name)).where(F.col(name) != "")
    pairs = rows.join(side("_code", "code"), ["artifact", "row", "_code"]).join(side("_label", "label"), ["artifact", "row", "_label"])
    pairs = pairs.select(*KEYS, "header_id", "map_name", "code", "label").distinct()
    clash = pairs.groupBy(*KEYS, "header_id", "code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEYS, "header_id").distinct()
    return pairs.join(clash, [*KEYS, "header_id"], "left_anti")


def support_maps(entries: DataFrame) -> DataFrame:
    """(map_name, code, label, sources): maps on which all their sources, by data set, dictionary and column, agree."""
    per = entries.groupBy(*KEYS, "header_id", "map_name").agg(F.count(F.lit(1)).alias("_n"))
    names = per.groupBy("map_name").agg(F.count(F.lit(1)).alias("sources"), F.min("_n").alias("_least"), F.max("_n").alias("_most")).where("_least = _most")
    shared = entries.groupBy("map_name", "code", "label").agg(F.count(F.lit(1)).alias("_of"))
    met = shared.join(names, "map_name")
    differ = met.where("_of <> sources").select("map_name").distinct()
    return met.join(differ, "map_name", "left_anti").select("map_name", "code", "label", "sources")

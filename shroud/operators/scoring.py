"""Scores of a release: facts by column, conformance, leak rates, rollups and coverage of decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions that change or remove a column's values.
ACTING = ("drop", "pseudonymize", "hash", "cap_age_90", "year_only", "zip3_truncate", "scrub_text", "suppress")


def share(part: Column, whole: Column, empty: float, places: int = 4) -> Column:
    """``part`` of ``whole``, rounded; ``empty`` where there is nothing."""
    return F.round(F.when(whole == 0, F.lit(empty)).otherwise(part / whole), places)


def column_facts(columns: DataFrame, decisions: DataFrame, leaks: DataFrame, planted: DataFrame, keys: Sequence[str] = ("file", "column")) -> DataFrame:
    """Expected and decided action of every column, its verdict, cells planted and changed, and leak hits.

    ``columns`` (keys, expected); ``decisions`` (keys, action), the last row of a column counts through
    ``seq``; ``leaks`` (keys); ``planted`` (keys, verbatim: whether the cell is to survive).
    """
    last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    decided = decisions.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*keys, "action")
    hits = leaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("leak_hits"))
    cells = planted.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.sum((~F.coalesce("verbatim", F.lit(False))).cast("long")).alias("changed"))
    out = columns.join(decided, list(keys), "left").join(hits, list(keys), "left").join(cells, list(keys), "left")
    wanted, acted = F.col("expected").isin(*ACTING), F.coalesce(F.col("action").isin(*ACTING), F.lit(False))
    verdict = F.when(F.col("action") == "human_review", "deferred").when(wanted & ~acted, "under_block").when(~wanted & acted, "over_block").otherwise("correct")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("leak_hits", "cells", "changed")]
    return out.select(*keys, "expected", "action", verdict.alias("verdict"), F.coalesce(F.col("action") == F.col("expected"), F.lit(False)).alias("exact"), *numbers)


def totals(facts: DataFrame) -> DataFrame:
    """One row: columns by what became of them, and the rates."""
    n = lambda c: F.sum(c.cast("long"))
    a = F.coalesce("action", F.lit(""))
    out = facts.agg(
        F.count(F.lit(1)).alias("columns"),
        n(F.col("expected").isin(*ACTING)).alias("identifying"),
        n(a == "drop").alias("dropped"),
        n(a.isin(*ACTING) & (a != "drop")).alias("transformed"),
        n(a == "keep").alias("kept"),
        n(a == "human_review").alias("deferred"),
        n(F.col("exact")).alias("_exact"),
    )
    return out.withColumn("method_exact_rate", share(F.col("_exact"), F.col("columns"), 1.0)).withColumn("autonomy_rate", F.round(1 - share(F.col("deferred"), F.col("columns"), 0.0), 4)).drop("_exact")


def conformance(cells: DataFrame, by: Sequence[str], expected: Column, actual: Column, verbatim: Column) -> DataFrame:
    """Cells that are as expected, by group: kept values count as utility, all others as transforms; a missing cell never conforms."""
    ok = F.coalesce(expected == actual, F.lit(False))
    structural = actual.isNull()  # a cell that is not there is a fault of the export, never a loss of use
    useful = verbatim & ~structural
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = cells.groupBy(*by).agg(n(~useful).alias("transforms"), n(~useful & ok).alias("conformant"), n(useful).alias("kept"), n(useful & ok).alias("preserved"))
    return out.withColumn("transform_rate", share(F.col("conformant"), F.col("transforms"), 1.0)).withColumn("utility_rate", share(F.col("preserved"), F.col("kept"), 1.0))


def leak_rate(planted: DataFrame, hits: DataFrame, plant: str, by: Sequence[str]) -> DataFrame:
    """(group, plants, leaked, rate): planted values that occur in the release, each once."""
    found = hits.select(plant).distinct().withColumn("_hit", F.lit(1))
    joined = planted.select(*by, plant).distinct().join(found, plant, "left")
    out = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("plants"), F.count("_hit").alias("leaked"))
    return out.withColumn("rate", share(F.col("leaked"), F.col("plants"), 0.0))


def rollup(reports: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Reports of several processes merged by group."""
    return reports.groupBy(*by).agg(F.count(F.lit(1)).alias("reports"), *[F.sum(c).alias(c) for c in counts])


def count_actions(decisions: DataFrame, action: str = "action") -> DataFrame:
    """(action, n)."""
    return decisions.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def coverage_counts(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row: how many rows each flag holds for."""
    return rows.agg(*[F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c) for c in flags])


def joined_view(policy: DataFrame, schema: DataFrame, name: str) -> DataFrame:
    """Every policy variable with the schema's column of that name, if any."""
    return policy.join(schema.withColumn("in_schema", F.lit(True)), name, "left").withColumn("in_schema", F.coalesce("in_schema", F.lit(False)))


def drift(documented: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Documented columns that no dataset has; also planted keys that a campaign lacks, and decisions without a verdict."""
    return documented.select(name).distinct().join(present.select(name), name, "left_anti")


def strengthen(decisions: DataFrame, signals: DataFrame, keys: Sequence[str], rank: Sequence[str], candidates: DataFrame | None = None, rule: str = "rule") -> DataFrame:
    """Actions that support signals make stricter, never weaker; ``rank`` goes from weakest to strictest.

    With ``candidates``, rules by ``rule``, a signal that cites none of them, or an action that has no rank, says nothing.
    """
    if candidates is not None:
        signals = signals.join(candidates.select(rule).distinct(), rule, "left_semi")
    place = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(r) for r in rank]), c).cast("int"), F.lit(0))
    strictest = signals.groupBy(*keys).agg(F.max_by("action", place(F.col("action"))).alias("_signal"))
    joined = decisions.join(strictest, list(keys), "left")
    stricter = place(F.col("_signal")) > place(F.col("action"))
    return joined.withColumn("changed", F.coalesce(stricter, F.lit(False))).withColumn("action", F.when(F.col("changed"), F.col("_signal")).otherwise(F.col("action"))).drop("_signal")


def held_by_dependencies(required: DataFrame, fulfilled: DataFrame, dataset: str = "dataset", dependency: str = "dependency") -> DataFrame:
    """(dataset, unmet): datasets that a required dependency holds back."""
    return required.join(fulfilled.select(dataset, dependency), [dataset, dependency], "left_anti").groupBy(dataset).agg(F.count_distinct(dependency).alias("unmet"))


def force_drop(suppress: DataFrame, direct: DataFrame, spared: DataFrame, keys: Sequence[str] = ("form", "column")) -> DataFrame:
    """Columns to drop by form: suppressed and direct identifiers, without those that opted for small cells."""
    return suppress.select(*keys).unionByName(direct.select(*keys)).distinct().join(spared.select(*keys), list(keys), "left_anti")


def latest_snapshot(snapshots: DataFrame, by: Sequence[str], created: str, id_col: str) -> DataFrame:
    """The last snapshot of each group by time, ties by id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(created), F.desc(id_col)))
    return snapshots.withColumn("_n", rank).where("_n = 1").drop("_n")


def as_written(before: DataFrame, after: DataFrame, columns: Sequence[str], rules: dict[str, str], key: str) -> DataFrame:
    """(column, rule, cells, changed): what a release did to each column, by the rows that both sides have."""
    a = before.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = after.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    one = a.join(b, "_k").agg(F.count(F.lit(1)).alias("n"), *[F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(rules[c]).alias("rule"), F.col("n").alias("cells"), F.coalesce(F.col(c), F.lit(0)).alias("changed")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def context_hygiene(prompts: DataFrame, prompt_id: str, text: str, violations: DataFrame, scrubbed: Column) -> DataFrame:
    """One row over logged prompts that have a text: how many and how long they are, what was removed before, and how many planted
    literals (``violations``: a row a prompt and literal) they still hold; clean if none."""
    seen = prompts.where(F.coalesce(F.length(text), F.lit(0)) > 0)
    sums = seen.agg(F.count(F.lit(1)).alias("prompts_audited"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("prompt_chars_audited"), F.coalesce(F.sum(scrubbed), F.lit(0)).cast("long").alias("identifiers_removed"))
    held = violations.join(seen.select(prompt_id), prompt_id, "left_semi").agg(F.count(F.lit(1)).alias("literals_found"))
    return sums.withColumn("_one", F.lit(1)).join(held.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("clean", F.col("literals_found") == 0)


def reviewer_coverage(reviews: DataFrame) -> DataFrame:
    """One row over reviews of files (verdict, missing, decisions_checked, verdicts_found): sums, and clean if every verdict is."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    unclean = F.coalesce(F.col("verdict"), F.lit("")) != "clean"
    rows = reviews.agg(F.count(F.lit(1)).alias("files_checked"), F.coalesce(F.sum(unclean.cast("long")), F.lit(0)).alias("files_with_findings"), n("decisions_checked"), n("verdicts_found"), n("missing"))
    return rows.withColumn("clean", F.col("files_with_findings") == 0)


def unreviewed(decisions: DataFrame, verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, column, fault): decisions without a verdict, and decisions on files that are not there."""
    missing = decisions.join(verdicts.select("file", "column"), ["file", "column"], "left_anti").withColumn("fault", F.lit("no_verdict"))
    absent = decisions.join(files.select("file"), "file", "left_anti").withColumn("fault", F.lit("no_file"))
    return missing.select("file", "column", "fault").unionByName(absent.select("file", "column", "fault"))

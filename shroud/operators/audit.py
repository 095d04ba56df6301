"""Scrubbing with its audit in the same pass: counts are observed while rows are written.

One job reads the input once and writes kept and held rows; the counts by rule, the rows by reason and the share of
rows held are metrics of that job. In strict mode a row that must be held fails the job, so nothing is committed.
Reports hold no clock, so equal inputs give equal reports; times go to a file beside.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shroud.operators.scrub import FIELD_ONLY, KEPT, MARK, MARKER, ORPHAN, ScrubConfig, scrub

#: Held rows that are more than this share, or orphans that are more than so many, raise the flag.
HELD_SHARE, ORPHANS = 0.10, 10
PART, REASON = "__part", "__reason"


@dataclass(frozen=True)
class Report:
    """``counts``: cells changed by (rule, column); ``reasons``: held rows by reason; ``skipped``: input lines by why they were no rows."""

    counts: Mapping[tuple[str, str], int]
    reasons: Mapping[str, int]
    kept: int
    skipped: Mapping[str, int]

    @property
    def held(self) -> int:
        return sum(self.reasons.values())

    @property
    def orphans(self) -> int:
        return self.reasons.get(ORPHAN, 0)

    @property
    def held_share(self) -> float:
        """Of the rows with a subject, those held for review."""
        review = self.held - self.orphans
        return review / max(self.kept + review, 1)

    @property
    def elevated(self) -> bool:
        return self.orphans > ORPHANS or self.held_share > HELD_SHARE

    def rows(self) -> list[tuple[str, str, int]]:
        """(scope, field, n), changes first."""
        return [(s, f, n) for (s, f), n in sorted(self.counts.items())] + [("rows", KEPT, self.kept), ("rows", "quarantined", self.held)]

    def json(self, study: str) -> str:
        """The content of a report, the same for the same rows."""
        scrubbed = [{"field": f, "scope": s, "n": n} for (s, f), n in sorted(self.counts.items())]
        return json.dumps({"study": study, "scrubbed": scrubbed, "kept": self.kept, "held": dict(sorted(self.reasons.items())), "held_share": round(self.held_share, 6), "elevated": self.elevated, "skipped": dict(sorted(self.skipped.items()))}, sort_keys=True)


def observed_scrub(df: DataFrame, config: ScrubConfig, key: bytes, strict: bool = False, skipped: Mapping[str, Column] | None = None, aside: Sequence[str] = ()) -> tuple[DataFrame, Observation, dict]:
    """(rows to write, their metrics, what each metric is).

    Rows are kept ones as scrubbed and held ones with the values that may stay, told apart by ``__part``, with
    ``__reason``. ``skipped``: conditions of input rows that are no rows; they are counted and left out.
    ``aside``: columns that only those conditions read.
    """
    names: dict[str, tuple[str, str]] = {}
    metrics: list[Column] = []

    def count(kind: str, what: str, hit: Column) -> None:
        names[f"m{len(metrics)}"] = (kind, what)
        metrics.append(F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias(f"m{len(metrics)}"))

    plan = scrub(df, config, key)
    flagged, part = plan.flagged, F.col("__disposition")
    out_of = F.lit(False)
    for why, hit in (skipped or {}).items():
        count("skipped", why, hit & ~out_of)
        out_of = out_of | F.coalesce(hit, F.lit(False))
    there = ~out_of
    rungs = {c: r for c, r in plan.rungs.items() if c not in aside}
    for c, r in rungs.items():
        if r.counted is not None:
            count(r.rule, c, r.counted & (part == KEPT) & there)
    count("kept", "", (part == KEPT) & there)
    reasons = [ORPHAN, *(f"{r.rule}:{c}" for c, r in rungs.items() if r.fails is not None)]
    for reason in reasons:
        count("reason", reason, (part == reason) & there)
    seen = Observation()
    rows = flagged.observe(seen, *metrics).where(there)
    kept = part == KEPT
    if strict:
        kept = F.when(kept, True).otherwise(F.raise_error(F.concat(F.lit("a row must be held: "), part)).cast("boolean"))
    values = []
    for c, r in rungs.items():
        own = F.col(f"`{c}`").cast("string")
        scrubbed = F.when(F.col("__done"), own).otherwise(r.value) if r.value is not None else F.lit(None).cast("string")
        values.append(F.when(part == KEPT, scrubbed).when(F.lit(r.rule not in FIELD_ONLY), own).alias(c))
    part_name = F.when(kept, KEPT).otherwise("quarantine").alias(PART)
    return rows.select(*values, F.when(part == KEPT, MARK).alias(MARKER), part.alias(REASON), part_name), seen, names


def report(seen: Observation, names: Mapping[str, tuple[str, str]]) -> Report:
    """The report of a finished job."""
    got = seen.get
    found = {names[m]: got[m] or 0 for m in names}
    by = lambda kind: {what: n for (k, what), n in found.items() if k == kind and n}
    counts = {k: n for k, n in found.items() if k[0] not in ("skipped", "kept", "reason")}
    return Report(counts, by("reason"), found["kept", ""], {what: n for (k, what), n in found.items() if k == "skipped"})


def write_audited(df: DataFrame, config: ScrubConfig, key: bytes, path: str, strict: bool = False, skipped: Mapping[str, Column] | None = None, aside: Sequence[str] = ()) -> Report:
    """Scrub and write ``df`` in one job, ``__part=kept`` and ``__part=quarantine`` by reason, and report on it."""
    rows, seen, names = observed_scrub(df, config, key, strict, skipped, aside)
    rows.write.mode("overwrite").option("ignoreNullFields", True).partitionBy(PART, REASON).json(path)
    return report(seen, names)


def read_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """JSON lines as text cells, and conditions of the lines that are no rows: blank, not JSON, or JSON that is no object."""
    lines = spark.read.text(path)
    bare = F.trim("value")
    parsed = F.try_parse_json(bare)
    cells = [F.try_variant_get(F.col("__v"), f"$['{c}']", "string").alias(c) for c in columns]
    rows = lines.select(bare.alias("__line"), parsed.alias("__v")).select(*cells, (F.col("__line") == "").alias("__blank"), F.col("__v").isNull().alias("__broken"), (~F.col("__line").startswith("{")).alias("__other"))
    return rows, {"blank": F.col("__blank"), "not_json": F.col("__broken"), "no_object": F.col("__other")}


def scrub_lines(spark: SparkSession, path: str, columns: Sequence[str], config: ScrubConfig, key: bytes, out: str, strict: bool = False) -> Report:
    """A file of JSON lines scrubbed and written in one pass; lines that are no rows are counted."""
    rows, skipped = read_lines(spark, path, columns)
    return write_audited(rows, config, key, out, strict, skipped, ("__blank", "__broken", "__other"))


def write_report(spark: SparkSession, made: Report, study: str, path: str, now: str) -> None:
    """The report and, beside it, the time it was made."""
    for name, text in (("scrub_report", made.json(study)), ("scrub_report_timing", json.dumps({"generated_utc": now}))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")

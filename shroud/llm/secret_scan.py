"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger is a folder
of runs by rule version; a run's findings are written first and the blobs that it scanned last, which
is its commit: a run that was lost between the two does not count and its blobs are scanned again. A
run scans only blobs that no committed run of the rule version has, once a blob however many paths
hold it, and findings are joined back to all paths. DataFrame functions only: match offsets come
from ``split`` and ``regexp_extract_all``, whose lengths alternate, by a running sum within the blob.

Defined cases: a null text is the empty blob. Paths that repeat are each returned. Blobs without a
match are in the ledger too, so they are not scanned again. Of paths that hold one blob the smallest
stands for it, ties are one row. Empty input gives empty tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroud.llm.scratch import new_path, save, write_table


@dataclass(frozen=True)
class SecretRule:
    """``pattern``: matches are leftmost and do not overlap. A match counts if ``inner`` (a pattern
    that the match is searched with, its group 1) has at least ``least`` characters.
    ``seeds``: plain strings of which a text with a match holds one; empty: always search."""

    kind: str
    pattern: str
    least: int
    inner: str = r"(?s)^(.*)$"
    seeds: tuple[str, ...] = ()


KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""(?:{KEYWORD})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = rf"""^(?:{KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Runs of a class are maximal, so a least length in the pattern equals dropping short matches.
BASE_RULES = (
    SecretRule("assign", ASSIGN, 8, ASSIGN_VALUE),
    SecretRule("access", r"AKIA[A-Z0-9]{12,}", 16, seeds=("AKIA",)),
    SecretRule("hex", r"[0-9a-f]{32,}", 32),
)
ADDED_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20, seeds=("PRIVATE KEY-----",)),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, seeds=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, seeds=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 20, seeds=("eyJ",)),
)
RULES = BASE_RULES + ADDED_RULES
RULE_VERSION = "2"

FINDINGS = "blob string, rule_version string, kind string, kind_no int, start long, end long"


def with_blobs(versions: DataFrame, text_col: str) -> DataFrame:
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _searched(rule: SecretRule, text: Column) -> Column:
    """Lengths of the text between matches, lengths of the matches, and whether each counts."""
    found = F.struct(
        F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("n"), (F.length(F.regexp_extract(m, rule.inner, 1)) >= rule.least).alias("ok"))).alias("found"),
    )
    gate = text.rlike(rule.pattern)
    if rule.seeds:
        seeded = text.contains(rule.seeds[0])
        for s in rule.seeds[1:]:
            seeded = seeded | text.contains(s)
        gate = seeded & gate
    return F.when(gate, found)


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Findings in ``blobs`` (blob, text), a row a counted match; offsets are code points, end exclusive."""
    per_kind = F.filter(
        F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(r.kind).alias("kind"), _searched(r, F.col("text")).alias("s")) for i, r in enumerate(rules)]), lambda k: k["s"].isNotNull()
    )
    hits = blobs.select("blob", F.explode(per_kind).alias("k")).select("blob", "k.kind", "k.kind_no", "k.s.gaps", F.posexplode("k.s.found").alias("pos", "m"))
    # gaps travel no further than the row they are read from: a match keeps the gap before it
    hits = hits.select("blob", "kind", "kind_no", "pos", F.get("gaps", F.col("pos")).cast("long").alias("gap"), F.col("m.n").cast("long").alias("n"), F.col("m.ok").alias("ok"))
    upto = Window.partitionBy("blob", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    return hits.where("ok").select("blob", F.lit(version).alias("rule_version"), "kind", "kind_no", (F.col("end") - F.col("n")).alias("start"), "end")


SCANNED = "blob string"


@dataclass(frozen=True)
class BlobLedger:
    """What was scanned and found, under ``path`` by rule version and run."""

    spark: SparkSession
    path: str

    def runs(self, version: str) -> list[str]:
        """Folders of the committed runs of a rule version."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        base = hadoop.Path(f"{self.path}/rule_version={version}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [str(s.getPath()) for s in fs.listStatus(base)] if fs.exists(base) else []
        return sorted(r for r in found if fs.exists(hadoop.Path(f"{r}/scanned/_SUCCESS")))

    def _read(self, version: str, name: str, schema: str) -> DataFrame:
        paths = [f"{r}/{name}" for r in self.runs(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self, version: str) -> DataFrame:
        """(blob): each once, as a run scans only what the runs before it lack."""
        return self._read(version, "scanned", SCANNED)

    def findings(self, version: str) -> DataFrame:
        return self._read(version, "findings", FINDINGS)

    def commit(self, version: str, findings: DataFrame, scanned: DataFrame) -> None:
        run = f"{self.path}/rule_version={version}/run-{uuid.uuid4().hex}"
        save(findings, f"{run}/findings")
        save(scanned, f"{run}/scanned")


def scan_versions(
    versions: DataFrame, keys: str | tuple[str, ...], text_col: str, ledger: BlobLedger | None = None, rules: tuple[SecretRule, ...] = RULES, version: str = RULE_VERSION
) -> DataFrame:
    """Keys, blob and spans of every row of ``versions``; scans what ``ledger`` lacks and commits it there.

    ``keys`` name a version: its path, or path and version. One row stands for an unseen blob, that of
    the smallest key. The text is shuffled once, to meet those rows' keys, which are the build side of
    the hash join, so texts are neither sorted nor spilled; only where a row repeats with its keys are
    such texts sorted to take one.
    """
    spark = versions.sparkSession
    ledger = ledger or BlobLedger(spark, new_path(spark, "ledger"))
    key = F.struct(*[F.col(k) for k in ((keys,) if isinstance(keys, str) else keys)])
    rows = versions.select(key.alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paths = write_table(with_blobs(rows, "text").select("_key", "blob"), "paths")
    unseen = paths.join(ledger.scanned(version), "blob", "left_anti")
    fresh = unseen.groupBy("blob", "_key").agg(F.count(F.lit(1)).alias("n")).groupBy("blob").agg(F.min(F.struct("_key", "n")).alias("r")).select("blob", "r._key", "r.n")
    fresh = write_table(fresh, "fresh")
    stands = fresh.select(F.col("blob").alias("_blob"), F.col("_key").alias("_stand")).hint("shuffle_hash")
    blobs = with_blobs(rows, "text").join(stands, (F.col("blob") == F.col("_blob")) & (F.col("_key") == F.col("_stand"))).select("blob", "text")
    if not fresh.where("n > 1").isEmpty():
        blobs = blobs.dropDuplicates(["blob"])
    ledger.commit(version, scan_blobs(blobs, rules, version), fresh.select("blob"))
    span = F.struct("start", "kind_no", "end", "kind")
    per_blob = ledger.findings(version).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    return paths.join(per_blob, "blob", "left").select("_key.*", "blob", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

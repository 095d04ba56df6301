"""Digests of tables and directories, and differences between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroud.operators.event_log import body_of


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files, read where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot_diff(old: DataFrame, new: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """(path, change): added, removed or changed."""
    a, b = old.select(path, F.col(sha).alias("_old")), new.select(path, F.col(sha).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, path, "full_outer").select(path, change.alias("change")).where("change is not null")


def cleanup_faults(present: DataFrame, must_go: DataFrame, must_stay: DataFrame, path: str = "path") -> DataFrame:
    """(path, fault): still there though it must go, or gone though it must stay."""
    left = must_go.select(path).join(present.select(path), path, "left_semi").select(path, F.lit("still_there").alias("fault"))
    gone = must_stay.select(path).join(present.select(path), path, "left_anti").select(path, F.lit("missing").alias("fault"))
    return left.unionByName(gone)


def staleness(recorded: dict[str, str | None], current: dict[str, str | None]) -> list[str]:
    """Triggers whose known digests differ: rulebook, key, raw data, config."""
    return [k for k in ("rulebook", "key", "raw_data", "config") if recorded.get(k) and current.get(k) and recorded[k] != current[k]]


def is_fresh(recorded: str | None, current: str | None) -> bool:
    """Whether two root digests (``digest_tree``) are known and agree, so work on the table can be skipped."""
    return recorded is not None and recorded == current


def chain_faults(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Events whose previous hash is not the hash of the event before."""
    before = F.lag("hash").over(Window.partitionBy(run).orderBy(seq))
    return events.withColumn("_before", before).where("_before is not null and not (_before <=> prev_hash)").drop("_before")


def hash_faults(events: DataFrame, payload: list[str], hash_col: str = "hash", prev: str = "prev_hash") -> DataFrame:
    """Events whose stored hash is not that of their previous hash and the canonical JSON of their payload, nulls and all."""
    again = F.sha2(F.concat(F.coalesce(F.col(prev), F.lit("")), body_of(payload)), 256)
    return events.where(~F.col(hash_col).eqNullSafe(again))

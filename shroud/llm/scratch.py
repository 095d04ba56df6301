"""Shared-folder scratch tables: written once, reread as ordinary Parquet.

A table in the folder that ``spark.checkpoint.dir`` names survives lost executors and cuts
lineage, so an expensive step that two jobs read is computed once. Shuffle files of a step are
removed once its table is written. ``drop`` removes a table that nothing reads any more, ``clear``
all that the application wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local master gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_shroud_scratch", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shroud-")
        sc._shroud_scratch = base
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to ``path`` and return it as read from there."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` under the shared folder and return it as read from there."""
    return save(df, new_path(df.sparkSession, name), codec)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results that still read them must be written before."""
    drop(spark, _root(spark))

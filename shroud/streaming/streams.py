"""The same rules on streams, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shroud.operators.scrub import ScrubConfig, scrub


def scrub_stream(stream: DataFrame, config: ScrubConfig, key: bytes, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write kept and quarantined rows of a stream; every rule is stateless, so batches are independent.

    A batch that is run again overwrites its own folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        plan = scrub(df, config, key)
        plan.kept.write.mode("overwrite").json(f"{path}/kept/batch={number}")
        plan.quarantine.write.mode("overwrite").json(f"{path}/quarantine/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tumbling_counts(events: DataFrame, ts: Column, key: str, width: str, lateness: str = "10 minutes") -> DataFrame:
    """Events a key and window; late ones count up to the watermark."""
    timed = events.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_rate(events: DataFrame, ts: Column, key: str, width: str = "15 minutes", slide: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.window("_ts", width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("hits")).select(F.col("w.start").alias("start"), key, "hits")


def sessions(events: DataFrame, ts: Column, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(df: DataFrame, ts: Column, now: Column, age: str) -> DataFrame:
    """Rows older than ``age``, which a retention sweep removes."""
    return df.where(ts.cast("timestamp") < now - F.expr(f"interval {age}"))

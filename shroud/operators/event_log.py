"""Append-only event logs: numbers and chained hashes a run over canonical JSON, range seals, and their faults.

An event's line is canonical JSON of its body, the hash before it, its run and its number; its hash is the
SHA-256 of the hash before and the line, and the first event's hash before is empty. A chain is a sequence by
its nature, so a run's events pass through one task in order, a few at a time; checking one is not: each event
meets its predecessor by (run, number), so a long run is checked by many tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.operators.nested import canonical, quoted

COLUMNS = "run string, seq long, id string, at timestamp, body string, prev_hash string, hash string"


def body_of(columns: Sequence[str]) -> Column:
    """Canonical JSON of columns, nulls kept, keys sorted."""
    return canonical(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def line(run: Column, seq: Column, prev_hash: Column, body: Column) -> Column:
    return F.concat(F.lit('{"event":'), body, F.lit(',"prev_hash":"'), prev_hash, F.lit('","run":'), quoted(run), F.lit(',"seq":'), seq.cast("string"), F.lit("}"))


def next_hash(run: str, seq: int, prev_hash: str, body: str) -> str:
    """The hash of one event, on a worker."""
    text = f'{{"event":{body},"prev_hash":"{prev_hash}","run":{json.dumps(run, ensure_ascii=False)},"seq":{seq}}}'
    return hashlib.sha256((prev_hash + text).encode()).hexdigest()


def arrivals(df: DataFrame, run: Column, event_id: Column, at: Column, payload: Sequence[str]) -> DataFrame:
    """(run, id, at, body) of events as they came; those without a run, id or time are no events."""
    rows = df.select(run.cast("string").alias("run"), event_id.cast("string").alias("id"), at.cast("timestamp").alias("at"), body_of(payload).alias("body"))
    return rows.where("run is not null and id is not null and at is not null")


def chain(events: DataFrame) -> DataFrame:
    """The log of ``arrivals``: by run in the order of time and id, an id once (its earliest)."""

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, seq, prev = None, 0, ""
        for frame in frames:
            seqs, before, after = [], [], []
            for r, body in zip(frame["run"], frame["body"], strict=True):
                if r != run:
                    run, seq, prev = r, 0, ""
                h = next_hash(r, seq, prev, body)
                seqs.append(seq), before.append(prev), after.append(h)
                seq, prev = seq + 1, h
            yield pd.DataFrame({"run": frame["run"], "seq": seqs, "id": frame["id"], "at": frame["at"], "body": frame["body"], "prev_hash": before, "hash": after})

    once = events.groupBy("run", "id").agg(F.min(F.struct("at", "body")).alias("e")).select("run", "id", "e.at", "e.body")
    return once.repartition("run").sortWithinPartitions("run", "at", "id").mapInPandas(number, COLUMNS)


def seals(log: DataFrame, every: int) -> DataFrame:
    """(run, from_seq, to_seq, segment_hash) of every full range of ``every`` events: the hash of its last one covers all before."""
    return log.where((F.col("seq") + 1) % every == 0).select("run", (F.col("seq") + 1 - every).alias("from_seq"), F.col("seq").alias("to_seq"), F.col("hash").alias("segment_hash"))


def faults(log: DataFrame, sealed: DataFrame | None = None) -> DataFrame:
    """(run, seq, fault) of a log: ``forged`` (its hash is not of its line), ``broken`` (not the hash of the event before),
    ``gap`` (the event before is missing), ``repeated`` (its number comes twice) and ``unsealed`` (not what was sealed, or gone)."""
    forged = ~F.col("hash").eqNullSafe(F.sha2(F.concat("prev_hash", line(F.col("run"), F.col("seq"), F.col("prev_hash"), F.col("body"))), 256))
    rows = log.select("run", "seq", "prev_hash", "hash", forged.alias("forged"))
    per = rows.groupBy("run", "seq").agg(F.count(F.lit(1)).alias("n"), F.bool_or("forged").alias("forged"), F.min("prev_hash").alias("prev_hash"), F.max("prev_hash").alias("_prev"), F.min("hash").alias("hash"), F.max("hash").alias("_hash"))
    before = per.select("run", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"), F.col("_hash").alias("_before2"))
    met = per.join(before, ["run", "seq"], "left")
    missing = (F.col("seq") > 0) & F.col("_before").isNull()
    told = lambda c: (c == F.coalesce("_before", F.lit(""))) | (c == F.coalesce("_before2", F.lit("")))
    kinds = {"forged": F.col("forged"), "broken": ~missing & ~(told(F.col("prev_hash")) & told(F.col("_prev"))), "gap": missing, "repeated": F.col("n") > 1}
    found = met.select("run", "seq", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("fault"))
    if sealed is None:
        return found
    ends = sealed.select("run", F.col("to_seq").alias("seq"), "segment_hash").join(per.select("run", "seq", "hash", "_hash"), ["run", "seq"], "left")
    opened = ends.where(~F.col("hash").eqNullSafe(F.col("segment_hash")) | ~F.col("_hash").eqNullSafe(F.col("segment_hash")))
    return found.unionByName(opened.select("run", "seq", F.lit("unsealed").alias("fault")))

"""The event log of a stream: the same numbers and hashes as ``event_log.chain`` makes of all events at once.

Events wait in state until the watermark has passed them, and are then numbered in the order of time and id; a
timeout at the earliest waiting event wakes them. Events that come twice wait once; what comes later than the
watermark allows is dropped by Spark, which counts it, so a number once given never changes. Runs are dealt by
hash into buckets, whose state comes with their rows and goes back whole, so neither an event nor a run costs a
call of its own. State a bucket is the events that wait, whose time is bounded by the lateness, and two values a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shroud.operators.event_log import COLUMNS, next_hash

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "runs array<string>, seqs array<long>, hashes array<string>, of array<string>, ids array<string>, micros array<long>, bodies array<string>"
MADE = COLUMNS.replace("at timestamp", "micros long")
#: Groups of runs; a bucket's state is in one task's memory. It stays what it was when a stream's checkpoint was made.
BUCKETS = 1024


def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events of a bucket's runs that the watermark has passed; the others wait."""
    runs, seqs, hashes, of, ids, micros, bodies = state.get if state.exists else ([],) * 7
    heads = dict(zip(runs, zip(seqs, hashes, strict=True), strict=True))
    waiting = dict(zip(zip(of, ids, strict=True), zip(micros, bodies, strict=True), strict=True))
    if not state.hasTimedOut:
        for frame in frames:
            for run, event_id, at, body in zip(frame["run"], frame["id"], frame["micros"].tolist(), frame["body"], strict=True):
                held = waiting.get((run, event_id))
                if held is None or (at, body) < held:
                    waiting[run, event_id] = (at, body)
    passed = state.getCurrentWatermarkMs() * 1000
    out = []
    for run, at, event_id, body in sorted((run, at, event_id, body) for (run, event_id), (at, body) in waiting.items() if at <= passed):
        seq, prev = heads.get(run, (0, ""))
        after = next_hash(run, seq, prev, body)
        out.append((run, seq, event_id, at, body, prev, after))
        heads[run] = (seq + 1, after)
        del waiting[run, event_id]
    kept, held = list(zip(*waiting, strict=True)) or ((), ()), list(zip(*waiting.values(), strict=True)) or ((), ())
    told = list(zip(*heads.values(), strict=True)) or ((), ())
    state.update(tuple(list(x) for x in (heads, *told, *kept, *held)))
    if waiting:  # Spark wakes a bucket once the watermark is beyond this
        state.setTimeoutTimestamp(max(1, -(-min(held[0]) // 1000) - 1))
    if out:
        yield pd.DataFrame(out, columns=["run", "seq", "id", "micros", "body", "prev_hash", "hash"])


def chain_stream(arrivals: DataFrame, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """The log of a stream of ``event_log.arrivals``; events may be as much as ``lateness`` late."""
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = arrivals.withWatermark("at", lateness).select("run", "id", "at", "body", F.unix_micros("at").alias("micros"), F.pmod(F.xxhash64("run"), F.lit(buckets)).alias("bucket"))
    log = timed.groupBy("bucket").applyInPandasWithState(number, MADE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return log.select("run", "seq", "id", F.timestamp_micros("micros").alias("at"), "body", "prev_hash", "hash")

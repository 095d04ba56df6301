from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from shroud.operators import digest_tree, event_log, lineage
from shroud.streaming import log


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(rows, leaf, prefix=""):
    """{prefix: digest} of the tree's nodes by recursion over (address, n)."""
    if len(rows) <= leaf:
        return {prefix: sha("entries " + ",".join(f"{a}:{n}" for a, n in sorted(rows)))}
    out, kids = {}, []
    for digit in "0123456789abcdef":
        inside = [r for r in rows if r[0].startswith(prefix + digit)]
        if inside:
            below = plain_tree(inside, leaf, prefix + digit)
            out |= below
            kids.append(digit + below[prefix + digit])
    return out | {prefix: sha("nodes " + ",".join(kids))}


def table(spark, n, changed=()):
    rows = [(None if i % 40 == 0 else i % 700, "same" if i % 3 == 0 else f"line {i}" + "!" * (i in changed)) for i in range(n)]
    return spark.createDataFrame([*rows, (1, None), (1, None)], "k int, v string"), [*rows, (1, None), (1, None)]


@pytest.mark.parametrize("n", [0, 3, 900])
def test_tree_equals_recursion(spark, n):
    df, rows = table(spark, n)
    counts = {}
    for k, v in rows:
        a = sha(counted(k) + counted(None if v is None else sha(v)))
        counts[a] = counts.get(a, 0) + 1
    want = plain_tree(list(counts.items()), 8)
    for parts in (1, 5):
        found = digest_tree.nodes(digest_tree.tree(digest_tree.entries(df.repartition(parts), F.col("k"), F.col("v")), 8), 8).collect()
        assert {r["prefix"]: r["digest"] for r in found} == want
        assert next(r["n"] for r in found if r["prefix"] == "") == len(rows)


def test_empty_table_has_no_nodes(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert digest_tree.nodes(digest_tree.tree(digest_tree.entries(df, F.col("k"), F.col("v")))).collect() == []


def test_depth_shapes_no_digest(spark):
    df, _ = table(spark, 300)
    rows = digest_tree.entries(df, F.col("k"), F.col("v"))
    assert len({digest_tree.tree(rows, about=n)[0].first()["digest"] for n in (300, 5000, 100_000)}) == 1


def test_difference_descends_only_where_digests_differ(spark, tmp_path):
    old = digest_tree.store(table(spark, 3000)[0], F.col("k"), F.col("v"), f"file://{tmp_path}/a", leaf=8)
    new = digest_tree.store(table(spark, 3001, {1001})[0].repartition(3), F.col("k"), F.col("v"), f"file://{tmp_path}/b", leaf=8)
    got = {(r["key"], r["change"]) for r in digest_tree.difference(spark, old, new).collect()}
    assert got == {("301", "changed"), (None, "changed")}
    _, compared = digest_tree.differing(spark, old, new)
    in_all = sum(old.nodes(spark, k).count() for k in range(6))
    assert compared < in_all / 4
    assert digest_tree.difference(spark, old, old).collect() == []
    assert lineage.is_fresh(old.root(spark), old.root(spark)) and not lineage.is_fresh(old.root(spark), new.root(spark)) and not lineage.is_fresh(None, None)


def test_difference_of_keys(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    old = digest_tree.store(make([("a", "1"), ("b", "1"), ("c", None), (None, "x")]), F.col("k"), F.col("v"), f"file://{tmp_path}/a")
    new = digest_tree.store(make([("a", "1"), ("b", "2"), ("d", "1"), (None, "x"), (None, "x")]), F.col("k"), F.col("v"), f"file://{tmp_path}/b")
    assert {tuple(r) for r in digest_tree.difference(spark, old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added"), (None, "changed")}


EVENTS = [("r1", "e3", 30, {"b": 2, "a": "x|y"}), ("r1", "e1", 10, {"a": None, "b": 1}), ("r1", "e2", 10, {"a": "é\"\n", "b": 3}), ("r2", "e1", 5, {"a": "z", "b": None}), ("r1", "e1", 20, {"a": "later copy", "b": 1}), (None, "e9", 1, {"a": "no run", "b": 1})]


def came(spark, events=EVENTS):
    df = spark.createDataFrame([(r, e, t, x["a"], x["b"]) for r, e, t, x in events], "run string, e string, t int, a string, b int")
    return event_log.arrivals(df, F.col("run"), F.col("e"), F.timestamp_seconds("t"), ["b", "a"])


def plain_chain(events):
    out, once = {}, {}
    for r, e, t, x in events:
        if r is not None and ((r, e) not in once or t < once[r, e][0]):
            once[r, e] = (t, x)
    for run in {r for r, _ in once}:
        prev = ""
        for seq, (_t, e, x) in enumerate(sorted((t, e, x) for (r, e), (t, x) in once.items() if r == run)):
            line = json.dumps({"event": x, "prev_hash": prev, "run": run, "seq": seq}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out[run, seq] = (e, prev, sha(prev + line))
            prev = sha(prev + line)
    return out


def test_chain_equals_plain_hashing(spark):
    got = {(r["run"], r["seq"]): (r["id"], r["prev_hash"], r["hash"]) for r in event_log.chain(came(spark)).collect()}
    assert got == plain_chain(EVENTS)


def test_faults_are_found(spark):
    events = [("r", f"e{i:03}", i, {"a": f"text {i}", "b": i}) for i in range(40)]
    whole = event_log.chain(came(spark, events)).cache()
    found = lambda x, *a: {tuple(r) for r in event_log.faults(x, *a).collect()}
    sealed = event_log.seals(whole, 10)
    assert found(whole, sealed) == set() and sealed.count() == 4
    assert found(whole.where("seq <> 7")) == {("r", 8, "gap")}
    assert found(whole.unionByName(whole.where("seq = 5"))) == {("r", 5, "repeated")}
    swapped = whole.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert {f for _, _, f in found(swapped)} == {"forged", "broken"}
    assert found(whole.withColumn("body", F.when(F.col("seq") == 9, F.lit('{"a":"text 9","b":10}')).otherwise(F.col("body")))) == {("r", 9, "forged")}
    rows = whole.orderBy("seq").collect()
    prev, remade = "", []
    for r in rows:  # a whole tail made anew fits itself, not its seals
        body = r["body"].replace("text 12", "other") if r["seq"] >= 12 else r["body"]
        h = event_log.next_hash("r", r["seq"], prev, body)
        remade.append((r["run"], r["seq"], r["id"], r["at"], body, prev, h))
        prev = h
    assert found(spark.createDataFrame(remade, event_log.COLUMNS), sealed) == {("r", 19, "unsealed"), ("r", 29, "unsealed"), ("r", 39, "unsealed")}


def test_payload_cells_cannot_be_moved(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("x", None), (None, "x"), ("", "x")]
    df = spark.createDataFrame(rows, "p string, q string").withColumn("prev_hash", F.lit(""))
    df = df.withColumn("hash", F.sha2(event_log.body_of(["p", "q"]), 256))
    assert df.select("hash").distinct().count() == len(rows)
    assert lineage.hash_faults(df, ["p", "q"]).count() == 0
    assert lineage.hash_faults(df.withColumn("q", F.lit("x")), ["p", "q"]).count() == 3


def test_stream_and_batch_chains_agree(spark, tmp_path):
    rng = random.Random(2)
    events = [(f"r{i % 3}", f"e{i}", 1000 + i, {"a": f"t{i}", "b": i}) for i in range(200)]
    late = sorted(events, key=lambda e: e[2] + rng.random() * 20)  # at most 20 seconds late
    parts = [late[k : k + 50] + late[max(0, k - 10) : k] for k in range(0, 200, 50)]
    for n, part in enumerate(parts):
        came(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    raw = spark.readStream.schema(came(spark).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = log.chain_stream(raw, "20 seconds").writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["run"], r["seq"]): (r["id"], r["prev_hash"], r["hash"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {k: v for k, v in plain_chain(events).items() if int(v[0][1:]) <= 199 - 20}
    assert got == want


def test_streamed_runs_share_the_state_of_a_few_buckets(spark, tmp_path):
    events = [(f"r{i % 40}", f"e{i}", 1000 + i, {"a": f"t{i}", "b": i}) for i in range(400)]
    for n in range(2):  # two starts from one checkpoint, each finding several files
        came(spark, events[200 * n : 200 * n + 200] + events[180 : 200 * n]).repartition(3).write.parquet(f"{tmp_path}/in/{n}")
        raw = spark.readStream.schema(came(spark).schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = log.chain_stream(raw, "30 seconds", 3).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = {(r["run"], r["seq"]): (r["id"], r["prev_hash"], r["hash"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: v for k, v in plain_chain(events).items() if int(v[0][1:]) <= 399 - 30}

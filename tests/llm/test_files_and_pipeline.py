from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shroud.llm import packing, pii, queries, quality, warc
from test_overlap import brute_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = Path("/root/testdata/sf0.001")


def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


# ---- packing


def test_added_tokens_and_unicode_classes():
    words, plain = packing.WordTokens(TOKENIZER, RANKS), tokenizer()
    assert struct.unpack("<I", words.encode("<|endoftext|>")) == (50256,)
    letters = [chr(c) for c in (0x41, 0xE9, 0x2B0, 0x300, 0x903, 0x20DD, 0x663, 0x2167, 0xBD, 0x203F, 0x2014, 0x28, 0x29, 0xAB, 0xBB, 0x21, 0x2B, 0x20AC, 0x5E, 0xA9, 0xA0, 0x2028, 0x2029, 0x7, 0x200B, 0xE000, 0x4E2D, 0x1F600, 0x85, 0x3000)]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice([*letters, " ", "<|endoftext|>", "a"], 12)) for _ in range(1500)] + ["x" * 5000, " " * 3000 + "y", "é" * 4000, "1" * 3000, "a <|endoftext|> b<|endoftext|>", "<|endoftext"]
    for t in texts:
        i = plain.encode(t, add_special_tokens=False).ids
        assert words.encode(t) == struct.pack(f"<{len(i)}I", *i), repr(t[:80])


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_words_give_the_texts_ids(ranks):
    words, plain, rng = packing.WordTokens(TOKENIZER, ranks), tokenizer(), np.random.default_rng(1)
    alphabet = list(" \n\t  abcé'sß.,!1٣ 中文😀A't\r\x0b\x1c\x85") + [" word", "<|endoftext|>", " it's", "  "]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 16)))
        assert words.encode(t) == struct.pack(f"<{len(i)}I", *i) if (i := plain.encode(t, add_special_tokens=False).ids) else words.encode(t) == b"", repr(t)


def test_hilbert_keys_are_a_curve():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_pack(rows, docs, seq_len):
    plain = tokenizer()
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, i in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(i)
    lengths = []
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        lengths.append(at)
    assert max(lengths) <= seq_len and all(n == seq_len or n & (n - 1) == 0 for n in lengths)


def test_packing_round_trip(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["red", "green", "blue", "a", "the."], int(rng.integers(0, 90))))) for i in range(120)] + [(500, None), (501, ""), (502, "same"), (503, "same")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), TOKENIZER, 1, seq_len=64, ranks=RANKS).collect()
    check_pack(rows, docs, 64)


def test_packing_edges(spark, awkward, nothing):
    rows = packing.pack(awkward, TOKENIZER, 1, with_ids=True).collect()
    assert {"doc_id", "ids"} <= set(rows[0].asDict()) and sum(r["start"] == 0 for r in rows) == 9
    assert packing.pack(nothing, TOKENIZER, 1).count() == 0


# ---- WARC


def pages(spark):
    rows = [(i, f"http://h.org/{i} x", f"<p>{i % 7}é</p>" * (1 + i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", None), (None, "u", "<p>only</p>"), (3, "again", "<p>3é</p>" * 4)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    target = f"file://{tmp_path}/w"
    manifest = warc.write(df, target, shard_bytes=500, roll_bytes=2000)
    files = manifest.collect()
    assert sum(f["records"] for f in files) == len(rows) and len(files) > 3
    for f in files:
        data = (tmp_path / "w" / "archive" / f["name"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["bytes"] and (f["bytes"] <= 2000 or f["records"] == 1)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == f["records"]
    assert not list((tmp_path / "w" / "temporary").iterdir())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    got = sorted((str(r["id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, target).collect())
    want = []
    for i, _, h in rows:
        body, to = (h or "").encode(), first.get(h or "", i)
        want.append((str(i), "response" if to == i else "revisit", str(None if to == i else to), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    assert got == sorted(want)
    bodies = {r["id"]: r["payload"] for r in warc.read(spark, target, with_payload=True).where("record_type = 'response' and id <> 3").collect()}
    assert all((bodies[i] or b"") == (h or "").encode() for i, _, h in rows if i in bodies)


def test_warc_files_are_the_same_again(spark, tmp_path):
    """Many shards, an id and a payload that a third of the rows have, rows in any order and other partition counts."""
    rows, _ = pages(spark)
    rows += [(7, f"u{i}", f"<p>{i} of a hot id</p>" * 3) for i in range(60)] + [(200 + i, "u", "<p>a hot payload</p>" * 4) for i in range(60)] + [(300, "v", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("id", "place", "shard", "part", "digest", "refers_to", "payload", "size")})
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "7")
    again = other.createDataFrame(rows[::-1], "page_id long, url string, html string").orderBy(F.rand(3)).repartition(5)
    names = [sorted((f["name"], f["sha256"]) for f in warc.write(part, f"file://{tmp_path}/{n}", shard_bytes=4000).collect()) for n, part in (("a", df), ("b", again))]
    assert names[0] == names[1] and len({n.split("-")[0] for n, _ in names[0]}) > 10
    got = warc.read(spark, f"file://{tmp_path}/b").collect()
    assert len(got) == len(rows) and sum(r["record_type"] == "response" and 200 <= (r["id"] or 0) < 300 for r in got) == 1


def test_shard_borders_are_exact(spark, tmp_path):
    sizes = [1000, 3000, 500, 500, 500, 2500, 100]
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(sizes)], "id long, place long, size long")
    starts, want = np.cumsum([0, *sizes[:-1]]), []
    for shard in range(1, 4):
        want += [int(i) for i in np.flatnonzero(starts // 2500 == shard)[:1]]
    ids, places = warc.shard_borders(df, 2500, 100)
    assert ids.tolist() == want == places.tolist()
    assert warc.shard_of(np.arange(7), np.arange(7), (ids, places)).tolist() == (np.searchsorted(want, np.arange(7), "right")).tolist()
    assert warc.shard_of(np.array([5, 5, 5]), np.array([1, 4, 9]), (np.array([5, 5]), np.array([2, 4]))).tolist() == [0, 2, 2]


def test_warc_leaves_out_files_of_lost_attempts(spark, tmp_path):
    _, df = pages(spark)
    target = f"file://{tmp_path}/w"
    warc.write(df, target)
    (tmp_path / "w" / "archive" / "00099-00000.warc.gz").write_bytes(b"not in the manifest")
    assert warc.read(spark, target).count() == df.count()
    empty = f"file://{tmp_path}/e"
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# ---- pipeline


def brute_pipeline(spark, docs, labels, items):
    """The stages on one machine: the model's scores, then sets and plain comparisons."""
    stats = spark.createDataFrame([(d, quality.statistics_of(t)) for d, t in docs], "doc_id long, s array<double>")
    named = stats.select("doc_id", F.struct(*[F.col("s")[i].alias(n) for i, n in enumerate(quality.STATS)]).alias("stats"))
    model = quality.train(named, labels)
    good = {r["doc_id"] for r in named.where(model.score(F.col("stats")) >= 0.5).collect()}
    kept = [(d, t) for d, t in docs if d in good]
    least = brute_components(kept)
    kept = [(d, t) for d, t in kept if least[d] == d]
    kept = [(d, t) for d, t in kept if not any(i and i in t for i in items)]
    counts, sample = defaultdict(int), []
    for _, t in kept:
        for _, kind, _, key, found in pii.spans_of(t):
            counts[key] += 1
            sample += [(key, found)] if kind >= len(pii.BASE_KINDS) else []
    redact = pii.redactor(pii.fit(dict(counts), sorted(sample)))
    return {d: redact(t) for d, t in kept}


@pytest.mark.skipif(not SF.is_dir(), reason="no driver tables")
def test_pipeline_against_brute_force(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = sorted((r["doc_id"], r["text"]) for r in read("documents").collect())
    want = brute_pipeline(spark, docs, read("labels"), [r["text"] for r in read("benchmark").collect()])
    rows = corpus_pipeline.run(spark, str(SF)).collect()
    assert {r["doc_id"] for r in rows} == set(want) and 0 < len(want) < len(docs)
    check_pack(rows, list(want.items()), 2048)


def test_stages_on_awkward_documents(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "word0 w0 word1 w7919")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, str(tmp_path))
            assert docs_out.columns == docs.columns and [f.dataType for f in docs_out.schema] == [f.dataType for f in docs.schema], name
            docs = spark.createDataFrame(docs_out.collect(), docs_out.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5

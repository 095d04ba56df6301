"""What settings must not change, and rows that ids alone cannot tell apart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shroud.llm import decontam, overlap, quality


def labelled(spark, n=400):
    rng = random.Random(11)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))) + "."
    bad = lambda: " ".join(rng.choice(["!!!", "BUY NOW", "1234", "||", "###", "win"]) for _ in range(rng.randrange(5, 60)))
    rows = [(i, good() if (i % 2) ^ (rng.random() < 0.1) else bad()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")


def test_quality_does_not_depend_on_partitions_or_sessions(spark):
    docs, labels = labelled(spark)
    docs.repartition(5).write.mode("overwrite").parquet(place := f"{quality.write_table(docs, 'q').inputFiles()[0].rsplit('/', 2)[0]}/quality-docs")
    found = []
    for parts, size, session in ((2, "128m", spark), (4, "4k", spark), (16, "128m", spark.newSession()), (64, "2k", spark.newSession())):
        before = {k: session.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
        session.conf.set("spark.sql.shuffle.partitions", parts)
        session.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = session.read.parquet(place)
            scored, model = quality.score_documents(read, session.createDataFrame(labels.collect(), labels.schema))
            found.append(({r["doc_id"]: r["score"] for r in scored.collect()}, model.rules))
        finally:
            for k, v in before.items():
                session.conf.set(k, v)
    assert len(found[0][1]) > 2 and all(rules == found[0][1] for _, rules in found)
    assert all(scores == found[0][0] for scores, _ in found)


def test_leaks_without_an_id_are_dropped_and_clean_rows_stay(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly box"
    clean = "nothing of the kind is said here at all by anyone who knows"
    rows = [(None, f"before {item} after"), (None, clean), (1, item), (1, clean), (2, None), (3, ""), (3, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_digest", "doc", "item")})
    left = decontam.decontaminate(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, (r for r in rows if not r[1] or item not in r[1])))


def test_unlike_texts_of_one_id_both_stay_once(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(5, a), (5, a), (5, b), (6, a + " more"), (7, b), (None, a), (8, None), (8, ""), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_digest", "_id", "node", "_kept", "count")})
    left = overlap.deduplicate(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert [x for x in got if x[0] != 8] == sorted([(5, a), (5, b), (None, a), (9, "x")], key=str)
    assert len([x for x in got if x[0] == 8]) == 1

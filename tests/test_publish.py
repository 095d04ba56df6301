from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from shroud.sources import publish
from shroud.sources.publish import Publication, PublicationError

KEYS = {"a": "k", "b": "k"}


def tables(spark, n):
    return {"a": spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v")), "b": spark.createDataFrame([(None, "y"), (1, None)], "k int, v string")}


def test_a_release_is_seen_whole_and_replaces_all(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}")
    assert p.current() is None
    with pytest.raises(PublicationError):
        p.read("a")
    one = p.publish(tables(spark, 5), KEYS, "2024-01-01T00:00:00Z", clean=lambda df: True, fingerprint="f1")
    reader = p.read("a")
    two = p.publish({"a": tables(spark, 7)["a"]}, {"a": "k"}, "2024-01-02T00:00:00Z")
    assert (one.number, two.number, one.verified, two.verified) == (1, 2, True, False)
    assert one.rows == {"a": 5, "b": 2} and set(two.tables) == {"a"} and p.current() == two.generation
    assert p.read("a").count() == 7 and reader.count() == 5 and p.read("b", one.generation).count() == 2
    with pytest.raises(PublicationError):
        p.read("b")
    assert p.prior(two.generation) == one and p.faults(one.generation, KEYS) == []


@pytest.mark.parametrize("step", ["stage", "seal", "promote", "half a pointer"])
def test_a_stop_leaves_the_release_before(spark, tmp_path, monkeypatch, step):
    p = Publication(spark, f"file://{tmp_path}")
    one = p.publish(tables(spark, 3), KEYS, "2024-01-01T00:00:00Z")
    real = publish._create

    def stopped(session, path, text):
        if step == "seal" and path.endswith("manifest.json") or step == "promote" and "/current/" in path:
            raise KeyboardInterrupt
        if step == "half a pointer" and "/current/" in path:
            real(session, path, text[:7])
            raise KeyboardInterrupt
        real(session, path, text)

    monkeypatch.setattr(publish, "_create", stopped)
    broken = tables(spark, 9)
    if step == "stage":
        broken["b"] = broken["b"].withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(BaseException):  # noqa: B017
        p.publish(broken, KEYS, "2024-01-02T00:00:00Z")
    monkeypatch.setattr(publish, "_create", real)
    assert p.current() == one.generation and p.read("a").count() == 3 and len(p.releases()) == 1
    two = p.publish(tables(spark, 4), KEYS, "2024-01-03T00:00:00Z")
    assert p.current() == two.generation and p.read("a").count() == 4
    assert len(p.sweep(keep=1)) == 2 and p.current() == two.generation and p.read("a").count() == 4
    assert os.listdir(tmp_path / "generations") == [two.generation]


def test_two_writers_cannot_both_follow_one_release(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}")
    a, b = (p.seal(p.stage(tables(spark, n)), KEYS, "2024-01-01T00:00:00Z") for n in (1, 2))
    p.promote(a)
    with pytest.raises(PublicationError):
        p.promote(b)
    assert p.current() == a.generation


def test_unclean_tables_are_not_released_and_equal_inputs_not_released_twice(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}")
    with pytest.raises(PublicationError):
        p.publish(tables(spark, 5), KEYS, "2024-01-01T00:00:00Z", clean=lambda df: df.where("v = 'y'").isEmpty())
    assert p.current() is None
    unverified = p.publish(tables(spark, 5), KEYS, "2024-01-01T00:00:00Z", fingerprint="f")
    assert p.find("f") is None and p.find("") is None
    one = p.publish(tables(spark, 6), KEYS, "2024-01-02T00:00:00Z", clean=lambda df: True, fingerprint="f", partial=True, absent=("c",))
    assert one.generation != unverified.generation and p.find("f") == one
    assert p.publish(tables(spark, 8), KEYS, "2024-01-03T00:00:00Z", clean=lambda df: True, fingerprint="f") == one
    assert one.partial and p.manifest(one.generation).absent == ("c",)


def test_changed_files_are_found(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}")
    one = p.publish(tables(spark, 5), KEYS, "2024-01-01T00:00:00Z")
    two = p.publish({n: t.repartition(3) for n, t in tables(spark, 5).items()}, KEYS, "2024-01-02T00:00:00Z")
    assert one.content == two.content
    tables(spark, 6)["a"].write.mode("overwrite").parquet(f"file://{tmp_path}/generations/{one.generation}/tables/a")
    assert p.faults(one.generation, KEYS) == ["a"] and p.faults(two.generation, KEYS) == []
    assert json.loads((tmp_path / "generations" / one.generation / "manifest.json").read_text())["content"] == one.content

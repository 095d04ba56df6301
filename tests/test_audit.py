from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shroud.operators import audit, scrub

KEY = b"test key"
CONFIG = scrub.ScrubConfig(subject_id_fields=("SUBJID",), drop_fields=("NAME",), cap_fields=("AGE",), generalize_fields={"MARITAL": {"married": "partnered"}}, id_fields={"^SUBJID$": "SUBJ"})
ROWS = [("s1", "Ann", "95", "Married"), ("s1", "Bob", "60", "odd"), (" ", "Cy", "1", ""), (None, None, None, None)]


def form(spark, rows=ROWS):
    return spark.createDataFrame(rows, "SUBJID string, NAME string, AGE string, MARITAL string")


def test_report_equals_counts_of_a_second_pass(spark, tmp_path):
    made = audit.write_audited(form(spark), CONFIG, KEY, f"file://{tmp_path}/out")
    assert sorted(made.rows()) == sorted((r["scope"], r["field"], r["n"]) for r in scrub.scope_counts(form(spark), CONFIG, KEY).collect())
    assert made.reasons == {"orphan": 2, "generalize:MARITAL": 1} and (made.kept, made.held, made.orphans) == (1, 3, 2)
    assert made.held_share == 0.5 and made.elevated
    back = spark.read.json(f"file://{tmp_path}/out")
    held = back.where("__part = 'quarantine'").collect()
    assert len(held) == 3 and {r["MARITAL"] for r in held} == {"odd", "", None} and "NAME" not in back.columns
    plan = scrub.scrub(form(spark), CONFIG, KEY)
    assert [r["SUBJID"] for r in back.where("__part = 'kept'").collect()] == [r["SUBJID"] for r in plan.kept.collect()]


def test_input_is_read_once(spark, tmp_path):
    form(spark).write.parquet(f"{tmp_path}/in")
    rows, seen, names = audit.observed_scrub(spark.read.parquet(f"{tmp_path}/in"), CONFIG, KEY)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1 and "CollectMetrics" in text and "Join" not in text


def test_strict_mode_commits_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="must be held"):
        audit.write_audited(form(spark), CONFIG, KEY, f"file://{tmp_path}/out", strict=True)
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("__part*"))
    made = audit.write_audited(form(spark, ROWS[:1]), CONFIG, KEY, f"file://{tmp_path}/out", strict=True)
    assert made.held == 0 and not made.elevated


def test_lines_that_are_no_rows_are_counted(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"SUBJID":"s1","AGE":95,"NAME":"Ann"}\n\n   \n{broken\n[1]\n"text"\n{"MARITAL":"married","SUBJID":"s2"}\n')
    made = audit.scrub_lines(spark, f"file://{tmp_path}/in.jsonl", ["SUBJID", "NAME", "AGE", "MARITAL"], CONFIG, KEY, f"file://{tmp_path}/out")
    assert made.skipped == {"blank": 2, "not_json": 1, "no_object": 2} and made.kept == 2 and made.counts["cap", "AGE"] == 1


def test_reports_are_equal_for_equal_rows(spark, tmp_path):
    texts = []
    for n in (1, 3):
        made = audit.write_audited(form(spark).repartition(n), CONFIG, KEY, f"file://{tmp_path}/out{n}")
        audit.write_report(spark, made, "study", f"file://{tmp_path}/report{n}", f"2024-01-0{n}T00:00:00Z")
        texts.append(spark.read.text(f"file://{tmp_path}/report{n}/scrub_report").first()[0])
    assert texts[0] == texts[1] and json.loads(texts[0])["held"] == {"generalize:MARITAL": 1, "orphan": 2}
    assert json.loads(spark.read.text(f"file://{tmp_path}/report3/scrub_report_timing").first()[0])["generated_utc"].startswith("2024-01-03")


def test_empty_table(spark, tmp_path):
    made = audit.write_audited(form(spark).where(F.lit(False)), CONFIG, KEY, f"file://{tmp_path}/out")
    assert (made.kept, made.held, made.elevated) == (0, 0, False)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shroud.operators import detect, digest_tree, guard, lineage, policy, privacy, review, scrub, shaping, transform, verify
from shroud.sources import tables
from shroud.streaming import streams

KEY = b"test key"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_merge_prefers_the_more_certain(spark):
    spans = [{"start": 0, "end": 10, "value": "a", "entity": "X", "category": "A", "confidence": 0.4, "is_rule": False}, {"start": 5, "end": 9, "value": "b", "entity": "Y", "category": "G", "confidence": 0.99, "is_rule": True}]
    df = spark.createDataFrame([(spans,)], f"s {detect.spans_type()}")
    got = df.select(detect.merge_spans(F.col("s")).alias("m")).first()["m"]
    assert [(s["start"], s["end"], s["category"]) for s in got] == [(5, 9, "G")]


def test_scrub_text(spark):
    df = spark.createDataFrame([("mail a.b@c.org or (212) 555-0100", 1), ("none", 2), (None, 3), ("", 4)], "t string, i int")
    assert [r[0] for r in df.orderBy("i").select(detect.scrub(F.col("t"))).collect()] == ["mail [F] or [D]", "none", None, ""]


CONFIG = scrub.ScrubConfig(
    subject_id_fields=("SUBJID",),
    suppress_headers=frozenset({"secret"}),
    drop_fields=("NAME",),
    cap_fields=("AGE",),
    generalize_fields={"MARITAL": {"married": "partnered"}},
    small_cell_fields=("COUNT",),
    date_fields=("DAT$",),
    id_fields={"^SUBJID$": "SUBJ"},
    birthdate_field="BIRTH",
    age_fields=("AGE",),
)


def form(spark):
    return spark.createDataFrame(
        [("s1", "x", "Ann", "95", "Married", "9", "2014-02-27", "d"), ("s1", "x", "Ann", "60", "odd", "3", "2014-03-01", "d"), (" ", "x", "Bob", "1", "", "1", "UNK", "d")],
        "SUBJID string, Secret string, NAME string, AGE string, MARITAL string, COUNT string, VISDAT string, BIRTHDAT string",
    )


def test_scrub_rows(spark):
    plan = scrub.scrub(form(spark), CONFIG, KEY)
    kept = plan.kept.collect()
    assert len(kept) == 1 and kept[0]["AGE"] == "90+" and kept[0]["MARITAL"] == "partnered" and kept[0]["COUNT"] == "5" and kept[0][scrub.MARKER] == "v3"
    assert {"Secret", "NAME", "BIRTHDAT"}.isdisjoint(plan.kept.columns)
    assert sorted(r["reason"] for r in plan.quarantine.collect()) == ["generalize:MARITAL", "orphan"]
    assert scrub.scrub(plan.kept, CONFIG, KEY).kept.collect() == kept
    counts = {(r["scope"], r["field"]): r["n"] for r in scrub.scope_counts(form(spark), CONFIG, KEY).collect()}
    assert counts["cap", "AGE"] == 1 and counts["rows", "quarantined"] == 2


def test_scrub_keeps_intervals(spark):
    df = spark.createDataFrame([("a", "2014-01-01"), ("a", "2014-01-31")], "SUBJID string, VISDAT string")
    days = sorted(r["VISDAT"] for r in scrub.scrub(df, CONFIG, KEY).kept.collect())
    assert spark.createDataFrame([tuple(days)], "a string, b string").select(F.datediff("b", "a")).first()[0] == 30


def test_scrub_stream_equals_batch(spark, tmp_path):
    form(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(form(spark).schema).parquet(str(tmp_path / "in"))
    streams.scrub_stream(stream, CONFIG, KEY, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out" / "kept")).drop("batch")
    want = scrub.scrub(form(spark), CONFIG, KEY).kept
    assert [r.asDict() for r in got.select(want.columns).collect()] == [r.asDict() for r in want.collect()]


def test_config_is_validated():
    with pytest.raises(ValueError):
        scrub.ScrubConfig(subject_id_fields=())
    with pytest.raises(ValueError):
        scrub.ScrubConfig(subject_id_fields=("a",), future_date_policy="x")


def test_decisions(spark):
    with pytest.raises(ValueError):
        transform.resolve_decisions(["a"], [("a", "keep"), ("a", "drop")])
    assert transform.resolve_decisions(["a", "b"], [("a", "keep")]) == {"a": "keep", "b": "drop"}
    df = spark.createDataFrame([("x", "", None)], "a string, b string, c string")
    assert rows(transform.apply_actions(df, {"a": "human_review", "b": "human_review", "c": "drop"}, "s")) == [(transform.PENDING, "", None)]


def test_privacy_nulls(spark):
    df = spark.createDataFrame([(None, "a", None), (None, "a", "x")], "p string, q string, s string")
    assert rows(privacy.smallest_class(df, ["p", "q"])) == [(2, 1)]
    assert rows(privacy.l_diversity(df, ["p", "q"], ["s"], 3)) == [("s", "|a", 2)]
    assert rows(privacy.smallest_class(df.limit(0), ["p"])) == [(0, 0)]


def test_header_policy():
    assert policy.hard_rule("Patient Name")[1] == "drop" and policy.hard_rule("zip_code")[1] == "zip3_truncate" and policy.hard_rule("foo") is None
    assert policy.classify_header("SubjectId")[0] == "pseudonymize" and policy.classify_header("VISDAT")[0] == "jitter_date" and policy.classify_header("bmi")[0] == "keep"
    d = policy.apply_hard_rules([policy.Decision("email", "keep"), policy.Decision("bmi", policy.REVIEW)])
    assert [x.action for x in d] == ["drop", "keep"]
    assert [x.action for x in policy.apply_confidence_floor([policy.Decision("a", "keep", confidence=0.5)])] == [policy.REVIEW]
    assert [x.action for x in policy.apply_age_rule([policy.Decision("age", "keep"), policy.Decision("dob", "year_only")])] == ["keep", "drop"]
    assert [x.action for x in policy.apply_site_rule([policy.Decision("site", "keep")], {"site": (100, 5)})] == ["drop"]


def test_replay_demotes_hijacked_columns(spark):
    df = spark.createDataFrame([("a@b.org", "7"), ("c", "8")], "state string, bmi string")
    out, decisions = policy.replay(df, "salt")
    assert {d.column: d.action for d in decisions} == {"state": policy.REVIEW, "bmi": "keep"} and guard.is_clean(out)


def test_guard(spark):
    df = spark.createDataFrame([("f", "call 212-555-0100", "age 95"), ("f", "ok", "95")], "file string, a string, b string")
    found = guard.cell_findings(df, "file", {"a": None, "b": None})
    assert sorted(r["pid"] for r in found.collect()) == ["AGE_OVER_89", "PHONE_US"]
    assert [r["sample"] for r in guard.top_findings(found).where("pid = 'PHONE_US'").collect()] == ["21********00"]
    lines = guard.line_findings(spark.createDataFrame([("f", "a\nb 212-555-0100\r\nc d e")], "file string, t string"), "file", "t")
    assert [r["line"] for r in lines.collect()] == [2]


def test_verify(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("c", "3")], "s string, t string")
    assert rows(verify.pseudonym_faults(pairs, "s", "t"), "fault") == [("collision", "1", 2), ("split", "c", 2)]
    cells = spark.createDataFrame([(1, "xx John Q Public yy"), (2, "johnny"), (3, None)], "id int, t string")
    names = spark.createDataFrame([("John Q Public",), ("johnny",), ("",)], "p string")
    assert rows(verify.leak_passages(cells, "id", "t", names, "p"), "id") == [(1, "john q public"), (2, "johnny")]
    c = verify.calibration(spark.createDataFrame([(0.1, True), (1.0, False)], "c double, ok boolean"), F.col("c"), F.col("ok"))
    assert rows(c, "bucket") == [(0, 1, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 1, 0.0)]


def test_review_and_lineage(spark):
    cols = spark.createDataFrame([("f", "a"), ("f", "b")], "file string, column string")
    dec = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "z")], "file string, column string")
    assert rows(review.coverage_faults(cols, dec, ["file", "column"]), "fault") == [("f", "a", "duplicate"), ("f", "z", "invented"), ("f", "b", "missing")]
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha256 string"), spark.createDataFrame([("b", "2"), ("c", "1")], "path string, sha256 string")
    assert rows(lineage.snapshot_diff(old, new), "path") == [("a", "removed"), ("b", "changed"), ("c", "added")]
    digest = lambda df: digest_tree.tree(digest_tree.entries(df, F.col("path"), F.col("sha256")))[0].first()["digest"]
    assert lineage.is_fresh(digest(old), digest(old.repartition(3))) and not lineage.is_fresh(digest(old), digest(new))


def test_shaping(spark):
    sheet = spark.createDataFrame([("s", 0, "Title", None), ("s", 1, "id", "v"), ("s", 2, "1", "x"), ("s", 3, None, " "), ("s", 4, "2", "y"), ("s", 5, "Source: z", None)], "sheet string, n int, a string, b string")
    assert [r["segment"] for r in shaping.blank_row_segments(sheet, "sheet", "n", ["a", "b"]).orderBy("n").collect()] == [1, 1, 1, 2, 2]
    promoted = shaping.promote_header(sheet, "n", ["a", "b"], "Source:")
    assert promoted.columns == ["n", "id", "v"] and [r["id"] for r in promoted.orderBy("n").collect()] == ["1", "2"]
    codes = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "code string, label string")
    assert shaping.value_map(codes, "code", "label").count() == 0 and shaping.value_map(codes.where("code = '2'"), "code", "label").count() == 1
    union = shaping.union_records([spark.createDataFrame([("1",)], "a string"), spark.createDataFrame([("2",)], "b string")])
    assert rows(union, "a") == [("", "2"), ("1", "")]


def test_sources(spark, tmp_path):
    (tmp_path / "datasets").mkdir()
    (tmp_path / "datasets" / "d.csv").write_text('a,b\n1,\n"",x\n')
    assert rows(tables.read_csv(spark, str(tmp_path / "datasets" / "d.csv")), "a") == [("", "x"), ("1", "")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    assert rows(tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema="a string")) == [("1",)]
    files = tables.classify_package(tables.discover(spark, str(tmp_path), ["csv", "jsonl"]))
    assert sorted(str(r["component"]) for r in files.collect()) == ["None", "datasets"]
    assert sorted(r["fault"] for r in tables.package_faults(files).collect()) == ["no_support", "unclassified"]
    assert tables.write_split(spark.range(1), spark.createDataFrame([("a", "orphan")], "x string, reason string"), str(tmp_path / "out")) == 1


def test_event_windows_on_streams(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' k union all select timestamp'2024-01-01 00:20:00', 'a'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    q = streams.tumbling_counts(stream, F.col("ts"), "k", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbling").count() == 2


def test_birth_and_death_dates_never_leave_as_they_are(spark):
    df = spark.createDataFrame([("s1", "1961-05-06", "2011-02-03", "x")], "SUBJID string, BRTH string, DEATHDT string, __raw string")
    config = scrub.ScrubConfig(subject_id_fields=("SUBJID",), id_fields={"^SUBJID$": "S"}, birthdate_field="^BRTH$", death_date_fields=("^DEATHDT$",), age_fields=("^AGE$",), drop_fields=("^__raw$",))
    plan = scrub.scrub(df, config, KEY)
    row = plan.kept.first()
    assert plan.rules == {"SUBJID": "id", "BRTH": "date", "DEATHDT": "date", "__raw": "drop"} and "__raw" not in plan.kept.columns
    assert row["BRTH"] != "1961-05-06" and row["DEATHDT"] != "2011-02-03" and row["BRTH"][:2] == "19"
    with pytest.raises(ValueError, match="reserved"):
        scrub.scrub(df.withColumnRenamed("__raw", "__subject"), config, KEY)


@pytest.mark.parametrize(("cell", "mdy", "dmy", "none"), [("3/4/2014", "2014-03-04", "2014-04-03", None), ("13/4/2014", "2014-04-13", "2014-04-13", "2014-04-13"), ("030414", "2014-03-04", "2014-04-03", "2014-04-03"), ("03042014", "2014-03-04", "2014-04-03", None), ("2014-03-04", "2014-03-04", "2014-03-04", "2014-03-04"), ("20140304", "2014-03-04", "2014-03-04", "2014-03-04"), ("x", None, None, None)])
def test_dates_that_leave_the_order_open(spark, cell, mdy, dmy, none):
    from shroud.functions import dates

    day = lambda locale: F.date_format(dates.parse_date(F.col("c"), locale)["d"], "yyyy-MM-dd")
    row = spark.createDataFrame([(cell,)], "c string").select(day("MDY"), day("DMY"), day(None), dates.is_ambiguous(F.col("c"))).first()
    assert tuple(row)[:3] == (mdy, dmy, none) and row[3] == (none is None and mdy is not None)


def test_header_rules():
    assert [policy.classify_header(h)[0] for h in ("FNAME", "LNAME", "INIT", "SIGN", "BANKNAME", "DL_NO", "ICFDT")] == ["drop"] * 6 + ["jitter_date"]
    assert policy.hard_rule("p_h_o_n_e") is None and policy.hard_rule(" Phone Number ")[0] == "D" and policy.hard_rule("phonenumber")[0] == "D"
    weaker = tuple(r for r in policy.WORD_RULES if r[0] != "direct_identifier")
    assert policy.weakened(["FNAME", "AGE"], policy.WORD_RULES, weaker) == ["FNAME"] and policy.weakened(["FNAME"], policy.WORD_RULES, policy.rule_union(weaker)) == []
    found = policy.rule_union([("extra", "drop", ("^q$",)), policy.WORD_RULES[0]])
    assert len(found) == len(policy.WORD_RULES) + 1 and policy.classify_header("q", found)[0] == "drop"


def test_every_guard_pattern_against_plain_search(spark):
    """First matches and offsets of the whole packs on a fixture, against Python's re over ASCII text."""
    import re

    from shroud.functions.patterns import BLOCKING, GUARD_US, SPAN_RULES, first_match

    texts = ["MRN: AB12345 seen", "medical record number 4477881", "ACCOUNT NUMBER 99X1234 and acct required", "MEMBER ID: ZZ10203", "UID 12-3456", "123-45-6789 or 212-555-0100", "a.b@c.org see https://x.org/a?b=1", "10.0.0.1 age 93",
             "NPI 1234567893 vehicle 1HGCM82633A004352", "plate ABC-1234", "fax: (212) 555-0100", "2001-02-03 and 02/03/2001", "SNAB12345678 photo a/b.jpg", "NCT01234567 Dr. Ann Lee, 12 Main Street", "ZIP 90210 age 95", "nothing at all", "", "(01)12345678901234 IMEI 490154203237518"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    rules = {p.name + str(i): p for i, p in enumerate((*GUARD_US, *BLOCKING, *SPAN_RULES)) if p.luhn_prefix is None}
    got = df.select("i", *[first_match(p, F.col("c")).alias(n) for n, p in rules.items()]).collect()
    for r in got:
        for n, p in rules.items():
            m = re.search(p.regex, texts[r["i"]], re.ASCII)
            assert r[n] == (m[0] if m else None), (n, texts[r["i"]])
    spans = df.select("i", detect.detect_spans(F.col("c")).alias("s")).collect()
    for r in spans:
        want = {(m.start(), m.end(), p.name) for p in SPAN_RULES if p.luhn_prefix is None for m in re.finditer(p.regex, texts[r["i"]], re.ASCII)}
        assert {(s["start"], s["end"], s["entity"]) for s in r["s"] if s["entity"] != "NPI"} == want


def test_a_span_that_replaces_another_is_compared_last(spark):
    s = lambda a, b, e, c, conf: {"start": a, "end": b, "value": "", "entity": e, "category": c, "confidence": conf, "is_rule": False}
    df = spark.createDataFrame([([s(0, 10, "a", "A", 0.5), s(2, 4, "b", "B", 0.4), s(5, 10, "c", "C", 0.9), s(20, 22, "d", "A", 0.1)],), (None,)], f"s {detect.spans_type()}")
    got = df.select(detect.union_spans(F.col("s"), F.array().cast(detect.spans_type())).alias("m")).collect()
    assert [(x["start"], x["entity"]) for x in got[0]["m"]] == [(5, "c"), (20, "d")] and got[1]["m"] == []


def test_leaked_passages_of_any_length(spark):
    cells = spark.createDataFrame([(1, "The quick brown fox"), (2, "xy z"), (None, "quick brown"), (3, None)], "id long, text string")
    passages = spark.createDataFrame([("he quick brown f",), ("y z",), ("Z",), ("",), (None,), ("quick brown",)], "p string")
    got = sorted((str(r["id"]), r["passage"]) for r in verify.leak_passages(cells, "id", "text", passages, "p", block=1).collect())
    assert got == [("1", "he quick brown f"), ("1", "quick brown"), ("2", "y z"), ("2", "z"), ("None", "quick brown")]

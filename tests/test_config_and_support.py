from __future__ import annotations

import pytest

from shroud.operators import scrub, study_config, support
from shroud.operators.study_config import ConfigError

KEY = b"test key"
BASE = {"subject_id_fields": ["SUBJID"], "drop_fields": ["NAME"], "generalize_fields": {"MARITAL": {"married": "partnered", "single": "alone"}}, "id_fields": {"^SUBJID$": "SUBJ"}, "age_cap": 89}


def test_mappings_merge_and_lists_replace():
    raw, origin = study_config.merge([("packaged", BASE), ("site", {}), ("study", {"drop_fields": ["PHONE"], "generalize_fields": {"MARITAL": {"single": "one"}, "SITE": {}}, "age_cap": 85})])
    assert raw["drop_fields"] == ["PHONE"] and raw["generalize_fields"] == {"MARITAL": {"married": "partnered", "single": "one"}, "SITE": {}} and raw["age_cap"] == 85
    assert origin["drop_fields"] == origin["generalize_fields.MARITAL.single"] == origin["age_cap"] == origin["generalize_fields.SITE"] == "study"
    assert origin["generalize_fields.MARITAL.married"] == origin["subject_id_fields"] == "packaged"
    assert BASE["generalize_fields"]["MARITAL"]["single"] == "alone"
    swapped, where = study_config.merge([("a", {"x": {"y": 1}}), ("b", {"x": 2}), ("c", {"x": {"z": 3}})])
    assert swapped == {"x": {"z": 3}} and where == {"x.z": "c"}


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"drop_fields": ["("]}, "no pattern"),
        ({"drop_fields": "NAME"}, "not a list"),
        ({"subject_id_fields": []}, "empty"),
        ({"drop_feilds": []}, "unknown key"),
        ({"age_cap": "89"}, "whole number"),
        ({"max_jitter_days": 0}, "whole number"),
        ({"generalize_fields": {"X": "y"}}, "mapping of codes"),
        ({"band_fields": {"X": [[5, "a"], [3, "b"]]}}, "rising bands"),
        ({"id_fields": {"X": "no label"}}, "no label"),
        ({"date_locale": "YMD"}, "locale"),
        ({"future_date_policy": "keep"}, "future_date_policy"),
        ({"birthdate_field": "("}, "no pattern"),
    ],
)
def test_faults_are_fatal(change, said):
    with pytest.raises(ConfigError, match=said):
        study_config.build(BASE | change)


def test_all_faults_are_told_at_once():
    assert len(study_config.faults({"drop_fields": ["("], "age_cap": -1, "zzz": 1})) == 4


def test_files_are_loaded_and_used(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"subject_id_fields":["SUBJID"],"drop_fields":["NAME"]}')
    (tmp_path / "b.json").write_text('{"cap_fields":["AGE"]}')
    config, origin = study_config.load(spark, [f"file://{tmp_path}/{n}.json" for n in "ab"])
    df = spark.createDataFrame([("s1", "Ann", "95")], "SUBJID string, NAME string, AGE string")
    assert scrub.scrub(df, config, KEY).kept.first().asDict() == {"SUBJID": "s1", "AGE": "90+", scrub.MARKER: "v3"} and origin["cap_fields"].endswith("b.json")
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(ConfigError, match="not JSON"):
        study_config.load(spark, [f"file://{tmp_path}/c.json"])


def test_synthesis_holds_what_has_no_map(spark):
    classified = [("SUBJID", "pseudonymize"), ("VISDAT", "jitter_date"), ("Site (1)", "generalize"), ("F_NAME", "drop"), ("AGE", "cap"), ("N", "suppress"), ("ARM", "keep"), ("M", "generalize")]
    made = study_config.synthesize(classified, {"m": {"1": "one"}})
    config = study_config.build(study_config.extend(BASE, made))
    assert config.drop_fields == ("NAME", "^F_NAME$") and config.id_fields == {"^SUBJID$": "SUBJID"} and config.generalize_fields["^Site\\ \\(1\\)$"] == {}
    df = spark.createDataFrame([("s1", "x", "1"), ("s2", "", "1"), ("s3", "", "2")], "SUBJID string, `Site (1)` string, M string")
    plan = scrub.scrub(df, config, KEY)
    assert plan.kept.count() == 1 and sorted(r["reason"] for r in plan.quarantine.collect()) == ["generalize:M", "generalize:Site (1)"]
    assert [h for h in ("ARM", "AGE", "x", "Site (1)", "N") if study_config.acts_on(config, h)] == ["AGE", "Site (1)", "N"]
    with pytest.raises(ConfigError):
        study_config.synthesize([("X", "burn")])


def evidence(spark, cells, headers=(("d1", "h1", "SexCode"), ("d2", "h2", "sex_code"), ("d2", "h3", "ARM"))):
    h = spark.createDataFrame([(d, "sha" + d, i, r) for d, i, r in headers], "dataset string, dataset_sha string, header_id string, raw_name string")
    c = spark.createDataFrame(cells, "artifact string, row int, column int, value string")
    return h, c, c.select("artifact").distinct().selectExpr("artifact", "concat('sha', artifact) artifact_sha")


def dictionary(artifact, rows):
    return [(artifact, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


CODES = [["sex code", "1", "male"], ["sex code", "2", " female "], ["arm", "1", "drug"], ["sex code", "", "x"], [None, "9", "y"]]
NONE = "link_id string, basis string, level string"


def maps(spark, headers, cells, artifacts, decisions=None):
    links = support.decided(support.dictionary_links(headers, cells, artifacts), decisions or spark.createDataFrame([], NONE))
    return {(r["map_name"], r["code"], r["label"]) for r in support.support_maps(support.code_entries(links, headers, cells)).collect()}


def test_maps_follow_from_dictionaries(spark):
    assert maps(spark, *evidence(spark, dictionary("a", CODES))) == {("sexcode", "1", "male"), ("sexcode", "2", "female"), ("sex_code", "1", "male"), ("sex_code", "2", "female"), ("arm", "1", "drug")}


def test_conflicts_leave_no_map(spark):
    within = dictionary("a", [*CODES, ["sex code", "1", "M"]])
    assert maps(spark, *evidence(spark, within)) == {("arm", "1", "drug")}
    across = dictionary("a", CODES) + dictionary("b", [["arm", "1", "placebo"]])
    assert {m for m, _, _ in maps(spark, *evidence(spark, across))} == {"sexcode", "sex_code"}
    part = dictionary("a", CODES) + dictionary("b", [["arm", "1", "drug"], ["arm", "2", "none"]])
    assert "arm" not in {m for m, _, _ in maps(spark, *evidence(spark, part))}
    assert maps(spark, *evidence(spark, dictionary("a", [["sex code", "1"]]))) == set()


def test_decisions_hold_while_their_basis_does(spark):
    h, c, a = evidence(spark, dictionary("a", CODES))
    links = support.dictionary_links(h, c, a)
    ignored = links.selectExpr("link_id", "basis", "'ignored' level")
    assert maps(spark, h, c, a, ignored) == set() and support.stale(links, ignored).count() == 0
    newer = a.selectExpr("artifact", "'other' artifact_sha")
    assert len(maps(spark, h, c, newer, ignored)) == 5 and support.stale(support.dictionary_links(h, c, newer), ignored).count() == 2


def test_companions_are_needed_and_wait_for_a_decision(spark):
    d = spark.createDataFrame([("d1", "x", "demo1"), ("d2", "x", "vs2a"), ("d3", "x", "lab")], "dataset string, dataset_sha string, stem string")
    f = spark.createDataFrame([("f1", "y", "demo1"), ("f2", "y", "vs2_form"), ("f3", "y", "lab_a"), ("f4", "y", "lab_b")], "artifact string, artifact_sha string, stem string")
    d = d.withColumn("stem", d["stem"])
    links = support.companion_links(d.replace("vs2a", "vs2_x", "stem"), f)
    assert {(r["dataset"], r["artifact"], r["level"]) for r in links.collect()} == {("d1", "f1", "required"), ("d2", "f2", "required")}
    assert {r["eligible"] for r in support.decided(links, spark.createDataFrame([], NONE)).collect()} == {False}
    assert {r["eligible"] for r in support.decided(links, links.selectExpr("link_id", "basis", "'required' level")).collect()} == {True}

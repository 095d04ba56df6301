from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shroud.operators import header_review, policy
from shroud.sources import work


def forms(spark):
    rows = [("a", 1, "hemoglobin"), ("a", 2, "phone_no_text"), ("a", 3, "gps point"), ("a", 4, "whatsapp"), ("b", 1, "SubjId"), ("b", 2, "subj_id"), ("b", 3, None), ("c", 1, "fname"), ("c", 2, "weight_kg")]
    return spark.createDataFrame(rows, "form string, position int, header string")


SIGNALS = "form string, header string, has_question boolean, is_phi boolean, sot_phi string"


def test_forms_are_held_and_names_dropped(spark):
    signals = spark.createDataFrame([("a", "GPS POINT", True, False, None), ("a", "whatsapp", True, False, None), ("c", "weight_kg", True, False, "drop")], SIGNALS)
    got = {(r["form"], r["position"]): r for r in header_review.review_headers(forms(spark), signals).collect()}
    assert {k for k, r in got.items() if r["force_drop"]} == {("a", 2), ("a", 4), ("c", 1), ("c", 2)}
    assert {k[0] for k, r in got.items() if r["status"] == "held"} == {"b"}
    assert got["b", 1]["reasons"] == "duplicate normalized header: subj_id; blank header at position 3"
    kept = spark.createDataFrame([("c", "fname"), ("a", "whatsapp")], "form string, header string")
    again = {(r["form"], r["position"]): r["force_drop"] for r in header_review.review_headers(forms(spark), signals, kept).collect()}
    assert not again["c", 1] and not again["a", 4]
    said = spark.createDataFrame([("a", "whatsapp", True, False, "keep")], SIGNALS)
    assert not {(r["form"], r["position"]): r["force_drop"] for r in header_review.review_headers(forms(spark), said).collect()}["a", 4]


def test_rules_that_fail_a_probe_hold_every_form(spark):
    assert header_review.probe_failures() == []
    weak = tuple(r for r in policy.WORD_RULES if r[0] != "date")
    rows = header_review.review_headers(forms(spark), spark.createDataFrame([], SIGNALS), rules=weak).collect()
    assert {r["status"] for r in rows} == {"held"} and all("synthetic_visit_date_header" in r["reasons"] for r in rows)


def test_empty_tables(spark):
    none = forms(spark).where(F.lit(False))
    assert header_review.review_headers(none, spark.createDataFrame([], SIGNALS)).collect() == []
    words = spark.createDataFrame([], "word string")
    assert header_review.gate(spark.createDataFrame([], "t string"), "t", words, words, words).collect() == []


def test_lexicon_gate(spark):
    texts = ["Pulmonary Cavity", "John Miller", "Green Field", "Sputum Culture Pending", "seen 1/2/2020", "Cavity", "John Smith Cavity Green Field", "mail a@b.example.org", "", None, "John Miller"]
    words = spark.createDataFrame([(w,) for w in ("pulmonary", "Cavity ", "x" * 99, None)], "word string")
    phrases = spark.createDataFrame([("sputum culture pending",)], "p string")
    names = spark.createDataFrame([("John",), ("smith",)], "n string")
    got = {r["text"]: (r["blocked"], r["warned"]) for r in header_review.gate(spark.createDataFrame([(x,) for x in texts], "t string"), "t", words, phrases, names).collect()}
    assert got == {
        "Pulmonary Cavity": ("", ""), "John Miller": ("", "PERSON_NAME_GENERIC"), "Green Field": ("", ""), "Sputum Culture Pending": ("", ""), "seen 1/2/2020": ("", "DATE_MDY"),
        "Cavity": ("", ""), "John Smith Cavity Green Field": ("", ""), "mail a@b.example.org": ("EMAIL", ""), "": ("", ""),
    }


@pytest.mark.parametrize(
    ("header", "pattern", "fault"),
    [
        ("PtName", r"pt[_ ]name", None),
        ("PtName", "(", "does not compile"),
        ("PtName", "^.*$", "over-broad"),
        ("PtName", "phone", "does not match its own header"),
        ("arm_name", "arm", "matches a benign header"),
        ("PtName", r"(a+)+name", "cost is not bounded"),
        ("PtName", r"(?:a*b*){2,}name", "cost is not bounded"),
        ("PtName", "n" * 500, "cost is not bounded"),
        ("ab_cd", r"(ab|cd)+", None),
    ],
)
def test_pattern_faults(header, pattern, fault):
    assert header_review.pattern_fault(header, pattern) == fault


def test_rule_safety_against_the_rulebook(spark):
    rows = [(1, "PtName", "pt_name", "drop", "r1"), (2, "PtName", "pt_name", "keep", "r1"), (3, "PtName", "pt_name", "drop", "r9"), (4, "x", ".*", "zap", None), (5, None, None, None, "r1")]
    proposals = spark.createDataFrame(rows, "proposal_id int, header string, pattern string, action string, rule_id string")
    book = spark.createDataFrame([("r1", "drop")], "rule_id string, action string")
    got = {r["proposal_id"]: (r["ok"], r["errors"]) for r in header_review.rule_safety(proposals, book).collect()}
    assert got == {1: (True, ""), 2: (False, "action is not the rule's"), 3: (False, "rule is not in the rulebook"), 4: (False, "unknown action; over-broad; rule is not in the rulebook"), 5: (False, "unknown action; over-broad; action is not the rule's")}


def test_digest_of_rules_does_not_depend_on_their_order():
    union = policy.rule_union([("extra", "drop", ("zz",))])
    assert header_review.rules_digest(union) == header_review.rules_digest(tuple(reversed(union))) != header_review.rules_digest(policy.WORD_RULES)


def test_white_space_in_names_counts_as_one_underscore():
    assert all(policy.hard_rule(n)[1] == "drop" for n in ("Patient  Name", "patient\tname", " home  phone "))
    fixed = policy.apply_hard_rules([policy.Decision("Visit  Date", "keep"), policy.Decision("ssn", "drop", "A"), policy.Decision("other", "keep", "Z")])
    assert [(d.action, d.category) for d in fixed] == [("year_only", "C"), ("drop", "G"), ("keep", "Z")]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        work.work_path(Session(), "x")

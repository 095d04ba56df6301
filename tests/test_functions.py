from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from shroud.functions import dates, hashing, numeric, patterns, text

KEY = b"k" * 70


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_hmac_equals_python(spark):
    got = column(spark, ["a", "", "ü" * 100, None], lambda c: hashing.hmac_sha256(KEY, c))
    assert got == [hmac.new(KEY, v.encode(), hashlib.sha256).hexdigest() for v in ("a", "", "ü" * 100)] + [None]


def test_offset_and_tokens(spark):
    digest = hmac.new(b"key", b"s1", hashlib.sha256).digest()
    assert column(spark, ["s1"], lambda c: hashing.offset_days(b"key", c, 30)) == [int.from_bytes(digest[:4], "big") % 61 - 30]
    token = hmac.new(b"key", b"FORM:s1", hashlib.sha256).hexdigest()[:12].translate(str.maketrans("0123456789abcdef", "abcdefghijklmnop"))
    assert column(spark, ["s1"], lambda c: hashing.record_token(b"key", "FORM", c)) == [f"RID_FORM_{token}"]
    assert column(spark, ["v"], lambda c: hashing.pseudonym("s", c)) == ["P" + hashlib.sha256(b"s:v").hexdigest()[:8]]


def test_cell_actions(spark):
    assert column(spark, ["89", "90", "4.5", "90-95", "N/A", "", None, "007"], numeric.cap_age) == ["89", "90+", "45", "", "", "", None, "7"]
    assert column(spark, ["1985-03-14", "3/14/85", "12/2004"], text.year_only) == ["1985", "", "2004"]
    assert column(spark, ["93701", "03601", "K1A 0B1", "9"], text.zip3) == ["937", "000", "101", "900"]
    assert column(spark, ["89", "90", "ninety"], numeric.cap_numeric) == ["89", "90+", "ninety"]
    assert column(spark, ["3", "9", "x", " 7 "], numeric.clamp) == ["3", "5", "x", "5"]
    assert column(spark, ["=1", "a", "-x", "\tq", ""], text.neutralise_formula) == ["'=1", "a", "'-x", "'\tq", ""]
    assert column(spark, ["abcd", "abcdef", ""], text.mask_sample) == ["****", "ab**ef", ""]
    assert column(spark, ["VisitDate", "a  b-C", "__x__"], text.normalize_header) == ["visit_date", "a_b_c", "x"]
    assert [text.normalize_name(x) for x in ("VisitDate", "a  b-C", "__x__")] == ["visit_date", "a_b_c", "x"]


def test_coercion_is_strict(spark):
    assert column(spark, ["1", " -2.5e1 ", "5d", "1_000", "nan", "", None, ".5"], numeric.coerce_numeric) == [1.0, -25.0, None, None, None, None, None, 0.5]


def test_luhn(spark):
    assert column(spark, ["4111111111111111", "4111111111111112", "x", ""], numeric.luhn_valid) == [True, False, False, False]


def test_dates(spark):
    shift = lambda c: dates.shift_date(c, F.lit(2))
    cells = ["2014-02-27", "2014-07-28 14:30:00", "7/28/14", "28-05-2014", "20030612", "2014-02-30", "13/13/2014", "7/28-2014", "junk", "", None]
    assert column(spark, cells, shift) == ["2014-03-01", "2014-07-30 00:00:00", "7/30/2014", "30/5/2014", "2003-06-14", None, None, None, None, None, None]
    assert column(spark, ["7/28/14 3:00 PM"], shift) == ["7/30/2014 12:00:00 PM"]
    assert column(spark, ["99999999", "9/9/99", "//", "unk", "2014-01-01", None], dates.is_placeholder) == [True, False, True, True, False, True]


def test_bands(spark):
    bands = ((10, "low"), (20, "high"))
    assert column(spark, ["3", "10", "11", "21", "x"], lambda c: numeric.band(c, bands)) == ["low", "low", "high", None, None]


def test_conditional_patterns(spark):
    age = next(p for p in patterns.GUARD_US if p.name == "AGE_OVER_89")
    assert column(spark, ["pulse 95", "age 95"], lambda c: patterns.fires(age, c, None)) == [None, "95"]
    assert column(spark, ["95"], lambda c: patterns.fires(age, c, "C")) == ["95"]

"""Spans of identifiers in text: detection, merging and replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.numeric import luhn_valid
from shroud.functions.patterns import SPAN_RULES, Pattern, match_count, may_match

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_rule", T.BooleanType()),
    ]
)
SPANS = T.ArrayType(SPAN)


def _spans_of(rule: Pattern, text: Column, confidence: float) -> Column:
    """Matches with offsets: what lies between two matches and the matches themselves add up to places."""
    gaps = F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g))
    found = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans_type()).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["m"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), x["m"].alias("value"), F.lit(rule.name).alias("entity"), F.lit(rule.category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(True).alias("is_rule")
        ).cast(SPAN.simpleString())
        counts = x["m"].isNotNull()
        if rule.luhn_prefix is not None:
            counts = counts & luhn_valid(F.concat(F.lit(rule.luhn_prefix), x["m"]))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(counts, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(may_match(rule, text) & text.rlike(rule.regex), F.aggregate(found, start, step)["out"]).otherwise(F.array().cast(spans_type()))


def detect_spans(text: Column, rules: Sequence[Pattern] = SPAN_RULES, confidence: float = 0.99) -> Column:
    """Spans of every rule, whole match as value, by built-in functions only; a null text has none."""
    return F.flatten(F.array(*[_spans_of(r, text, confidence) for r in rules]))


def union_spans(*found: Column) -> Column:
    """Spans of several detectors, settled as one list."""
    return merge_spans(F.concat(*[F.coalesce(f, F.array().cast(spans_type())) for f in found]))


def merge_spans(spans: Column) -> Column:
    """Overlaps settled from left to right: with the first kept span of the same category, or of which
    60 % of the shorter overlaps, the one with the higher confidence stays, rules before others; one
    that takes another's place is compared last with what follows. The result is in order of start."""
    ordered = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s.alias("s")))
    ordered = F.transform(F.array_sort(ordered), lambda o: o["s"])

    def overlap(a: Column, b: Column) -> Column:
        return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])

    def step(kept: Column, s: Column) -> Column:
        def clashes(k: Column) -> Column:
            shared = overlap(k, s)
            shorter = F.least(k["end"] - k["start"], s["end"] - s["start"])
            return (shared > 0) & (k["category"].eqNullSafe(s["category"]) | (shared >= shorter * 0.6))

        first = F.get(F.filter(kept, clashes), F.lit(0))
        better = (s["confidence"] > first["confidence"]) | ((s["confidence"] == first["confidence"]) & s["is_rule"] & ~first["is_rule"])
        same = lambda k: (k["start"] == first["start"]) & (k["end"] == first["end"]) & (k["entity"] == first["entity"])
        replaced = F.concat(F.filter(kept, lambda k: ~same(k)), F.array(s))
        return F.when(first.isNull(), F.concat(kept, F.array(s))).when(better, replaced).otherwise(kept)

    return F.array_sort(F.aggregate(ordered, F.array().cast(spans_type()), step))


def spans_type() -> str:
    return SPANS.simpleString()


def replace_spans(text: Column, spans: Column, tag=lambda s: F.concat(F.lit("["), F.coalesce(s["category"], F.lit("X")), F.lit("]"))) -> Column:
    """Each span, which must not overlap the next, replaced by its tag."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag(s)).alias("out"), s["end"].alias("at")),
        ).otherwise(acc),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def scrub(text: Column) -> Column:
    """Detect, merge and replace by category; null stays null."""
    return F.when(text.isNotNull(), replace_spans(text, merge_spans(detect_spans(text))))


def redact_accepted(text: Column, spans: Column, accepted: Column | None = None) -> Column:
    """Tags that name category and kind."""
    keep = spans if accepted is None else F.filter(spans, lambda s: F.array_contains(accepted, s["entity"]))
    return replace_spans(text, keep, lambda s: F.concat_ws(":", F.lit("[REDACTED"), s["category"], F.concat(s["entity"], F.lit("]"))))


def replace_in_order(text: Column, rules: Sequence[Pattern]) -> Column:
    """A fast path for rules that cannot match in each other's tags: replaced rule by rule, no Python."""
    for r in rules:
        text = F.regexp_replace(text, r.regex, f"[{r.category}]")
    return text


def match_counts(text: Column, rules: Sequence[Pattern]) -> list[Column]:
    """Number of matches a rule, as built-in expressions."""
    return [match_count(r, text).alias(r.name) for r in rules]

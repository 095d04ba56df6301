"""Review of forms by their headers, clinical lexicons, and safety of proposed header rules.

Headers are classified once each, whatever forms hold them. Lexicons are tables: texts meet them by their tokens,
and a side is broadcast only after its size was checked. A proposed rule is tried on a bounded list of probes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.patterns import BLOCKING, WARN, is_hit
from shroud.functions.text import normalize_header
from shroud.operators.policy import WORD_RULES, classify_header

# Tokens of header names that look like personal data.
RISKY_TOKENS = frozenset(
    "name fname lname surname maiden initials remark remarks note notes comment comments narrative verbatim specify describe description phone mobile telephone fax email whatsapp "
    "address street village locality landmark pincode gps latitude longitude geocode passport mrn ssn dob dod".split()
)
# Parts of header names that look like personal data.
RISKY_PARTS = ("free_text", "freetext", "e_mail", "phone_number", "mobile_number", "contact_person", "national_id", "birth_date", "date_of_birth", "death_date", "date_of_death")
# Tokens and parts that name a person or how to reach one, which a printed question does not clear.
STRONG_TOKENS = frozenset("name fname lname surname maiden initials phone mobile telephone fax email whatsapp passport mrn ssn".split())
STRONG_PARTS = ("e_mail", "phone_number", "mobile_number", "national_id", "signature", "sign")
# Headers that the rules must classify so, or every form is held.
PROBES = {"synthetic_participant_id_header": "pseudonymize", "synthetic_visit_date_header": "jitter_date", "synthetic_email_header": "drop", "synthetic_culture_result_header": "keep"}
# Headers that a proposed rule must not match.
BENIGN = ("totally_unrelated_benign_measure_value", "hemoglobin_result", "culture_status_code", "visit_number", "treatment_arm", "weight_kg")
# Patterns that match everything.
CATCH_ALL = frozenset(("", ".*", ".+", "(.*)", "(.+)", ".*?", "(.*)?"))

Rules = Sequence[tuple[str, str, Sequence[str]]]
#: Rows up to which a lexicon is broadcast, and characters of its words.
LEXICON_ROWS, WORD_CHARS = 200_000, 64


def names_any(normalized: Column, tokens: frozenset[str], parts: Sequence[str]) -> Column:
    """Whether a normalised header has one of the tokens or holds one of the parts."""
    out = F.arrays_overlap(F.split(normalized, "_"), F.array(*[F.lit(t) for t in sorted(tokens)]))
    for p in parts:
        out = out | normalized.contains(p)
    return F.coalesce(out, F.lit(False))


def is_risky(normalized: Column) -> Column:
    return names_any(normalized, RISKY_TOKENS, RISKY_PARTS)


def is_strong(normalized: Column) -> Column:
    return names_any(normalized, STRONG_TOKENS, STRONG_PARTS)


def probe_failures(rules: Rules = WORD_RULES) -> list[str]:
    """Probe headers that the rules classify otherwise."""
    return [h for h, action in PROBES.items() if classify_header(h, rules)[0] != action]


def actions(headers: DataFrame, header: str = "header", rules: Rules = WORD_RULES) -> DataFrame:
    """(header, action) of the distinct headers."""

    def classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"header": f["header"], "action": [classify_header(h, rules)[0] for h in f["header"]]})

    return headers.select(F.col(header).alias("header")).where("header is not null").distinct().mapInPandas(classify, "header string, action string")


def review_headers(headers: DataFrame, signals: DataFrame, confirmed: DataFrame | None = None, rules: Rules = WORD_RULES) -> DataFrame:
    """(form, position, header, action, force_drop, status, reasons) of ``headers`` (form, position, header).

    ``signals``: (form, header, has_question, is_phi, sot_phi) from the forms' printed questions; ``confirmed``: (form,
    header) that a human keeps. A kept header with a risky name is dropped unless a question clears it, which a
    strong name needs the source's own word for; so is one that the rules drop, or the source does. A form is held
    where a header is blank, two are the same after normalising, or the rules fail a probe.
    """
    rows = headers.select("form", "position", "header", F.coalesce(normalize_header(F.col("header")), F.lit("")).alias("_norm"))
    first = F.row_number().over(Window.partitionBy("form", "_norm").orderBy("position")) == 1
    rows = rows.withColumn("_repeat", ~first & (F.col("_norm") != ""))
    told = signals.select("form", F.upper("header").alias("_upper"), "has_question", "is_phi", "sot_phi").dropDuplicates(["form", "_upper"])
    met = rows.join(actions(rows, rules=rules), "header", "left").withColumn("action", F.coalesce("action", F.lit("keep")))
    met = met.withColumn("_upper", F.upper("header")).join(told, ["form", "_upper"], "left")
    kept = F.lit(False)
    if confirmed is not None:
        met = met.join(confirmed.select("form", "header", F.lit(True).alias("_kept")).distinct(), ["form", "header"], "left")
        kept = F.coalesce("_kept", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    source = F.coalesce("sot_phi", F.lit(""))
    cleared = yes("has_question") & ~yes("is_phi") & (~is_strong(F.col("_norm")) | (source != ""))
    force = (source == "drop") | ((F.col("action") == "drop") & ~kept) | ((F.col("action") == "keep") & is_risky(F.col("_norm")) & ~cleared & ~kept)
    fault = F.when(F.col("_norm") == "", F.concat(F.lit("blank header at position "), F.col("position").cast("string"))).when(F.col("_repeat"), F.concat(F.lit("duplicate normalized header: "), F.col("_norm")))
    faults = rows.select("form", "position", fault.alias("fault")).where("fault is not null")
    by_form = faults.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "fault"))), lambda x: x["fault"]).alias("reasons"))
    failed = F.array(*[F.lit(f"adversarial header probe failed: {h}") for h in probe_failures(rules)]).cast("array<string>")
    out = met.join(by_form, "form", "left").withColumn("reasons", F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), failed)))
    return out.select("form", "position", "header", "action", force.alias("force_drop"), F.when(F.size("reasons") > 0, "held").otherwise("approved").alias("status"), F.array_join("reasons", "; ").alias("reasons"))


def _lexicon(words: DataFrame, word: str) -> DataFrame:
    listed = words.select(F.lower(F.trim(F.col(word))).alias("token")).where(F.length("token").between(1, WORD_CHARS)).distinct()
    return F.broadcast(listed) if listed.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS else listed


def lexicon_hits(texts: DataFrame, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """(text, tokens, listed): distinct texts, their tokens, and how many of these the lexicon has."""
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    tokens = distinct.select("text", F.explode(F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda t: t != "")).alias("token"))
    met = tokens.join(_lexicon(words, word).withColumn("_in", F.lit(1)), "token", "left")
    return met.groupBy("text").agg(F.count(F.lit(1)).alias("tokens"), F.count("_in").alias("listed"))


def clinical_texts(texts: DataFrame, text: str, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """The distinct texts that are clinical: a listed phrase, or two and more tokens that are all listed words."""
    by_words = lexicon_hits(texts, text, words).where("tokens >= 2 and listed = tokens").select("text")
    wanted = phrases.select(F.lower(F.trim(F.col(phrases.columns[0]))).alias("_phrase")).where("_phrase <> ''").distinct()
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    return by_words.unionByName(distinct.join(wanted, F.lower(F.trim("text")) == F.col("_phrase"), "left_semi")).distinct()


def gate(texts: DataFrame, text: str, words: DataFrame, phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(text, blocked, warned) of the distinct texts: blocking patterns always count, warnings not in clinical texts,
    and a person's name only where a token of a text of two to four is a listed name."""
    clinical = clinical_texts(texts, text, words, phrases).withColumn("_clinical", F.lit(True))
    named = lexicon_hits(texts, text, names, names.columns[0]).where("listed > 0 and tokens between 2 and 4").select("text", F.lit(True).alias("_named"))
    rows = texts.select(F.col(text).alias("text")).where("text is not null").distinct().join(clinical, "text", "left").join(named, "text", "left")
    hit = lambda p: is_hit(p, F.col("text")) & (F.col("_named").isNotNull() if p.name == "PERSON_NAME_GENERIC" else F.lit(True))
    listed = lambda patterns: F.array_sort(F.array_compact(F.array(*[F.when(hit(p), F.lit(p.name)) for p in patterns])))
    warned = F.when(F.col("_clinical").isNotNull(), F.array().cast("array<string>")).otherwise(listed(WARN))
    return rows.select("text", F.array_join(listed(BLOCKING), ",").alias("blocked"), F.array_join(warned, ",").alias("warned"))


#: A proposed pattern longer than this, or with a repeated group that repeats inside, is not tried: its cost has no bound.
PATTERN_CHARS = 400
REPEATS_INSIDE = re.compile(r"\((?:[^()\\]|\\.)*[*+](?:[^()\\]|\\.)*\)\s*(?:[*+]|\{\d*,)")


def pattern_fault(header: str, pattern: str, benign: Sequence[str] = BENIGN) -> str | None:
    """Why a proposed pattern for ``header`` is not safe; null if it is."""
    if len(pattern) > PATTERN_CHARS or REPEATS_INSIDE.search(pattern):
        return "cost is not bounded"
    try:
        found = re.compile(pattern, re.I)
    except re.error:
        return "does not compile"
    if pattern.strip().lstrip("^").rstrip("$").strip() in CATCH_ALL:
        return "over-broad"
    snake = re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", header).lower()).strip("_")
    if not any(found.search(x) for x in (snake, snake.replace("_", " "))):
        return "does not match its own header"
    return "matches a benign header" if any(found.search(x) for x in benign) else None


def rule_safety(proposals: DataFrame, rulebook: DataFrame, benign: Sequence[str] = BENIGN) -> DataFrame:
    """(proposal_id, ok, errors) of ``proposals`` (proposal_id, header, pattern, action, rule_id) against ``rulebook`` (rule_id, action)."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["fault"] = [pattern_fault(h or "", p or "", benign) for h, p in zip(f["header"], f["pattern"], strict=True)]
            yield f

    kind = proposals.schema["proposal_id"].dataType.simpleString()
    tried = proposals.select("proposal_id", "header", "pattern", "action", "rule_id").mapInPandas(check, f"proposal_id {kind}, header string, pattern string, action string, rule_id string, fault string")
    cited = tried.join(rulebook.select(F.col("rule_id"), F.col("action").alias("_cited")).dropDuplicates(["rule_id"]), "rule_id", "left")
    known = F.array(*[F.lit(a) for a in ("keep", "suppress", "cap", "generalize", "jitter_date", "pseudonymize", "drop")])
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.array_contains(known, F.col("action")), F.lit(False)), F.lit("unknown action")),
            F.col("fault"),
            F.when(F.col("_cited").isNull(), F.lit("rule is not in the rulebook")).when(~F.col("_cited").eqNullSafe(F.col("action")), F.lit("action is not the rule's")),
        )
    )
    return cited.select("proposal_id", (F.size(errors) == 0).alias("ok"), F.array_join(errors, "; ").alias("errors"))


def rules_digest(rules: Rules) -> str:
    """SHA-256 of the canonical JSON of a set of rules, whatever their order."""
    rows = sorted([name, action, sorted(patterns)] for name, action, patterns in rules)
    return hashlib.sha256(json.dumps(rows, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

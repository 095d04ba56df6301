"""Redaction of log lines and of many literals: each match is replaced by its own keyed digest.

Literals are dealt into blocks of bounded size by hash; a task reads its texts once with the automaton of one block,
and only the places found travel. Where places of any blocks overlap, the leftmost and then the longest counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.hashing import hmac_sha256
from shroud.functions.patterns import BLOCKING, SUBJECT_ID, WARN, Pattern, may_match
from shroud.functions.text import mask_sample

# Shapes of providers' access keys, which are looked for first.
ACCESS_KEYS = (
    Pattern("ANTHROPIC_KEY", r"sk-ant-[A-Za-z]+\d*-[A-Za-z0-9_\-]{20,}", needs=("sk-ant-",)),
    Pattern("OPENAI_KEY", r"sk-(?:proj-)?[A-Za-z0-9]{40,}", needs=("sk-",)),
    Pattern("NVIDIA_KEY", r"nvapi-[A-Za-z0-9_\-]{30,}", needs=("nvapi-",)),
    Pattern("GOOGLE_KEY", r"AIza[A-Za-z0-9_\-]{35}", needs=("AIza",)),
)
#: Characters of a literal: shorter ones say nothing, longer ones are no identifiers; so a block's size is bounded.
SHORTEST, LONGEST = 4, 256


def keyed(pattern: str, text: Column, key: bytes, label: str) -> Column:
    """The text with each match replaced by ``<label_`` and 8 digits of its digest ``>``."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(f"<{label}_"), F.substring(hmac_sha256(key, m), 1, 8), F.lit(">")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), tags, lambda t, g: F.concat(t, F.coalesce(g, F.lit("")))), "")


def redact_line(text: Column, key: bytes, subjects: Sequence[Pattern] = SUBJECT_ID, generic: Sequence[Pattern] = ACCESS_KEYS + BLOCKING + WARN) -> Column:
    """A log line with subject ids as keyed tags and then every pattern, in order, as its name; null for null."""
    for p in subjects:
        text = F.when(may_match(p, text), keyed(p.regex, text, key, "SUBJ")).otherwise(text)
    for p in generic:
        text = F.regexp_replace(text, p.regex, f"<{p.name}>")
    return text


def mask_telemetry(text: Column, patterns: Sequence[Pattern] = BLOCKING + WARN) -> Column:
    """Every match of every pattern, in order, as ``[REDACTED]``."""
    for p in patterns:
        text = F.regexp_replace(text, p.regex, "[REDACTED]")
    return text


def find_literals(df: DataFrame, row_id: str, text: str, literals: DataFrame, literal: str, fold: bool = False, block: int = 50_000) -> DataFrame:
    """(id, digest, start, end, literal): at each place of each text the longest literal of a block that begins there.

    ``digest`` is of the text, so rows without an id, or of one id, are told apart by what they say. ``fold``:
    letters in either case, as lower-cased by Spark; literals come back so.
    """
    form = (lambda c: F.lower(c)) if fold else (lambda c: c)
    wanted = literals.select(form(F.col(literal).cast("string")).alias("literal")).where(F.length("literal").between(SHORTEST, LONGEST)).distinct()
    rows = df.select(F.col(row_id).alias("id"), F.sha2(F.col(text), 256).alias("digest"), form(F.col(text)).alias("text")).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest string, start int, end int, literal string"
    blocks, out = -(-wanted.count() // block), None
    for i in range(blocks):
        part = [r[0] for r in wanted.where(F.pmod(F.xxhash64("literal"), F.lit(blocks)) == i).collect()]  # about ``block`` of them

        def search(frames: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for p in part:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for frame in frames:
                found = []
                for row, digest, t in zip(frame["id"], frame["digest"], frame["text"], strict=True):
                    best: dict[int, str] = {}
                    for last, p in automaton.iter(t) if part else ():
                        start = last - len(p) + 1
                        if len(p) > len(best.get(start, "")):
                            best[start] = p
                    found += [(row, digest, s, s + len(p), p) for s, p in best.items()]
                yield pd.DataFrame(found, columns=["id", "digest", "start", "end", "literal"]).astype({"start": "int32", "end": "int32"})

        hits = rows.mapInPandas(search, schema)
        out = hits if out is None else out.unionByName(hits)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def leftmost_longest(spans: Column) -> Column:
    """Of places (start, end), sorted by start and falling end, those that overlap none before."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))).otherwise(acc)

    return F.aggregate(spans, start, step)["out"]


def redact_literals(df: DataFrame, row_id: str, text: str, literals: DataFrame, literal: str, key: bytes, label: str = "LIT", fold: bool = False, block: int = 50_000) -> DataFrame:
    """``df`` with every literal in its texts replaced by its keyed tag, the digest of what stood there."""
    found = find_literals(df, row_id, text, literals, literal, fold, block)
    places = found.groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("_end"), "end"))).alias("_places"))
    places = places.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), leftmost_longest(F.col("_places")).alias("_spans"))
    met = df.join(places, F.col(row_id).eqNullSafe(F.col("_id")) & (F.sha2(F.col(text), 256) == F.col("_digest")), "left")
    spans, t = F.col("_spans"), F.col(text)
    piece = lambda a, b: F.substring(t, a + 1, b - a)
    tag = lambda s: F.concat(F.lit(f"<{label}_"), F.substring(hmac_sha256(key, piece(s["start"], s["end"])), 1, 8), F.lit(">"))
    parts = F.transform(spans, lambda s, i: F.concat(piece(F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]), s["start"]), tag(s)))
    made = F.concat(F.array_join(parts, ""), piece(F.element_at(spans, -1)["end"], F.length(t)))
    return met.select(*[F.when(spans.isNull(), t).otherwise(made).alias(c) if c == text else df[c] for c in df.columns])


def prompt_violations(prompts: DataFrame, row_id: str, text: str, literals: DataFrame, literal: str) -> DataFrame:
    """(id, literal): planted literals that a prompt still holds, in either case, masked."""
    found = find_literals(prompts, row_id, text, literals, literal, fold=True)
    return found.select("id", "literal").distinct().select("id", mask_sample(F.col("literal")).alias("literal"))

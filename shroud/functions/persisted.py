"""Replacement of identifiers in texts that are stored and shown: citations and legal terms stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is never replaced, citations before terms.
CITATION = r"(?i)\b\d{1,3}\s*C\.?\s*F\.?\s*R\.?\s*§?\s*\d+(?:\.\d+)*(?:\([a-zA-Z0-9]+\))*"
TERMS = r"(?i)\b(?:Social Security Number|Social Security|Safe Harbor|Protected Health Information|Medical Record Number|Date of Birth|Personally Identifiable Information|Privacy Rule|HIPAA)\b"

# Patterns in the order in which they replace, with what takes their place.
REPLACED: tuple[tuple[str, str], ...] = (
    (r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b", "[F]"),
    (r"\b(?:\+?\d{1,3}[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", "[D]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[G]"),
    (r"\b(?:MRN|mrn|Medical\s?Record(?:\s?Number)?|Chart(?:\s?ID)?|Account(?:\s?Number)?|Acct|HP|ACCT|DEV|UID)[\s#:\-]*[A-Z0-9]{4,}[\-A-Z0-9]{0,20}\b", "[H]"),
    (r"\bhttps?://[\w./\-?=&%+#:]{6,200}\b", "[N]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[O]"),
    (r"\b\d{1,6}[a-z]?\s+[A-Z][\w.\- ]{2,60}?\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Ter|Terrace|Cir|Circle|Hwy|Highway|Pkwy|Parkway)(?:\.|,|\b)", "[B]"),
    (r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b", "[C]"),
    (r"(?i)(?:(?:\bage(?:d)?\s+(?:of\s+)?)?(9\d|1[0-1]\d|1[2-9]\d)\s*(?:years?|yrs?|y/o|-?year[-\s]?old)\b|\bage(?:d)?\s+(?:of\s+)?(9\d|1[0-1]\d|1[2-9]\d)\b)", "[C-age]"),
    (r"\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b|\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b", "[A]"),
)
#: Stand-ins of what is kept; no pattern matches them, and texts that hold one keep it the same way.
KEPT_CITATION, KEPT_TERM = "\0", "\1"


def _unwrap(text: Column, mark: str, kept: Column) -> Column:
    """The text with each mark replaced by the kept part of its place."""
    pieces = F.zip_with(F.split(text, mark, -1), kept, lambda t, k: F.concat(t, F.coalesce(k, F.lit(""))))
    return F.array_join(pieces, "")


def scrub_persisted(text: Column) -> Column:
    """The text with identifiers replaced by their category, outside citations and terms; null for null.

    What is kept is taken out in two steps and leaves a mark of one character behind, so the ten patterns see
    where it was and never what it says; texts without a digit, ``@``, ``://`` or capital are not searched.
    """
    citations = f"{CITATION}|[{KEPT_CITATION}{KEPT_TERM}]"
    marked = F.regexp_replace(text, citations, KEPT_CITATION)
    out = F.regexp_replace(marked, TERMS, KEPT_TERM)
    for pattern, tag in REPLACED:
        out = F.regexp_replace(out, pattern, tag)
    out = _unwrap(out, KEPT_TERM, F.regexp_extract_all(marked, F.lit(TERMS), F.lit(0)))
    out = _unwrap(out, KEPT_CITATION, F.regexp_extract_all(text, F.lit(citations), F.lit(0)))
    return F.when(text.rlike("[0-9@A-Z]|://"), out).otherwise(text)

"""Column decisions to one projection: the cell actions of a release."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions import hashing, numeric, text
from shroud.operators import detect

PENDING = "[HUMAN_REVIEW_PENDING]"
ACTIONS = ("keep", "drop", "cap_age_90", "year_only", "zip3_truncate", "hash", "pseudonymize", "scrub_text", "human_review")


def action_column(action: str, name: str, c: Column, salt: str, scrub: Callable[[Column], Column] | None = None) -> Column:
    """One action on a text column; null and empty cells stay as they are."""
    if action == "keep":
        return c
    if action == "cap_age_90":
        return numeric.cap_age(c)
    if action == "year_only":
        return text.year_only(c)
    if action == "zip3_truncate":
        return text.zip3(c)
    out = {
        "drop": lambda: F.lit(""),
        "hash": lambda: hashing.column_digest(salt.encode(), name, c),
        "pseudonymize": lambda: hashing.pseudonym(salt, c),
        "scrub_text": lambda: (scrub or detect.scrub)(c),
        "human_review": lambda: F.lit(PENDING),
    }
    if action not in out:
        raise ValueError(f"unknown action {action!r}")
    return text.unless_empty(c, out[action]())


def resolve_decisions(columns: list[str], decisions: list[tuple[str, str]], unmapped: str = "drop") -> dict[str, str]:
    """Action of each column; one without a decision gets ``unmapped``. Two decisions on one are an error."""
    seen: dict[str, str] = {}
    for column, action in decisions:
        if column in seen:
            raise ValueError(f"two decisions on column {column!r}")
        seen[column] = action
    return {c: seen.get(c, unmapped) for c in columns}


def apply_actions(df: DataFrame, decisions: Mapping[str, str], salt: str, omit: frozenset[str] = frozenset(), neutralise: bool = True) -> DataFrame:
    """All columns as text under their actions, in one projection; ``omit`` leaves columns out entirely."""
    out = []
    for name in df.columns:
        if name in omit:
            continue
        c = action_column(decisions[name], name, F.col(f"`{name}`").cast("string"), salt)
        out.append((text.neutralise_formula(c) if neutralise else c).alias(name))
    return df.select(*out)


def reversal_map(df: DataFrame, column: str, salt: str) -> DataFrame:
    """(value, token) of every value that was pseudonymised."""
    c = F.col(column)
    return df.where(c.isNotNull() & (c != "")).select(c.alias("value"), hashing.pseudonym(salt, c).alias("token")).distinct()

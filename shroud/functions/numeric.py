"""Numbers held as text: strict coercion, caps, bands and check digits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def coerce_numeric(c: Column) -> Column:
    """A double where the text is a plain number, else null."""
    return F.when(strip(c).rlike(NUMERIC), strip(c).try_cast("double"))


def cap_age(c: Column) -> Column:
    """Digits and hyphens as an integer; over 89 is ``90+``, anything else unreadable is empty."""
    n = F.regexp_replace(c, "[^0-9-]", "").try_cast("bigint")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.coalesce(F.when(n > 89, "90+").otherwise(n.cast("string")), F.lit("")))


def cap_numeric(c: Column, threshold: float = 89, label: str = "90+") -> Column:
    """Numbers over the threshold become the label; all else passes."""
    return F.when(coerce_numeric(c) > threshold, F.lit(label)).otherwise(c)


def clamp(c: Column, threshold: int = 5) -> Column:
    """Numbers over the threshold become the threshold; all else passes."""
    return F.when(coerce_numeric(c) > threshold, F.lit(str(threshold))).otherwise(c)


def band(c: Column, ranges: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first range whose upper end holds the number (None: no end); null where none does."""
    n = coerce_numeric(c)
    out = None
    for top, label in ranges:
        fits = n.isNotNull() if top is None else n <= top
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    reversed_digits = F.split(F.reverse(digits), "")
    doubled = F.transform(
        reversed_digits,
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))
    return digits.rlike("^[0-9]+$") & (total % 10 == 0)


def mask_small(count: Column, least: int = 5) -> Column:
    return F.when(count >= least, count.cast("string")).otherwise(F.lit(f"<{least}"))


def band_of(c: Column, bands: Mapping[str, str]) -> Column:
    """The band of a value, told by its lower-cased text without outer space; null where none is listed."""
    pairs = [x for k, v in bands.items() for x in (F.lit(k.strip().lower()), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(c))) if pairs else F.lit(None).cast("string")

"""Text transforms of single cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-digit postal prefixes of areas with too few inhabitants to publish.
RESTRICTED_ZIP3 = ("036", "059", "063", "102", "203", "556", "692", "790", "821", "823", "830", "831", "878", "879", "884", "890", "893")


def unless_empty(c: Column, out: Column) -> Column:
    """Null and empty cells stay as they are."""
    return F.when(c.isNull() | (c == ""), c).otherwise(out)


def year_only(c: Column) -> Column:
    return unless_empty(c, F.regexp_extract(c, r"(\d{4})", 1))


def zip3(c: Column) -> Column:
    first = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 3)
    return unless_empty(c, F.when(first.isin(*RESTRICTED_ZIP3), "000").otherwise(F.rpad(first, 3, "0")))


def neutralise_formula(c: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def mask_sample(c: Column) -> Column:
    """Two characters at each end; all stars up to four characters."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(c, -2, 2)))


def mask_date_shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Za-z]", "X")


def normalize_header(c: Column) -> Column:
    """CamelCase and other separators to lower-case words with underscores."""
    split = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def normalize_name(name: str) -> str:
    """``normalize_header`` for names on the driver."""
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).strip("_").lower()


def file_stem_key(c: Column) -> Column:
    """Lower-case file stem up to a double underscore."""
    return F.lower(F.regexp_extract(c, r"([^/\\]*?)(?:__[^/\\]*)?(?:\.[^./\\]*)?$", 1))


def opaque_token(c: Column) -> Column:
    return c.rlike("^P?[0-9a-f]{8,16}$")

"""Dates held as text: parse with a remembered layout, shift, and write in the same layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions.numeric import strip

# Layouts of dates.
ISO = r"^((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([AaPp][Mm]))?)?$"
SEPARATED = r"^(\d{1,2})([/\-.])(\d{1,2})\2(\d{4}|\d{2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([AaPp][Mm]))?)?$"
BLANK = r"^[\s/.\-:]*$"
# Cells that stand for a missing date.
NULL_TOKENS = ("UNK", "UNKNOWN", "NA", "N/A", "N.A.", "NONE", "NIL", "NOT DONE", "NOT APPLICABLE", "NOT AVAILABLE", "NOT REPORTED", "ND", "NR", ".", "-", "--", "?", "99999999", "00000000", "0")


def expand_year(y: Column) -> Column:
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A date, or null for parts that make none."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(c: Column, locale: str | None = "MDY") -> Column:
    """struct<d: date, fmt: iso | mdy | dmy, has_time: boolean, ampm: string>, null if there is none.

    ISO; then day and month with one separator, told apart where one is over 12 and by ``locale``
    else; then 8, 7 or 6 digits in the locale's order, 8 digits as year first at last. Without a
    locale a value that leaves the order open is null, but for 6 digits, which are day first. The
    time of day is not kept, only that there was one.
    """
    return let(strip(c), lambda s: F.when(s.rlike(r"^\d"), _parsed(s, locale)))


def _parsed(s: Column, locale: str | None) -> Column:
    no_date = F.lit(None).cast("date")
    other = "MDY" if locale == "DMY" else "DMY"

    def separated(p: Column) -> Column:
        both_over = (p["a"] > 12) & (p["b"] > 12)
        day_first = F.when(p["a"] > 12, True).when(p["b"] > 12, False).otherwise(F.lit(locale == "DMY" if locale else None).cast("boolean"))
        ymd = let(day_first, lambda f: F.struct(_ymd(p["y"], F.when(f, p["b"]).otherwise(p["a"]), F.when(f, p["a"]).otherwise(p["b"])).alias("d"), F.when(f, "dmy").otherwise("mdy").alias("fmt")))
        return F.when(~both_over & day_first.isNotNull(), ymd)

    def digits(first: int, second: int, order: str) -> Column:
        p = F.substring(s, 1, first).try_cast("int"), F.substring(s, first + 1, second).try_cast("int")
        year = expand_year(F.substring(s, first + second + 1, 4).try_cast("int"))
        return _ymd(year, p[1], p[0]) if order == "DMY" else _ymd(year, p[0], p[1])

    def only_reading() -> Column:
        found = F.array_distinct(F.array_compact(F.array(*[digits(a, 3 - a, order) for a in (1, 2) for order in ("MDY", "DMY")])))
        return F.when(F.size(found) == 1, F.get(found, F.lit(0)))

    first_over, second_over = F.substring(s, 1, 2).try_cast("int") > 12, F.substring(s, 3, 2).try_cast("int") > 12
    by_part = F.when(first_over & second_over, F.lit(None).cast("date")).when(first_over, digits(2, 2, "DMY")).when(second_over, digits(2, 2, "MDY")).otherwise(digits(2, 2, locale) if locale else no_date)
    year_first = _ymd(F.substring(s, 1, 4).try_cast("int"), F.substring(s, 5, 2).try_cast("int"), F.substring(s, 7, 2).try_cast("int"))
    compact = (
        F.when(F.length(s) == 8, F.coalesce(by_part, year_first))
        .when(F.length(s) == 7, F.coalesce(digits(1, 2, locale), digits(2, 1, locale)) if locale else only_reading())
        .when(F.length(s) == 6, F.coalesce(digits(2, 2, locale or "DMY"), digits(2, 2, other if locale else "MDY")))
    )
    iso_day = F.regexp_extract(s, r"^\d{4}-\d{1,2}-\d{1,2}", 0).try_cast("date")
    parts = F.struct(_part(s, SEPARATED, 1).alias("a"), _part(s, SEPARATED, 3).alias("b"), expand_year(_part(s, SEPARATED, 4)).alias("y"))
    day = F.when(s.rlike(r"^\d+$"), F.struct(compact.alias("d"), F.lit("iso").alias("fmt")))
    day = day.when(s.rlike(ISO), F.struct(iso_day.alias("d"), F.lit("iso").alias("fmt"))).when(s.rlike(SEPARATED), let(parts, separated))
    has_time, ampm = s.rlike(r"[ T]\d{1,2}:\d{2}"), F.upper(F.regexp_extract(s, r"([AaPp][Mm])$", 1))
    return let(day, lambda x: F.when(x["d"].isNotNull(), F.struct(x["d"].alias("d"), x["fmt"].alias("fmt"), has_time.alias("has_time"), ampm.alias("ampm"))))


OPEN = r"^(?:0?[1-9]|1[0-2])([/\-.])(?:0?[1-9]|1[0-2])\1(?:(?:19|20)\d{2}|\d{2})(?:[ T].*)?$|^(?:0[1-9]|1[0-2]){2}(?:19|20)\d{2}$|^\d{7}$"


def is_ambiguous(c: Column, parsed: Column | None = None) -> Column:
    """Text in the shape of a date that no order of day and month is known for; ``parsed``: what ``parse_date`` gave without a locale."""
    parsed = parse_date(c, None) if parsed is None else parsed
    return F.coalesce(strip(c).rlike(OPEN) & parsed.isNull(), F.lit(False))


def format_date(d: Column, fmt: Column, has_time: Column, ampm: Column) -> Column:
    """ISO zero-padded, the others without padding and with slashes; a time slot is written empty."""
    text = F.when(fmt == "mdy", F.date_format(d, "M/d/yyyy")).when(fmt == "dmy", F.date_format(d, "d/M/yyyy")).otherwise(d.cast("string"))
    slot = F.when(~has_time, "").when(ampm != "", F.concat(F.lit(" 12:00:00 "), ampm)).otherwise(" 00:00:00")
    return F.concat(text, slot)


def shift_date(c: Column, days: Column, locale: str | None = "MDY") -> Column:
    """The date moved by ``days`` in its own layout; null where the text is no date."""
    return let(parse_date(c, locale), lambda p: F.when(p.isNotNull(), let(F.date_add(p["d"], days), lambda d: format_date(d, p["fmt"], p["has_time"], p["ampm"]))))


def is_sentinel(c: Column, locale: str | None = "MDY") -> Column:
    """All nines or all zeros, and no date."""
    return F.regexp_replace(c, r"\D", "").rlike("^(9+|0+)$") & parse_date(c, locale or "MDY").isNull()


def is_placeholder(c: Column, locale: str | None = "MDY", tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Blank, a token for a missing date, or a sentinel: kept as it is."""
    sentinel = F.when(c.rlike(r"^[09\D]*$"), is_sentinel(c, locale)).otherwise(False)
    return F.coalesce(c.rlike(BLANK) | F.upper(strip(c)).isin(*tokens) | sentinel, F.lit(True))


def looks_like_date(c: Column) -> Column:
    """Shape only, no calendar."""
    s = strip(c)
    return s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") | s.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}") | s.rlike(r"^\d{6,8}$")

"""Row scrubbing: ordered rules by column name, resolved once for a schema into one projection.

Every column takes the first rule that fits its name. Rules that a cell can fail (generalise, band,
dates under the strict policies) set the row's disposition; such rows, and rows without a subject,
go to quarantine with their original values under the rules that need no subject.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions import dates, hashing, numeric, text

MARKER, MARK = "_phi_scrubbed", "v3"
KEPT, ORPHAN = "kept", "orphan"


@dataclass(frozen=True)
class ScrubConfig:
    """Patterns search column names without regard to case; the first that fits, in the order below, decides."""

    subject_id_fields: tuple[str, ...]
    suppress_headers: frozenset[str] = frozenset()
    keep_fields: tuple[str, ...] = ()
    birthdate_field: str | None = None
    age_fields: tuple[str, ...] = ()
    death_date_fields: tuple[str, ...] = ()
    drop_fields: tuple[str, ...] = ()
    cap_fields: tuple[str, ...] = ()
    generalize_fields: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    band_fields: Mapping[str, Sequence[tuple[float | None, str]] | Mapping[str, str]] = field(default_factory=dict)  # ranges by upper end, or values by lower-cased text
    small_cell_fields: tuple[str, ...] = ()
    date_fields: tuple[str, ...] = ()
    id_fields: Mapping[str, str] = field(default_factory=dict)  # pattern -> label
    age_cap: int = 89
    age_label: str = "90+"
    small_cell_threshold: int = 5
    max_jitter_days: int = 30
    plausible_max_year: int = 2026
    date_locale: str | None = None  # order of day and month where a value leaves it open; None: such rows are held back
    date_locales: Mapping[str, str] = field(default_factory=dict)  # column name -> MDY or DMY
    future_date_policy: str = "sentinel"  # or quarantine
    unparseable_date_policy: str = "blank"  # or quarantine
    safe_harbor: bool = True

    def __post_init__(self) -> None:
        patterns = [*self.keep_fields, *self.drop_fields, *self.cap_fields, *self.generalize_fields, *self.band_fields, *self.small_cell_fields, *self.date_fields, *self.id_fields]
        for p in patterns:
            re.compile(p)
        for name, allowed in (("future_date_policy", ("sentinel", "quarantine")), ("unparseable_date_policy", ("blank", "quarantine"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if not self.subject_id_fields:
            raise ValueError("subject_id_fields is empty")
        for locale in (self.date_locale, *self.date_locales.values()):
            if locale not in (None, "MDY", "DMY"):
                raise ValueError(f"unknown date locale {locale}")


def _any(patterns: Sequence[str], name: str) -> bool:
    return any(re.search(p, name, re.I) for p in patterns)


def _first(patterns: Mapping[str, object], name: str) -> str | None:
    return next((p for p in patterns if re.search(p, name, re.I)), None)


@dataclass(frozen=True)
class Rung:
    """What happens to a column: the rule's name, its expression (None: left out), and a reason where a cell fails it."""

    rule: str
    value: Column | None
    fails: Column | None = None
    counted: Column | None = None


def subject_column(columns: Sequence[str], candidates: Sequence[str]) -> Column:
    """First non-blank of the named columns, then of columns that end in ``_<name>``."""
    ordered = [c for n in candidates for c in columns if c == n]
    ordered += [c for n in candidates for c in columns if c.endswith(f"_{n}") and c not in ordered]
    cells = [F.when(~numeric.is_blank(F.col(f"`{c}`").cast("string")), numeric.strip(F.col(f"`{c}`").cast("string"))) for c in ordered]
    return F.coalesce(*cells) if cells else F.lit(None).cast("string")


def _is_life_date(config: ScrubConfig, name: str) -> bool:
    """A date of birth or death: where it is not dropped it is moved like any date, whatever ``date_fields`` says."""
    return bool(config.birthdate_field and re.search(config.birthdate_field, name, re.I)) or _any(config.death_date_fields, name)


def _is_date(config: ScrubConfig, name: str) -> bool:
    return _any(config.date_fields, name) or _is_life_date(config, name)


def column_locale(config: ScrubConfig, name: str) -> str | None:
    """The column's own order of day and month, else the study's."""
    return {k.upper(): v for k, v in config.date_locales.items()}.get(name.upper(), config.date_locale)


def rung(config: ScrubConfig, name: str, columns: Sequence[str], key: bytes, subject: Column, parsed: Column | None = None) -> Rung:
    """The rule that decides on a column of this schema; ``parsed``: where a projection before has parsed its dates."""
    c = F.col(f"`{name}`").cast("string")
    blank = numeric.is_blank(c)
    if text.normalize_name(name) in config.suppress_headers:
        return Rung("force_drop", None)
    if _any(config.keep_fields, name) and not _is_date(config, name):
        return Rung("keep", c)
    base = next((s for s in config.subject_id_fields if re.fullmatch(rf"{re.escape(s)}_?\d+", name)), None)
    if base:
        token = hashing.record_token(key, base, numeric.strip(c))
        return Rung("secondary_id", F.when(blank | (numeric.strip(c) == subject), F.lit(None).cast("string")).otherwise(token), counted=~blank)
    form_has_age = any(_any(config.age_fields, x) for x in columns)
    if config.birthdate_field and re.search(config.birthdate_field, name, re.I) and form_has_age and config.safe_harbor:
        return Rung("birthdate", None)
    if _any(config.death_date_fields, name) and form_has_age:
        return Rung("death_date", None)
    if _any(config.drop_fields, name):
        return Rung("drop", None)
    if _any(config.cap_fields, name):
        return Rung("cap", numeric.cap_numeric(c, config.age_cap, config.age_label), counted=numeric.coerce_numeric(c) > config.age_cap)
    if (p := _first(config.generalize_fields, name)) is not None:
        pairs = [x for k, v in config.generalize_fields[p].items() for x in (F.lit(k.strip().lower()), F.lit(v))]
        found = F.element_at(F.create_map(*pairs), F.lower(numeric.strip(c))) if pairs else F.lit(None).cast("string")
        return Rung("generalize", F.when(blank, c).otherwise(found), ~blank & found.isNull(), ~blank)
    if (p := _first(config.band_fields, name)) is not None:
        bands = config.band_fields[p]
        label = numeric.band_of(c, bands) if isinstance(bands, Mapping) else numeric.band(c, bands)
        return Rung("band", F.when(blank, c).otherwise(label), ~blank & label.isNull(), ~blank)
    if _any(config.small_cell_fields, name):
        return Rung("small_cell", numeric.clamp(c, config.small_cell_threshold), counted=numeric.coerce_numeric(c) > config.small_cell_threshold)
    if _is_date(config, name):
        locale = column_locale(config, name)
        stay = dates.is_placeholder(c, locale)
        parsed = dates.parse_date(c, locale) if parsed is None else parsed
        future = F.year(parsed["d"]) > config.plausible_max_year
        days = hashing.offset_days(key, subject, config.max_jitter_days)

        moved = dates.format_date(F.date_add(parsed["d"], days), parsed["fmt"], parsed["has_time"], parsed["ampm"])
        value = F.when(stay, c).when(parsed.isNull() | future, F.lit("")).otherwise(moved)
        fails = F.lit(False)
        if config.future_date_policy == "quarantine":
            fails = fails | (~stay & F.coalesce(future, F.lit(False)))
        if config.unparseable_date_policy == "quarantine":
            fails = fails | (~stay & parsed.isNull())
        elif locale is None:
            fails = fails | (~stay & dates.is_ambiguous(c, parsed))
        return Rung("date", value, fails, ~stay & parsed.isNotNull() & ~future)
    if (p := _first(config.id_fields, name)) is not None:
        return Rung("id", F.when(blank, c).otherwise(hashing.record_token(key, config.id_fields[p], numeric.strip(c))), counted=~blank)
    return Rung("default_keep", c)


FIELD_ONLY = ("force_drop", "birthdate", "death_date", "drop")


@dataclass(frozen=True)
class ScrubPlan:
    kept: DataFrame
    quarantine: DataFrame
    flagged: DataFrame
    rungs: Mapping[str, Rung]

    @property
    def rules(self) -> dict[str, str]:
        return {c: r.rule for c, r in self.rungs.items()}


def scrub(df: DataFrame, config: ScrubConfig, key: bytes) -> ScrubPlan:
    """Scrubbed rows, quarantined rows, and all rows with subject and disposition; works on streams too.

    Rows that carry the marker pass untouched.
    """
    columns = [c for c in df.columns if c != MARKER]
    if taken := {"__subject", "__done", "__disposition"} & set(columns):
        raise ValueError(f"reserved column names: {sorted(taken)}")
    subject = F.col("__subject")
    flagged = df.withColumn("__subject", subject_column(columns, config.subject_id_fields))
    rungs = {c: rung(config, c, columns, key, subject) for c in columns}
    # dates are parsed once, in a projection of their own, however often rules name them
    dated = {c: f"__date_{i}" for i, c in enumerate(columns) if rungs[c].rule == "date"}
    flagged = flagged.withColumns({x: dates.parse_date(F.col(f"`{c}`").cast("string"), column_locale(config, c)) for c, x in dated.items()}) if dated else flagged
    rungs |= {c: rung(config, c, columns, key, subject, F.col(x)) for c, x in dated.items()}
    done = (F.col(MARKER) == MARK) if MARKER in df.columns else F.lit(False)
    disposition = F.when(done, KEPT).when(subject.isNull(), ORPHAN)
    for c, r in rungs.items():
        if r.fails is not None:
            disposition = disposition.when(r.fails, f"{r.rule}:{c}")
    flagged = flagged.withColumn("__done", F.coalesce(done, F.lit(False))).withColumn("__disposition", disposition.otherwise(KEPT))
    kept = flagged.where(F.col("__disposition") == KEPT).select(
        *[F.when(F.col("__done"), F.col(f"`{c}`").cast("string")).otherwise(r.value).alias(c) for c, r in rungs.items() if r.value is not None], F.lit(MARK).alias(MARKER)
    )
    quarantine = flagged.where(F.col("__disposition") != KEPT).select(*[F.col(f"`{c}`") for c, r in rungs.items() if r.rule not in FIELD_ONLY], F.col("__disposition").alias("reason"))
    return ScrubPlan(kept, quarantine, flagged, rungs)


def scope_counts(df: DataFrame, config: ScrubConfig, key: bytes) -> DataFrame:
    """(scope, field, n): cells that each rule changed and rows by disposition, in one pass."""
    plan = scrub(df, config, key)
    sums = []
    for c, r in plan.rungs.items():
        if r.counted is not None:
            hit = F.coalesce(r.counted, F.lit(False)) & (F.col("__disposition") == KEPT)
            sums.append(F.struct(F.lit(r.rule).alias("scope"), F.lit(c).alias("field"), F.sum(hit.cast("long")).alias("n")))
    sums.append(F.struct(F.lit("rows").alias("scope"), F.lit(KEPT).alias("field"), F.sum((F.col("__disposition") == KEPT).cast("long")).alias("n")))
    sums.append(F.struct(F.lit("rows").alias("scope"), F.lit("quarantined").alias("field"), F.sum((F.col("__disposition") != KEPT).cast("long")).alias("n")))
    one = plan.flagged.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(sums))])).alias("e")).select("e.scope", "e.field", F.coalesce("e.n", F.lit(0)).alias("n"))


def held_fraction(flagged: DataFrame, by: str, limit: float = 0.1) -> DataFrame:
    """Share of rows held back, by form, and whether it is elevated."""
    held = F.sum((F.col("__disposition") != KEPT).cast("long"))
    out = flagged.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), held.alias("held"))
    return out.withColumn("fraction", F.round(F.col("held") / F.col("rows"), 6)).withColumn("elevated", F.col("held") / F.col("rows") > limit)

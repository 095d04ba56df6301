"""Study configuration: layers merged with their origin kept, checked before any row is read, and made from classified headers.

The packaged rules of a study are a layer like any other, read from a JSON file or given as a mapping.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

from shroud.operators.scrub import ScrubConfig

#: What a key holds: lists of patterns, pattern to label, pattern to code map, pattern to bands, or one value.
LISTS = ("subject_id_fields", "keep_fields", "age_fields", "death_date_fields", "drop_fields", "cap_fields", "small_cell_fields", "date_fields", "suppress_headers")
MAPS = ("generalize_fields", "band_fields", "id_fields", "date_locales")
NUMBERS = ("age_cap", "small_cell_threshold", "max_jitter_days", "plausible_max_year")


class ConfigError(ValueError):
    """A configuration that must not be used; the message names every fault."""


def merge(layers: Sequence[tuple[str, Mapping[str, Any]]]) -> tuple[dict[str, Any], dict[str, str]]:
    """The merged configuration and, by dotted key, the layer that each value is from.

    Mappings merge key by key, later layers last; lists and single values replace what was there, and so does a
    mapping a value or a value a mapping.
    """
    out: dict[str, Any] = {}
    origin: dict[str, str] = {}

    def forget(path: str) -> None:
        for k in [k for k in origin if k == path or k.startswith(f"{path}.")]:
            del origin[k]

    def put(into: dict, layer: str, given: Mapping[str, Any], prefix: str) -> None:
        for key, value in given.items():
            path = f"{prefix}{key}"
            if isinstance(value, Mapping) and isinstance(into.get(key), dict):
                put(into[key], layer, value, f"{path}.")
                continue
            forget(path)
            if isinstance(value, Mapping):
                into[key] = {}
                put(into[key], layer, value, f"{path}.")
                if not value:
                    origin[path] = layer
            else:
                into[key] = list(value) if isinstance(value, (list, tuple, set, frozenset)) else value
                origin[path] = layer

    for layer, given in layers:
        put(out, layer, given, "")
    return out, origin


def faults(raw: Mapping[str, Any]) -> list[str]:
    """Everything that is wrong with a merged configuration, by key."""
    known, found = {f.name for f in fields(ScrubConfig)}, []

    def pattern(key: str, p: Any) -> None:
        try:
            re.compile(p)
        except (re.error, TypeError) as e:
            found.append(f"{key}: {p!r} is no pattern ({e})")

    for key in sorted(set(raw) - known):
        found.append(f"{key}: unknown key")
    for key in LISTS:
        value = raw.get(key, [])
        if not isinstance(value, (list, tuple, set, frozenset)) or not all(isinstance(v, str) for v in value):
            found.append(f"{key}: not a list of texts")
        elif key not in ("subject_id_fields", "suppress_headers"):
            for p in value:
                pattern(key, p)
    if not raw.get("subject_id_fields"):
        found.append("subject_id_fields: empty")
    for key in MAPS:
        if not isinstance(value := raw.get(key, {}), Mapping):
            found.append(f"{key}: not a mapping")
            continue
        for p, inner in value.items():
            pattern(key, p)
            if key == "generalize_fields" and not isinstance(inner, Mapping):
                found.append(f"{key}.{p}: not a mapping of codes")
            if key == "band_fields" and isinstance(inner, Mapping):
                if not inner or not all(isinstance(k, str) and isinstance(v, str) for k, v in inner.items()):
                    found.append(f"{key}.{p}: not bands of values")
            elif key == "band_fields":
                edges = [e for e, _ in inner] if isinstance(inner, (list, tuple)) and all(isinstance(b, (list, tuple)) and len(b) == 2 for b in inner) else None
                if not edges or any(e is None for e in edges[:-1]) or any(a >= b for a, b in zip([e for e in edges if e is not None], [e for e in edges if e is not None][1:], strict=False)):
                    found.append(f"{key}.{p}: not rising bands")
            if key == "id_fields" and not (isinstance(inner, str) and re.fullmatch(r"[A-Z][A-Z0-9_]*", inner)):
                found.append(f"{key}.{p}: {inner!r} is no label")
    for key in NUMBERS:
        if key in raw and (isinstance(raw[key], bool) or not isinstance(raw[key], int) or raw[key] < 1):
            found.append(f"{key}: not a positive whole number")
    if isinstance(raw.get("birthdate_field"), str):
        pattern("birthdate_field", raw["birthdate_field"])
    return found


def build(raw: Mapping[str, Any]) -> ScrubConfig:
    """The configuration of a merged mapping; any fault is an error."""
    if found := faults(raw):
        raise ConfigError("; ".join(found))
    made = {k: frozenset(v) if k == "suppress_headers" else tuple(v) if k in LISTS else v for k, v in raw.items()}
    try:
        return ScrubConfig(**made)
    except ValueError as e:
        raise ConfigError(str(e)) from e


def load(spark: SparkSession, paths: Sequence[str]) -> tuple[ScrubConfig, dict[str, str]]:
    """Configuration files in JSON, merged in their order, wherever Spark reads them."""
    layers = []
    for path in paths:
        text = "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
        try:
            layers.append((path, json.loads(text)))
        except ValueError as e:
            raise ConfigError(f"{path}: not JSON ({e})") from e
    raw, origin = merge(layers)
    return build(raw), origin


def synthesize(classified: Iterable[tuple[str, str]], maps: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Any]:
    """A layer from (header, action). A header to generalise has the map that was built for it, else an empty one,
    so its rows are held until there is one."""
    out: dict[str, Any] = {"date_fields": [], "drop_fields": [], "cap_fields": [], "small_cell_fields": [], "keep_fields": [], "id_fields": {}, "generalize_fields": {}}
    into = {"jitter_date": "date_fields", "drop": "drop_fields", "cap": "cap_fields", "suppress": "small_cell_fields", "keep": "keep_fields"}
    for header, action in classified:
        exact = f"^{re.escape(header)}$"
        if action in into:
            out[into[action]].append(exact)
        elif action == "pseudonymize":
            out["id_fields"][exact] = re.sub(r"[^A-Z0-9]+", "_", header.upper()).strip("_") or "ID"
        elif action == "generalize":
            out["generalize_fields"][exact] = dict((maps or {}).get(header.lower(), {}))
        else:
            raise ConfigError(f"{header}: unknown action {action!r}")
    return {k: v for k, v in out.items() if v}


def extend(base: Mapping[str, Any], layer: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with a synthesised layer added: lists grow, which a merge would replace."""
    out, _ = merge([("base", base)])
    for key, value in layer.items():
        out[key] = {**out.get(key, {}), **value} if isinstance(value, Mapping) else [*out.get(key, []), *(v for v in value if v not in out.get(key, []))]
    return out


def acts_on(config: ScrubConfig, header: str) -> bool:
    """Whether any rule would change a column of this name; a kept one is published as it is."""
    fits = lambda patterns: any(re.search(p, header, re.I) for p in patterns)
    if fits(config.keep_fields):
        return False
    birth = config.birthdate_field is not None and fits([config.birthdate_field])
    return birth or any(fits(p) for p in (config.date_fields, config.id_fields, config.drop_fields, config.cap_fields, config.generalize_fields, config.band_fields, config.small_cell_fields, config.death_date_fields))


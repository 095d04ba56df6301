"""Versioned publication of tables: staged, hashed, then made current by a pointer written last.

A folder holds ``generations/<id>``, each the staged tables of one release with its manifest, and pointer files
``current/<number>``, which name a generation. A release is staged under its own id, every table's digest tree is
made from the staged files and goes into the manifest, and the next pointer is created, which one writer of several
can do. Readers take the highest pointer that is written to its end and read that generation's tables, listed by
its manifest alone: they see a release whole or not at all, and one that they have begun to read stays as it is. A
stop at any step leaves the release before it; what was staged stays unseen until ``sweep`` removes it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.operators import digest_tree
from shroud.operators.digest_tree import record


class PublicationError(Exception):
    """A release that cannot be made: taken by another writer, unclean, or without a table that it lists."""


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet."""
    place, fs = _hadoop(spark, path)
    try:
        out = fs.create(place, False)
    except Exception as e:
        raise PublicationError(f"{path} exists") from e
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


@dataclass(frozen=True)
class Manifest:
    """One generation: its tables' root digests and rows, what they were made from, and whether all checks passed."""

    generation: str
    number: int
    created: str
    tables: Mapping[str, str]
    rows: Mapping[str, int]
    content: str
    fingerprint: str = ""
    verified: bool = False
    partial: bool = False
    absent: tuple[str, ...] = ()
    details: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Publication:
    spark: SparkSession
    path: str

    def _generation(self, generation: str) -> str:
        return f"{self.path}/generations/{generation}"

    def _numbers(self) -> list[int]:
        return [int(n) for n in _names(self.spark, f"{self.path}/current") if n.isdigit()]

    def pointers(self) -> list[tuple[int, str]]:
        """(number, generation) of all releases, oldest first; a pointer that was not written to its end is none."""
        if not self._numbers():
            return []
        files = self.spark.read.option("wholetext", True).text(f"{self.path}/current").select(F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("int"), "value")
        return sorted((n, g[:-1]) for n, g in (tuple(r) for r in files.collect()) if g.endswith("."))

    def current(self) -> str | None:
        found = self.pointers()
        return found[-1][1] if found else None

    def manifest(self, generation: str) -> Manifest:
        found = json.loads(_read(self.spark, f"{self._generation(generation)}/manifest.json"))
        return Manifest(**found | {"absent": tuple(found["absent"])})

    def releases(self) -> list[Manifest]:
        return [self.manifest(g) for _, g in self.pointers()]

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        """A table of the current release, or of a given one."""
        generation = generation or self.current()
        if generation is None or table not in self.manifest(generation).tables:
            raise PublicationError(f"no table {table!r} in release {generation}")
        return self.spark.read.parquet(f"{self._generation(generation)}/tables/{table}")

    def stage(self, tables: Mapping[str, DataFrame]) -> str:
        """Write tables where no reader looks, and return the generation's id."""
        generation = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self._generation(generation)}/tables/{name}")
        return generation

    def seal(self, generation: str, keys: Mapping[str, str], created: str, **facts) -> Manifest:
        """Hash the staged tables as they lie and write the generation's manifest."""
        roots, rows = {}, {}
        for name in _names(self.spark, f"{self._generation(generation)}/tables"):
            df = self.spark.read.parquet(f"{self._generation(generation)}/tables/{name}")
            lines = digest_tree.entries(df, df[f"`{keys[name]}`"], record([df[f"`{c}`"] for c in sorted(df.columns)]))
            top = digest_tree.tree(lines)[0].first()
            roots[name], rows[name] = (top["digest"], top["n"]) if top else ("", 0)
        if missing := set(keys) - set(roots):
            raise PublicationError(f"not staged: {sorted(missing)}")
        content = "\n".join(f"{n}\t{rows[n]}\t{roots[n]}" for n in sorted(roots))
        made = Manifest(generation, max(self._numbers(), default=0) + 1, created, roots, rows, hashlib.sha256(content.encode()).hexdigest(), **facts)
        _create(self.spark, f"{self._generation(generation)}/manifest.json", json.dumps(asdict(made), sort_keys=True))
        return made

    def promote(self, made: Manifest) -> None:
        """Make a sealed generation current. Of two writers that saw the same release before, one is refused."""
        _create(self.spark, f"{self.path}/current/{made.number:09}", f"{made.generation}.")

    def publish(self, tables: Mapping[str, DataFrame], keys: Mapping[str, str], created: str, clean: Callable[[DataFrame], bool] | None = None, **facts) -> Manifest:
        """Stage, check as staged, seal and promote exactly these tables; what an earlier release had beside them is gone from the next.

        A release with ``fingerprint`` of a verified one is not made again: that one is returned.
        """
        if facts.get("fingerprint") and (found := self.find(facts["fingerprint"])):
            return found
        generation = self.stage(tables)
        if clean:
            for name in tables:
                if not clean(self.spark.read.parquet(f"{self._generation(generation)}/tables/{name}")):
                    raise PublicationError(f"{name} is not clean")
        made = self.seal(generation, keys, created, verified=clean is not None, **facts)
        self.promote(made)
        return made

    def find(self, fingerprint: str) -> Manifest | None:
        """The latest verified release that was made from inputs of this fingerprint."""
        found = [m for m in self.releases() if fingerprint and m.fingerprint == fingerprint and m.verified]
        return max(found, key=lambda m: (m.created, m.number), default=None)

    def prior(self, generation: str) -> Manifest | None:
        """The latest release other than ``generation``."""
        return max((m for m in self.releases() if m.generation != generation), key=lambda m: (m.created, m.number), default=None)

    def faults(self, generation: str, keys: Mapping[str, str]) -> list[str]:
        """Tables whose files no longer have the digest of the manifest."""
        known, out = self.manifest(generation), []
        for name, root in known.tables.items():
            df = self.spark.read.parquet(f"{self._generation(generation)}/tables/{name}")
            top = digest_tree.tree(digest_tree.entries(df, df[f"`{keys[name]}`"], record([df[f"`{c}`"] for c in sorted(df.columns)])))[0].first()
            if (top["digest"] if top else "") != root:
                out.append(name)
        return out

    def sweep(self, keep: int = 2) -> list[str]:
        """Remove generations that are not among the last ``keep`` releases, also staged ones that never became current."""
        kept = {g for _, g in self.pointers()[-keep:]}
        gone = [g for g in _names(self.spark, f"{self.path}/generations") if g not in kept]
        for n, g in self.pointers():
            if g in gone:
                place, fs = _hadoop(self.spark, f"{self.path}/current/{n:09}")
                fs.delete(place, True)
        for g in gone:
            place, fs = _hadoop(self.spark, self._generation(g))
            fs.delete(place, True)
        return gone

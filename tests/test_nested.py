from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from shroud.functions import persisted
from shroud.operators import nested

WORDS = ["plain", "call 555-010-1234 now", 'say "hi" \\ there\n', "é ü 中文 😀", "", "a@b.example.org", "Date of Birth 1950-04-02", "under 45 CFR 164.514(b)", "Ann Lee", "{not: [json}", "tab\tend", "\x01odd"]
KEYS = ["id", "a", "b c", 'q"k', "é", "reviewer", "x.y"]


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([*WORDS, *WORDS, 7, True, None])
    if kind < 0.65:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: made(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(5))}


def plain_scrub(text):
    """The meaning, with Python's patterns and marks by number."""
    kept = []

    def keep(m):
        kept.append(m.group(0))
        return f"\x02{len(kept) - 1}\x02"

    out = re.sub(persisted.TERMS, keep, re.sub(persisted.CITATION, keep, text))
    for pattern, tag in persisted.REPLACED:
        out = re.sub(pattern, tag, out)
    for i, k in enumerate(kept):
        out = out.replace(f"\x02{i}\x02", k)
    return out


def plain_nested(value, key=None):
    if isinstance(value, str):
        return value if key in nested.AUDIT_KEYS else plain_scrub(value)
    if isinstance(value, dict):
        return {k: plain_nested(v, k) for k, v in value.items()}
    return [plain_nested(v, key) for v in value] if isinstance(value, list) else value


def canon(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def plain_leaves(value, path="", key=None):
    if isinstance(value, dict) and value:
        for k in sorted(value):
            yield from plain_leaves(value[k], f"{path}.{k}" if path else k, k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain_leaves(v, f"{path}[{i}]", key)
    else:
        yield path, key, canon(value), value if isinstance(value, str) else None


def documents(n=120):
    rng = random.Random(5)
    docs = [made(rng, rng.randrange(7)) for _ in range(n)]
    deep = "Ann Lee"
    for k in range(30):
        deep = {"id" if k % 2 else "a": deep} if k % 3 else [deep]
    return [*docs, deep, {}, [], "x", {"id": ["a@b.example.org", {"a": "a@b.example.org"}]}]


def test_nested_scrub_equals_recursion(spark):
    docs = documents()
    rows = [(i, i % 3 or None, json.dumps(x, indent=i % 2 or None)) for i, x in enumerate(docs)] + [(1000, 1, "{bad"), (1001, 2, None), (1, 1, json.dumps(docs[1]))]
    df = spark.createDataFrame(rows, "n int, _steps int, doc string")
    got = nested.scrub_nested(df, "doc")
    assert got.columns == df.columns
    found = sorted(((r["n"], r["_steps"], r["doc"]) for r in got.collect()), key=str)
    want = sorted(((n, s, None if d in (None, "{bad") else canon(plain_nested(json.loads(d)))) for n, s, d in rows), key=str)
    for (n, s, a), (m, u, b) in zip(found, want, strict=True):
        assert (n, s) == (m, u) and (a is None) == (b is None)
        assert a is None or json.loads(a) == json.loads(b)


def test_leaves_have_paths(spark):
    docs = documents(40)
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "n int, doc string")
    got = {}
    for r in nested.leaves(df, "doc", ["n"]).collect():
        got.setdefault(r["n"], set()).add((r["path"], r["key"], json.dumps(json.loads(r["json"])), r["text"]))
    for i, x in enumerate(docs):
        assert got[i] == {(p, k, json.dumps(json.loads(j)), t) for p, k, j, t in plain_leaves(x)}, x


def test_json_findings_spare_moved_dates_and_help(spark):
    doc = json.dumps({"_provenance": {"extraction_utc": "2024-05-20"}, "VISDAT": "2024-05-21", "rows": [{"note": "2024-05-22 SUBJ-7"}], "help": "Jan 2, 2020"})
    df = spark.createDataFrame([("form", doc), ("dictionary", doc)], "file string, doc string")
    got = {(r["file"], r["path"], r["column"], r["pattern"]) for r in nested.json_findings(df, "doc", ["file"], ("VISDAT",), F.col("file") == "dictionary").collect()}
    both = {(f, "rows[0].note", "note", "SUBJECT_SUBJ") for f in ("form", "dictionary")} | {(f, "help", "help", "DATE_TEXT") for f in ("form", "dictionary")}
    assert got == both | {("form", "rows[0].note", "note", "DATE_ISO")}


def test_persisted_text_equals_python(spark):
    rng = random.Random(3)
    parts = [*WORDS, "HIPAA Privacy Rule", "45 C.F.R. § 164.514(b)(2)(i)", "MRN 202305", "http://x.example.org/u/7", "10.1.2.3", "12b Oak Hill Rd.", "5/20/24", "May 20, 2024", "aged 93", "101 years old", "Dr. Jane Roeä", "+1 (212) 555 0100", "\0", "Safe Harbor 2024-01-02"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(persisted.scrub_persisted(F.col("t"))).collect()]
    assert got == [*map(plain_scrub, texts), None]


def test_empty_table_and_no_other_columns(spark):
    df = spark.createDataFrame([], "doc string")
    assert nested.scrub_nested(df, "doc").collect() == [] and nested.leaves(df, "doc", []).collect() == []
    one = spark.createDataFrame([('{"b":"a@b.example.org","a":[1, {}]}',)], "doc string")
    assert [r[0] for r in nested.scrub_nested(one, "doc").collect()] == ['{"a":[1,{}],"b":"[F]"}']


def test_canonical_text(spark):
    df = spark.createDataFrame([(' {"b" : 1, "a":{"d":null,"c":"x"}} ',), ("[1, 2]",), ("nope{",)], "j string")
    assert [r[0] for r in df.select(nested.canonical(F.col("j"))).collect()] == ['{"a":{"c":"x","d":null},"b":1}', "[1,2]", None]

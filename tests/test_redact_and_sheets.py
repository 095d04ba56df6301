from __future__ import annotations

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from shroud.operators import redact, shaping
from shroud.sources import tables

KEY = b"test key"


def tag(label, text):
    return f"<{label}_{hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()[:8]}>"


def plain_redaction(text, literals):
    """Leftmost, then longest, one character at a time."""
    out, i = [], 0
    while i < len(text):
        hit = max((p for p in literals if text.startswith(p, i)), key=len, default=None)
        out.append(tag("LIT", hit) if hit else text[i])
        i += len(hit) if hit else 1
    return "".join(out)


@pytest.mark.parametrize("block", [2, 1000])
def test_many_literals_equal_plain_redaction(spark, block):
    rng = random.Random(3)
    literals = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(60)})
    texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.randrange(200))) for _ in range(60)] + ["", literals[0] * 3]
    rows = [(i % 40, x) for i, x in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (5, None), (0, texts[0])]
    df = spark.createDataFrame(rows, "id int, t string").withColumns({c: F.lit(7) for c in ("digest", "start", "end", "_end", "literal")})
    listed = spark.createDataFrame([(p,) for p in [*literals, literals[0], "abc", None, "x" * 300]], "p string")
    got = redact.redact_literals(df, "id", "t", listed, "p", KEY, block=block)
    assert got.columns == df.columns
    want = [(i, None if x is None else plain_redaction(x, literals)) for i, x in rows]
    assert sorted(((r["id"], r["t"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_literals(spark):
    df = spark.createDataFrame([(1, "text")], "id int, t string")
    none = spark.createDataFrame([], "p string")
    assert [tuple(r) for r in redact.redact_literals(df, "id", "t", none, "p", KEY).collect()] == [(1, "text")]
    assert redact.prompt_violations(df, "id", "t", none, "p").collect() == []


def test_prompts_in_either_case(spark):
    df = spark.createDataFrame([(1, "Seen JANE ROE, jane roe"), (2, "none"), (3, None)], "id int, t string")
    listed = spark.createDataFrame([("Jane Roe",), ("abc",)], "p string")
    assert [tuple(r) for r in redact.prompt_violations(df, "id", "t", listed, "p").collect()] == [(1, "ja****oe")]


def test_log_lines(spark):
    rows = ["for SUBJ-12 and SUBJ-13, SUBJ-12", "key sk-ant-api03-" + "a1_-" * 6, "mail a@b.example.org at 10.0.0.1 on 2024-05-20", "plain", "", None, "AIza" + "x" * 35 + " FID12345"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(redact.redact_line(F.col("t"), KEY)).collect()]
    want = []
    for x in rows:
        if x is not None:
            for p in redact.SUBJECT_ID:
                x = re.sub(p.regex, lambda m: tag("SUBJ", m.group(0)), x)
            for p in (*redact.ACCESS_KEYS, *redact.BLOCKING, *redact.WARN):
                x = re.sub(p.regex, f"<{p.name}>", x)
        want.append(x)
    assert got == want and got[0].count("SUBJ_") == 3 and got[1] == "key <ANTHROPIC_KEY>"


def plain_blocks(grid):
    """[(table, row, column, value)] of a list of rows of cells."""
    full = lambda v: v is not None and str(v).strip() != ""
    out, table, r = [], 0, 0
    width = max(map(len, grid), default=0)
    while r < len(grid):
        if not any(map(full, grid[r])):
            r += 1
            continue
        end = r
        while end < len(grid) and any(map(full, grid[end])):
            end += 1
        c = 0
        while c < width:
            if not any(full(row[c]) for row in grid[r:end]):
                c += 1
                continue
            stop = c
            while stop < width and any(full(row[stop]) for row in grid[r:end]):
                stop += 1
            table, n = table + 1, 0
            for row in grid[r:end]:
                if any(map(full, row[c:stop])):
                    n += 1
                    out += [(table, n, k - c, row[k]) for k in range(c, stop) if full(row[k])]
            c = stop
        r = end
    return out


def test_sheet_blocks_equal_plain_ones(spark):
    rng = random.Random(7)
    sheets = {s: [[rng.choice(["x", "y", None, "", " "]) if rng.random() < 0.5 else None for _ in range(rng.choice([6]))] for _ in range(12)] for s in range(25)}
    sheets |= {100: [[None, None]], 101: [["a"]], 102: [["a", None, "b"], [None, None, "c"], ["d", None, None]]}
    cells = [(s, r, c, v) for s, grid in sheets.items() for r, row in enumerate(grid) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, "sheet int, row_no int, column_index int, value string")
    got = {}
    for r in shaping.sheet_blocks(df).collect():
        got.setdefault(r["sheet"], []).append(tuple(r)[1:])
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(b) for s, g in sheets.items() if (b := plain_blocks(g))}
    whole = shaping.sheet_blocks(df.where("sheet = 102"), strips=False)
    assert {r["table"] for r in whole.collect()} == {1, 2}


def test_sheet_blocks_shuffle_cells_once(spark):
    cells = [(1, 1, 0, "a"), (1, 1, 0, "b"), (1, 1, 2, "c"), (1, None, 0, "no row"), (1, 2, None, "no column"), (1, 3, 0, "d"), (None, 5, 4, "e")]
    made = shaping.sheet_blocks(spark.createDataFrame(cells, "sheet int, row_no int, column_index int, value string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in made.collect()} == {(1, 1, 1, 0, "a"), (1, 1, 1, 0, "b"), (1, 2, 1, 0, "c"), (1, 3, 1, 0, "d"), (None, 1, 1, 0, "e")}


def test_lines_are_written_by_many_tasks_each_with_a_header(spark, tmp_path):
    lines = spark.range(0, 90, 1, 3).select(F.concat(F.col("id").cast("string"), F.lit(',x "y" '), F.when(F.col("id") % 10 == 0, ",more").otherwise("")))
    tables.write_lines(lines, "key,cell", f"{tmp_path}/t")
    files = list((tmp_path / "t").glob("part-*"))
    assert len(files) == 3 and all(f.read_text().startswith("key,cell\n") and f.read_text().count("\n") == 31 for f in files)
    assert {r[0] for r in tables.read_csv_rejects(spark, f"{tmp_path}/t", ["key", "cell"]).select(tables.CORRUPT).collect()} == {f'{i},x "y" ,more' for i in range(0, 90, 10)}

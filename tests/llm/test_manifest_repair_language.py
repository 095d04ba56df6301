from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import langid, merkle, queries, repair

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node the siblings before and after it, level by level."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for j, a in enumerate(at):
            run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
            ways[j].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[j] = a // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def plain_manifest(rows, tampered):
    """Sorted (key, leaf, subroot, root, proof, folded, verified) of (group, key, text) rows."""
    by = {}
    for g, k, text in rows:
        by.setdefault(g, []).append((k is not None, k or 0, leaf((g, k, text)), text))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in names]
    root, outer = tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), above in zip(names, trees, outer, strict=True):
        for (there, k, own, text), way in zip(sorted(by[g], key=lambda x: x[:3]), ways, strict=True):
            key, path = k if there else None, way + above
            at = leaf((g, key, tampered(text))) if key is not None and key % 5 == 0 else own
            for before, after in path:
                at = sha(before + at + after)
            out.append((key, own, subroot, root, sha("".join(b + a for b, a in path)), at, at == root))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(4)
    rows = [("hot", k, f"Text {k}") for k in range(700)] + [(f"s{k:02}", k, "One") for k in range(40)] + [("é", k, "x" * k) for k in range(17)]
    rows += [(None, k, None) for k in range(33)] + [("", None, "A"), ("", None, "B"), ("", 3, ""), ("ties", 5, "A"), ("ties", 5, "A"), ("ties", 5, "b"), ("long", 10, "Long text " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("inner", "parts"), [(1, 3), (2, 7), (3, 4)])
def test_manifest_equals_plain_trees(spark, inner, parts):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, "g string, k long, text string").withColumns({c: F.lit(7) for c in ("tree", "pos", "leaf", "size", "key", "i")}).repartition(parts)
    cells = [F.col("g"), F.col("k")]
    claim = F.when(F.col("k") % 5 == 0, merkle.leaf([*cells, F.upper("text")]))
    made = merkle.build(df, F.col("g"), F.col("k"), [*cells, F.col("text")], claim, inner)
    got = sorted((tuple(r) for r in merkle.prove(made).collect()), key=str)
    assert got == plain_manifest(rows, lambda t: t if t is None else t.upper())


def test_manifest_of_few_rows(spark, nothing):
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    none = merkle.build(nothing, F.col("source"), F.col("doc_id"), cells)
    assert none.root is None and merkle.prove(none).collect() == []
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], nothing.schema)
    r = merkle.prove(merkle.build(one, F.col("source"), F.col("doc_id"), cells)).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("") and r["verified"]


def test_manifest_of_awkward_documents(spark, awkward):
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = merkle.prove(merkle.build(awkward, F.col("source"), F.col("doc_id"), cells)).collect()
    assert len(rows) == awkward.count() and all(r["verified"] for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_merkle", "op12_repair"])
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


# Conversation repair


def plain_audit(signature):
    """Cheapest and then least audit, by trying all edits in the order of their cost and text."""
    legal = lambda e: all("".join(p) in ("su", "ua", "au") for p in itertools.pairwise(e)) and e[:1] in ("", "s", "u")
    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(signature) and roles[-1:] in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        moves = [(cost + 2, audit + "I", i, roles + r) for r in "ua"]
        if i < len(signature):
            x = signature[i]
            moves.append((cost + 3, audit + "D", i + 1, roles))
            if x != "D":
                moves += [(cost + 2 + x.isupper(), audit + "R", i + 1, roles + r) for r in "ua"]
                moves += [(cost + x.isupper(), audit + "K", i + 1, roles + x.lower())] if x.lower() != "x" else []
        for m in moves:
            if legal(m[3]) and m[0] <= 3 * len(signature):
                heapq.heappush(heap, m)
    return best


def test_trie_equals_all_edits():
    rng = random.Random(1)
    found = sorted({"".join(rng.choice("DsuaxSUAXuaua") for _ in range(rng.randrange(6))) for _ in range(300)})
    trie = repair.Trie()
    assert [trie.insert(s) for s in found] == [plain_audit(s) for s in found]
    assert trie.made < sum(map(len, found)) / 1.8


SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """{conversation: row of the result} of (conv, turn, role, text) after damage."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, sha(f"{len(r[2].encode())}:{r[2]}{r[3]}"))
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and r[2] is not None), key=order)
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(SPACES) if text.strip(SPACES) == "" else text.rstrip(SPACES)
            faults.append(1 if bare == "" else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        ini = [r[2][:1] for r in mine]
        sig = "".join("D" if f in (1, 2) else (i if i in ("s", "u", "a") else "x").upper() if f == 3 else i if i in ("s", "u", "a") else "x" for i, f in zip(ini, faults, strict=True))
        cost, audit = plain_audit(sig) if len(sig) < 7 else repair.Trie().insert(sig)
        lines, at, emitted, led = [], 0, 0, False
        for c in audit:
            row = mine[at] if c != "I" else None
            at += c != "I"
            if c == "D":
                continue
            emitted += 1
            led = led or (emitted == 1 and c == "K" and row[2][:1] == "s")
            target = "user" if (emitted - led) % 2 else "assistant"
            lines.append(f"{row[2]}:{row[3]}" if c == "K" else f"{target}:{row[3] if c == 'R' else ''}")
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini))
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, sha("\n".join(lines)))
    return out


def chats():
    rng = random.Random(8)
    texts = ["Fine.", "Why?", "Cut of", "", " \n", "Fine. ", None, "é!", "Fine."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "unknown", ""]
    rows = [(rng.choice([*range(60), None]), rng.choice([0, 1, 2, 3, 5, None]), rng.choice(roles), rng.choice(texts)) for _ in range(260)]
    long = [(900, k, ("user", "assistant")[k % 2] if k % 7 else "tool", f"line {k}" + "." * (k % 5 > 0)) for k in range(3000)]
    return [*rows, *long, (901, 1, "user", "A." * 200_000)]


def test_damage_and_repair_equal_plain_ones(spark):
    rows, named = chats(), lambda v: " " if v is None else str(v)
    after = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = "user" if d == 4 else named(role), "" if d == 1 else named(text)
        text = "".join(c for c in text if c not in ".!?") if d == 2 else text
        after += [(conv, turn, None, None)] if d == 0 else [(conv, turn, role, text)] * (1 + (d == 3))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in ("same", "kind", "fault", "signature", "audit", "gone")}).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(df)).collect()}
    assert got == plain_repair(after)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damage(df)).collect() == []
    gone = spark.createDataFrame([(1, 1, "user", "x", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert [tuple(r) for r in repair.repair(gone).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


# Language of words


def model(rng, k=3):
    return langid.Model(("aa", "bb", "cc")[:k], rng.normal(size=(langid.PLACES, k)).astype(np.float32), rng.normal(size=(langid.BUCKETS, k)).astype(np.float32), 0.7, rng.normal(size=k), rng.normal(size=(k, k)))


def test_forward_backward_equals_all_paths():
    m = model(np.random.default_rng(3))
    texts = ["one", "two words here", "one 12 two, three four five", None, "12 34", ""]
    sizes, shares, each = langid.Chain(m).shares(texts, marginals=True)
    assert sizes.tolist() == [1, 3, 5, 0, 0, 0]
    for text, share, got in zip(texts[:3], shares, each, strict=False):
        found = [w for part in langid.words(text) for w in part]
        scores, want = m.evidence(found).astype(float), np.zeros((len(found), 3))
        for path in itertools.product(range(3), repeat=len(found)):
            weight = np.exp(m.first[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(m.moves[a, b] for a, b in itertools.pairwise(path)))
            for i, s in enumerate(path):
                want[i, s] += weight
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(got, want, atol=1e-4) and np.allclose(share, want.mean(axis=0), atol=1e-4)


def test_long_texts_and_batches_do_not_change_marginals(monkeypatch):
    m, rng = model(np.random.default_rng(5)), random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(0, 300))) for _ in range(40)]
    whole = langid.Chain(m).shares(texts)[1]
    monkeypatch.setattr(langid, "PIECE", 50)
    monkeypatch.setattr(langid, "CHAINED", 100)
    assert np.allclose(langid.Chain(m).shares(texts)[1], whole, atol=1e-5)


WORDS = {"xx": ["tabo", "kano", "mito", "sado", "relo"], "yy": ["strich", "kelch", "molch", "durch", "nacht"], "zz": ["eaulie", "vieau", "moieu", "deaux", "lieux"]}


def speak(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "n"]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    rows = [(i, (lang := ("xx", "yy", "zz")[i % 3]), speak(rng, lang, rng.randrange(5, 60))) for i in range(300)]
    rows += [(900, None, speak(rng, "xx", 20)), (901, "xx", None), (902, "yy", "12 !!"), (903, "xx", rows[0][2]), (903, "xx", rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_languages_of_texts_that_were_not_learned(spark, spoken):
    learned = langid.train(spoken.where("doc_id < 200"))
    assert learned.languages == ("xx", "yy", "zz") and all(learned.moves[k, k] > learned.moves[k].mean() for k in range(3))
    docs = spoken.withColumns({c: F.lit(7) for c in ("score", "bucket", "n")})
    got = {r["doc_id"]: r for r in docs.select("doc_id", "lang", langid.predict(learned, docs).alias("p")).collect()}
    held = [r for k, r in got.items() if 200 <= k < 300]
    assert sum(r["p"]["lang"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["p"]["score"] <= 1 for r in got.values())
    assert tuple(got[901]["p"]) == (langid.UNKNOWN, 0.0) == tuple(got[902]["p"])


def test_foreign_passages_are_labelled_word_by_word(spark, spoken):
    rng = random.Random(9)
    learned = langid.train(spoken)
    parts = [(lang, speak(rng, lang, 12)) for lang in ("xx", "zz", "yy", "xx")]
    df = spark.createDataFrame([(" ".join(t for _, t in parts),), (None,), ("..",)], "text string")
    rows = [r[0] for r in df.select(langid.tag_words(learned, df)).collect()]
    want = [lang for lang, t in parts for _ in t.split()]
    assert sum(a["lang"] == b for a, b in zip(rows[0], want, strict=True)) / len(want) > 0.95 and rows[1] == rows[2] == []


def test_model_does_not_depend_on_partitions(spark, spoken):
    a, b = (langid.train(spoken.repartition(n, "text")) for n in (1, 6))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.lexicon, b.lexicon) and np.array_equal(a.moves, b.moves)


def test_nothing_to_learn(spark, nothing, awkward):
    none = langid.train(nothing)
    assert none.languages == ()
    assert {tuple(r[0]) for r in awkward.select(langid.predict(none, awkward)).collect()} == {(langid.UNKNOWN, 0.0)}
    some = langid.train(awkward)
    assert len(awkward.select(langid.predict(some, awkward)).collect()) == awkward.count()

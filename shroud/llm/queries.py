"""The thin queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import ann, decontam, langid, lm, merkle, packing, pii, quality, repair, secret_scan, simhash, url_filter, warc
from shroud.llm.scratch import new_path, write_table

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from labels that aren't held out."""
    scored, _ = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back from them."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL under the fixed rules, else blocked if it is on the referral list."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.referral_list(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds, with the alignment's score."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a model of those that aren't held out."""
    out = quality.held_out("doc_id", 7, 2)
    rows, _ = lm.train_and_score(table(spark, sf_dir, "documents"), ~out)
    return rows.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve into sequences of 2048 tokens."""
    files = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1, **files)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the strict patterns' matches and what the model adds."""
    cands = write_table(pii.candidates(table(spark, sf_dir, "documents")), "cands")
    spans = pii.accepted_spans(F.col("cands"), pii.train(cands))
    rows = cands.select("doc_id", F.filter("cands", lambda c: c["kind"] < len(pii.BASE_KINDS)).alias("base"), spans.alias("all"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("all")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def _is_kind(kind: str | int) -> Callable:
    return lambda s: s["kind"] == kind


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, in two runs on one ledger: the first takes half of the documents, the
    second all of them, and scans only texts that the first has not committed."""
    docs, ledger = table(spark, sf_dir, "documents"), secret_scan.BlobLedger(spark, new_path(spark, "ledger"))
    secret_scan.scan_versions(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0), "doc_id", "text", ledger)
    rows = secret_scan.scan_versions(docs, "doc_id", "text", ledger)
    base = [r.kind for r in secret_scan.BASE_RULES]
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    of_base = secret_scan.span_text(F.filter("spans", lambda s: s["kind"].isin(base)))
    return rows.select("doc_id", *counts, F.sha2(of_base, 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


A_Z, A_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root in the Merkle manifest; a fifth of the rows claim a lower-cased text."""
    docs = table(spark, sf_dir, "documents")
    *cells, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf([*cells, F.translate(text, A_Z, A_Z_LOWER)]))
    rows = merkle.prove(merkle.build(docs, F.col("source"), F.col("doc_id"), [*cells, text], tampered))
    return rows.withColumnRenamed("key", "doc_id")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, its rows damaged by rule: faults counted, and the cheapest repair of its roles."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a random field over its words, learned from those that aren't held out."""
    docs, out = table(spark, sf_dir, "documents"), quality.held_out("doc_id", 4, 2)
    model = langid.train(docs.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), langid.predict(model, docs).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_katz": op6_katz,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle": op11_merkle,
    "op12_repair": op12_repair,
    "op13_langid": op13_langid,
}

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (h, p, _) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][0] + r[1][1]))
)
_RULE_NAME = f"CASE {_FITS.format(*[h + p for h, p, _ in URL_RULES])} END"
_RULE_VERDICT = f"CASE {_FITS.format(*[v for *_, v in URL_RULES])} END"

OP4_SQL = f"""
WITH u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^#?]*\\?([^#]*)', 1), '') AS query
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS key FROM u),
listed AS (SELECT DISTINCT key FROM c WHERE contains('&' || query, '&ref=') AND key IS NOT NULL)
SELECT page_id, host, path, {_RULE_NAME} AS rule,
  coalesce({_RULE_VERDICT}, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(key IN (SELECT key FROM listed), false) AS listed
FROM c
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0)
)

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


def _secret_branch(no: int, rule: secret_scan.SecretRule) -> str:
    pattern, inner = (x.replace("'", "''") for x in (rule.pattern, rule.inner))
    return f"""
  SELECT doc_id, {no} AS kind_no, '{rule.kind}' AS kind,
    unnest(regexp_extract_all(t, '{pattern}')) AS m,
    unnest(regexp_split_to_array(t, '{pattern}')[1:-2]) AS gap,
    generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS pos,
    '{inner}' AS inner_re, {rule.least} AS least
  FROM d WHERE regexp_matches(t, '{pattern}')"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_secret_branch(i, r) for i, r in enumerate(secret_scan.RULES))}),
e AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind_no ORDER BY pos) AS stop,
    CASE WHEN kind = 'assign' THEN length(regexp_extract(m, '{secret_scan.ASSIGN_VALUE.replace("'", "''")}', 1)) ELSE length(m) END AS n
  FROM m),
s AS (SELECT doc_id, kind, kind_no, stop - length(m) AS start, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM e WHERE n >= least),
g AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(secret_scan.BASE_RULES)}) AS base,
    string_agg(span, ',' ORDER BY start, kind_no) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    byte = "list_reduce([CAST(k AS BIGINT) for k in [1, 2, 3, 4, 5, 6, 7, 8]], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(state, code))"
    return f"xor(list_reduce({codes}, lambda state, code: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _merkle_sql(sources: int = 6, roots: int = 4) -> str:
    """Trees of up to 16**sources leaves a source and 16**roots sources, level by level."""
    cell = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    head, low = " || ".join(cell(c) for c in ("doc_id", "source", "lang", "n_chars")), f"translate(text, '{A_Z}', '{A_Z_LOWER}')"
    with_ = [
        f"d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, sha256({head} || {cell('text')}) AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({head} || {cell(low)}) END AS claim FROM documents)",
        "a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d)",
        "b0 AS (SELECT 0 AS s, s AS i, h, count(*) OVER () AS n FROM subroots)",
    ]
    for t, most in (("a", sources), ("b", roots)):
        for k in range(1, most + 1):
            with_.append(f"{t}{k} AS (SELECT *, sha256(kids) AS h FROM (SELECT s, i // 16 AS i, (any_value(n) + 15) // 16 AS n, string_agg(h, '' ORDER BY i) AS kids FROM {t}{k - 1} WHERE n > 1 GROUP BY s, i // 16))")
        one = " UNION ALL ".join(f"SELECT s, h FROM {t}{k} WHERE n = 1" for k in range(most + 1))
        with_.append(f"{'subroots' if t == 'a' else 'root'} AS ({one})")
    rows, up = "SELECT doc_id, leaf, s, i, coalesce(claim, leaf) AS h, '' AS proof FROM a0", "x.s"
    for t, most in (("a", sources), ("b", roots)):
        for k in range(1, most + 1):
            before, after = (f"coalesce({c}, '')" for c in (f"left(r.kids, 64 * (x.i // {16 ** (k - 1)} % 16))", f"substr(r.kids, 64 * (x.i // {16 ** (k - 1)} % 16) + 65)"))
            rows = f"SELECT x.doc_id, x.leaf, x.s, x.i, CASE WHEN r.kids IS NULL THEN x.h ELSE sha256({before} || x.h || {after}) END AS h, x.proof || {before} || {after} AS proof FROM ({rows}) x LEFT JOIN {t}{k} r ON r.s = {up} AND r.i = x.i // {16**k}"
        if t == "a":
            rows, up = f"SELECT doc_id, leaf, s, s AS i, h, proof FROM ({rows})", "0"
    order = ["d", "a0", *(f"a{k}" for k in range(1, sources + 1)), "subroots", "b0", *(f"b{k}" for k in range(1, roots + 1)), "root"]
    named = {w.split(" AS ", 1)[0]: w for w in with_}
    return f"""WITH {", ".join(named[k].replace(" AS (", " AS MATERIALIZED (", 1) for k in order)}
    SELECT x.doc_id, x.leaf, u.h AS subroot, root.h AS root, sha256(x.proof) AS proof_sha256, x.h AS folded_root, x.h = root.h AS verified
    FROM ({rows}) x JOIN subroots u ON u.s = x.s CROSS JOIN root"""


def _audit_sql(symbols: str) -> str:
    """Cost and audit of a list of row symbols: least cost, then least audit, by state (none yet, s, u, a), row by row."""
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    plus = lambda way, cost, edits: f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{edits}'}}"
    none, s, u, a = (f"acc[{k}]" for k in (1, 2, 3, 4))
    at_u = best(u, plus(none, 2, "I"), plus(s, 2, "I"), plus(a, 2, "I"))
    at_a = best(a, plus(u, 2, "I"), plus(none, 4, "II"), plus(s, 4, "II"))
    x, broken = "lower(row[1].a)", "CAST(row[1].a IN ('S', 'U', 'A', 'X') AS BIGINT)"
    off = "CAST(1000000000 AS BIGINT)"
    kept = lambda way, initial: plus(way, f"(CASE WHEN {x} = '{initial}' THEN {broken} ELSE {off} END)", "K")
    turned = lambda way: plus(way, f"(CASE WHEN row[1].a = 'D' THEN {off} ELSE 2 + {broken} END)", "R")
    gone = lambda way: plus(way, 3, "D")
    to_s = best(gone(s), kept(none, "s"))
    to_u = best(gone(at_u), *(f(way) for way in (none, s, at_a) for f in (lambda w: kept(w, "u"), turned)))
    to_a = best(gone(at_a), kept(at_u, "a"), turned(at_u))
    start = f"[{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': {off}, 'a': ''}}, {{'c': {off}, 'a': ''}}, {{'c': {off}, 'a': ''}}]"
    end = f"list_reduce(list_transform({symbols}, lambda x: [{{'c': CAST(0 AS BIGINT), 'a': x}}]), lambda acc, row: [{gone(none)}, {to_s}, {to_u}, {to_a}], {start})"
    return f"(SELECT {best(none, a, plus(u, 2, 'I'), plus(s, 4, 'II'))} FROM (SELECT {end} AS acc))"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_INITIAL = "CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END"
OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, d FROM c WHERE d <> 0),
r AS (SELECT *, sha256(octet_length(encode(role)) || ':' || role || text) AS same, rtrim(text, {_SPACES}) AS trimmed FROM (SELECT * FROM h UNION ALL SELECT * FROM h WHERE d = 3)),
o AS (SELECT *, nth > 1 AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same, nth) AS k
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, same ORDER BY turn NULLS FIRST) AS nth FROM r)),
f AS (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN seen THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(CASE WHEN fault IN (1, 2) THEN 'D' WHEN fault = 3 THEN upper({_INITIAL}) ELSE {_INITIAL} END ORDER BY k) AS symbols FROM f GROUP BY conv_id),
a AS MATERIALIZED (SELECT *, {_audit_sql("symbols")} AS best FROM g),
e AS (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS n FROM a WHERE best.a <> ''),
p AS (SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER w AS k, sum(CAST(edit <> 'D' AS INT)) OVER w AS j FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
q AS (SELECT p.*, f.role, f.text, max(CAST(edit = 'K' AND j = 1 AND left(role, 1) = 's' AS INT)) OVER (PARTITION BY p.conv_id) AS led FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role || ':' || text ELSE CASE WHEN (j - led) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END END, chr(10) ORDER BY n) AS repaired FROM q WHERE edit <> 'D' GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE_SQL: dict[str, str] = {"op11_merkle": _merkle_sql(), "op12_repair": OP12_SQL, "op3_warc": OP3_SQL, "op4_url_filter": OP4_SQL, "op10_secret_scan": OP10_SQL}

"""URL verdicts: host/path rules first, then a listed-URL filter.

Listed canonical URLs fill a blocked Bloom filter: a table of blocks of eight 32-bit words, one
bit a word and URL, built by ``bit_or`` and probed by a join on the block number. The filter has
a fixed largest size, so it is always broadcast; where more URLs are listed than it has room for,
more false positives reach the exact join, which removes them. DataFrame functions only.

Defined cases: a null URL or one without ``://`` has empty host and path, no canonical form, fits
no rule and is allowed. Repeated rows are each judged. An empty list blocks nothing. Of fitting
rules of one length the last given wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BLOCK_BITS = 32 * WORDS
BLOCK_BYTES = 8 + 4 * WORDS

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without trailing slashes; null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent of it and starts the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build_filter(listed: DataFrame, key: str, n_keys: int, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> tuple[DataFrame, int]:
    """Blocks of the filter over ``listed[key]``, at most ``max_bytes``; and the number of blocks."""
    blocks = max(1, min(-(-n_keys * bits_per_key // BLOCK_BITS), max_bytes // BLOCK_BYTES))
    rows = listed.select(_block(F.col(key), blocks).alias("_block"), *[b.alias(f"_b{i}") for i, b in enumerate(_bits(F.col(key)))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(WORDS)]), blocks


def probe(rows: DataFrame, key: str, table: DataFrame, blocks: int, out: str) -> DataFrame:
    """``out``: whether the filter may hold the row's key. The table's size is bounded, see above."""
    hit = F.col("_w0").isNotNull()
    for i, bit in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    joined = rows.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(table), "_block", "left")
    return joined.withColumn(out, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("_block", *[f"_w{i}" for i in range(WORDS)])


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_key: int = 16,
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """Verdict on each row of ``pages``; ``listed`` has one column of canonical URLs, in any number.

    Returns id, host, path, rule, verdict, listed, filter_hit. The exact join is an ordinary one:
    Spark broadcasts a list below its own threshold, else shuffles, and splits hot URLs.
    """
    listed = write_table(listed.select(F.col(listed.columns[0]).alias("_listed")).where("_listed is not null").distinct(), "listed")
    table, blocks = build_filter(listed, "_listed", listed.count(), bits_per_key, max_bytes)
    rows = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_ruled"), canonical(F.col("host"), F.col("path")).alias("_key"))
    rows = probe(rows, "_key", table, blocks, "filter_hit")
    # rows that the filter rules out carry a key of their own, so they are spread and meet nothing
    rows = rows.withColumn("_on", F.when(F.col("filter_hit"), F.col("_key")).otherwise(F.xxhash64("_id", "path").cast("string")))
    found = listed.select(F.col("_listed").alias("_on"), F.lit(True).alias("filter_hit"), F.lit(True).alias("_found"))
    joined = rows.join(found, ["_on", "filter_hit"], "left").withColumn("_is", F.col("_found").isNotNull())
    verdict = F.coalesce("_ruled", F.when(F.col("_is"), "block").otherwise("allow"))
    return joined.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("_is").alias("listed"), "filter_hit")


def referral_list(pages: DataFrame, url_col: str = "url", param: str = "ref") -> DataFrame:
    """Canonical URLs that were ever linked with the referral parameter in their query."""
    tagged = F.concat(F.lit("&"), url_query(F.col(url_col))).contains(f"&{param}=")
    return pages.where(tagged).select(canonical(url_host(F.col(url_col)), url_path(F.col(url_col))).alias("canonical"))

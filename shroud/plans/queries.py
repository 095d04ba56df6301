"""The operators applied to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.functions import dates, hashing, numeric, persisted, text
from shroud.functions.patterns import BLOCKING, GUARD_US, SPAN_RULES, pack
from shroud.operators import audit, detect, digest_tree, event_log, guard, header_review, lineage, nested, policy, privacy, profile, redact, review, scoring, scrub, shaping, study_config, support, transform, verify
from shroud.sources.publish import Publication
from shroud.sources.work import work_path
from shroud.streaming import log, streams

KEY, SALT = b"public test key", "study-salt"
PRIORITY_CODES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "routine", "4-NOT SPECIFIED": "routine"}
PRICE_BANDS = ((50_000.0, "low"), (150_000.0, "middle"), (None, "high"))
#: Span rules whose tags no other rule can match in.
ORDERED_RULES = tuple(r for r in SPAN_RULES if r.name in ("EMAIL", "PHONE", "CLINICAL_TRIAL_ID", "DEVICE_SERIAL"))
COUNTED_RULES = tuple(r for r in SPAN_RULES if r.portable and r.luhn_prefix is None)
TEXT_GUARD = tuple(p for p in GUARD_US if p.portable and not p.conditional)

ORDERS_SCRUB = scrub.ScrubConfig(
    subject_id_fields=("o_custkey",),
    drop_fields=("^o_totalprice$",),
    generalize_fields={"^o_orderpriority$": PRIORITY_CODES},
    date_fields=("^o_orderdate$",),
    id_fields={"^o_custkey$": "CUST", "^o_orderkey$": "ORD"},
    plausible_max_year=1997,
)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """The same rows; where their files make fewer partitions than there are cores they are dealt out
    before the work on each row, which costs far more than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(t(spark, sf_dir, "documents"))


def _orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw form: text cells, every 97th without a subject."""
    o = _dealt(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus",
        F.format_number("o_totalprice", 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


def pseudonymize_customer(spark, d):
    return t(spark, d, "customer").select("c_custkey", hashing.pseudonym(SALT, F.col("c_name")).alias("token"))


def hash_customer(spark, d):
    return t(spark, d, "customer").select("c_custkey", hashing.column_digest(KEY, "c_name", F.col("c_name")).alias("digest"))


def rid_token_orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", hashing.record_token(KEY, "CUST", F.col("o_custkey").cast("string")).alias("token"))


def date_jitter_orders(spark, d):
    days = hashing.offset_days(KEY, F.col("o_custkey").cast("string"), 30)
    shifted = dates.shift_date(F.date_format("o_orderdate", "yyyy-MM-dd"), days)
    return _dealt(t(spark, d, "orders")).select("o_orderkey", days.alias("days"), shifted.alias("shifted"))


def date_jitter_interval_preserved(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    o = o.withColumn("moved", F.date_add("day", hashing.offset_days(KEY, F.col("o_custkey").cast("string"), 30)))
    span = lambda c: F.datediff(F.max(c), F.min(c))
    return o.groupBy("o_custkey").agg(span("day").alias("days_before"), span("moved").alias("days_after"))


def year_only_orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.year_only(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


def cap_age(spark, d):
    return t(spark, d, "part").select("p_partkey", numeric.cap_age((F.col("p_size") * 3).cast("string")).alias("age"))


def zip3_truncate(spark, d):
    code = F.lpad((F.col("c_custkey") * 7919 % 100000).cast("string"), 5, "0")
    return t(spark, d, "customer").select("c_custkey", text.zip3(code).alias("zip3"))


def band_totalprice(spark, d):
    return t(spark, d, "orders").select("o_orderkey", numeric.band(F.col("o_totalprice").cast("string"), PRICE_BANDS).alias("band"))


def generalize_priority_disposition(spark, d):
    config = scrub.ScrubConfig(subject_id_fields=("o_custkey",), generalize_fields={"^o_orderpriority$": PRIORITY_CODES})
    rows = t(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return scrub.scrub(rows, config, KEY).flagged.groupBy(F.col("__disposition").alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def clamp_small_cell(spark, d):
    clamped = numeric.clamp(F.col("l_quantity").cast("int").cast("string"))
    return t(spark, d, "lineitem").groupBy(clamped.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def scrub_orders_full(spark, d):
    return scrub.scrub(_orders_text(spark, d), ORDERS_SCRUB, KEY).kept


def scrub_orders_quarantine(spark, d):
    return scrub.scrub(_orders_text(spark, d), ORDERS_SCRUB, KEY).quarantine.select("o_orderkey", "o_custkey", "o_orderpriority", "reason")


def scrub_event_counts(spark, d):
    return scrub.scope_counts(_orders_text(spark, d), ORDERS_SCRUB, KEY)


def held_fraction(spark, d):
    return scrub.held_fraction(scrub.scrub(_orders_text(spark, d), ORDERS_SCRUB, KEY).flagged, "o_orderpriority")


_STYLES = ("yyyy-MM-dd", "M/d/yyyy", "MM/dd/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "M-d-yyyy")


def date_parse_mixed(spark, d):
    o = _dealt(t(spark, d, "orders"))
    raw = F.date_format("o_orderdate", _STYLES[0])
    for i, s in enumerate(_STYLES[1:], 1):
        raw = F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", s)).otherwise(raw)
    p = dates.parse_date(F.col("raw"))
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.date_format(p["d"], "yyyy-MM-dd").alias("day"), p["fmt"].alias("fmt"), p["has_time"].alias("has_time"))


_TOKENS = ("99999999", "00/00/0000", "unk", " // ", "1998-05-06", "9/9/99")


def date_sentinel_tokens(spark, d):
    cell = F.element_at(F.array(*[F.lit(x) for x in _TOKENS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", cell.alias("cell")).select("o_orderkey", "cell", dates.is_placeholder(F.col("cell")).alias("placeholder"))


def subject_resolve_orphans(spark, d):
    rows = _orders_text(spark, d)
    return scrub.scrub(rows, scrub.ScrubConfig(subject_id_fields=("o_custkey",)), KEY).quarantine.select("o_orderkey", "reason")


def secondary_id_drop(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("SUBJID"), (F.col("l_partkey") % 10 + 1).cast("string").alias("SUBJID2"), "l_orderkey", "l_linenumber")
    kept = scrub.scrub(rows, scrub.ScrubConfig(subject_id_fields=("SUBJID",)), KEY).kept
    return kept.groupBy("SUBJID", F.col("SUBJID2").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def kanon_customer(spark, d):
    return privacy.k_anonymity(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 10)


def kanon_smallest(spark, d):
    return privacy.smallest_class(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


def ldiv_customer_orders(spark, d):
    joined = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return privacy.l_diversity(joined, ["c_nationkey", "c_mktsegment"], ["o_orderstatus"], 4)


def small_cell_crosstab(spark, d):
    counts = t(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "day", numeric.mask_small(F.col("n")).alias("cell"))


def column_profile(spark, d):
    return profile.column_profile(t(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def column_stats_site_rule(spark, d):
    return profile.column_stats(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def blocking_scan_documents(spark, d):
    return guard.count_hits(_documents(spark, d), F.col("text"), ["source"], BLOCKING)


def gate_conversations(spark, d):
    rows = guard.gate(t(spark, d, "conversations"), F.col("text"))
    return rows.select("conv_id", "turn", F.array_join("blocked", ",").alias("blocked"), F.array_join("warned", ",").alias("warned"))


def tree_scan_customer(spark, d):
    c = t(spark, d, "customer").select("c_name", "c_mktsegment", F.concat(F.lit("SUBJ-"), "c_custkey").alias("ref"), F.concat(F.lit("seen 1998-0"), F.col("c_custkey") % 9 + 1, F.lit("-11")).alias("visit"))
    return guard.tree_findings(c)


def guard_top20_by_source(spark, d):
    found = guard.cell_findings(_documents(spark, d), "source", {"text": None}, TEXT_GUARD)
    return guard.top_findings(found)


def _noted(spark, d):
    """Documents, every seventh with a label and a code of a kind by its number, so that labelled and conditional patterns have something to find."""
    k = F.col("doc_id")
    notes = (" MRN: AB-4471", " acct 99X71 member id ZZ12", " aged 93, tag QX 4711", " imei 490154203237518 uid K-7781", " provider 1234567893 vin 1HGCM82633A004352")
    note = F.element_at(F.array(*[F.lit(n) for n in notes]), (k % 5 + 1).cast("int"))
    return _documents(spark, d).select("doc_id", "source", F.when(k % 7 != 0, F.col("text")).otherwise(F.concat("text", note)).alias("text"))


def guard_report(spark, d):
    """Every source under the whole pack: clean or blocked."""
    docs = _noted(spark, d)
    return guard.export_report(guard.cell_findings(docs, "source", {"text": None}, GUARD_US), docs.select(F.col("source").alias("file")))


def guard_report_portable(spark, d):
    """The same under the patterns that need no label, column or look-around."""
    docs = _documents(spark, d)
    found = guard.cell_findings(docs, "source", {"text": None}, TEXT_GUARD)
    return guard.export_report(found, docs.select(F.col("source").alias("file")))


def guard_lines(spark, d):
    found = guard.line_findings(_documents(spark, d), "doc_id", "text", TEXT_GUARD)
    return found.groupBy(F.col("file").alias("doc_id"), "pid").agg(F.count(F.lit(1)).alias("lines"))


def detect_counts_by_category(spark, d):
    docs = _documents(spark, d)
    sums = [F.sum(c.cast("long")).alias(r.name.lower()) for r, c in zip(COUNTED_RULES, detect.match_counts(F.col("text"), COUNTED_RULES), strict=True)]
    return docs.groupBy("lang").agg(*sums)


def detect_spans_documents(spark, d):
    spans = _documents(spark, d).select("doc_id", F.explode(detect.merge_spans(detect.detect_spans(F.col("text")))).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", "s.entity", "s.category")


def scrub_text_documents(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2(detect.replace_in_order(F.col("text"), ORDERED_RULES), 256).alias("digest"))


def scrub_text_spans(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2(detect.scrub(F.col("text")), 256).alias("digest"))


def conversation_scrub_counts(spark, d):
    total = sum(detect.match_counts(F.col("text"), COUNTED_RULES), F.lit(0))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.sum(total.cast("long")).alias("spans"))


def mask_samples(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", text.mask_sample(F.col("o_orderpriority")).alias("sample"), text.mask_date_shape(F.date_format("o_orderdate", "dd MMM yyyy")).alias("shape"))


def formula_neutralise(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "", " ")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", text.neutralise_formula(F.concat(lead, F.col("p_name"))).alias("cell"))


def leak_token_join(spark, d):
    literals = t(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split(F.lower("text"), verify.TOKEN))).alias("literal"))
    leaks = verify.leak_tokens(_documents(spark, d), "doc_id", "text", literals, "literal")
    return leaks.groupBy("literal").agg(F.count_distinct("id").alias("docs"))


def leak_contains_join(spark, d):
    leaks = verify.leak_passages(_documents(spark, d), "doc_id", "text", t(spark, d, "benchmark"), "text")
    return leaks.select(F.col("id").alias("doc_id"), F.sha2("passage", 256).alias("passage"))


def confusion_by_source(spark, d):
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return verify.confusion(docs, ["source"], F.col("quality") == 0, F.col("text").contains("!!") | F.col("text").contains(" | ") | F.col("text").contains("###"))


def calibration_buckets(spark, d):
    confidence = F.least(F.greatest(F.col("value") / 500.0, F.lit(0.0)), F.lit(1.0))
    return verify.calibration(t(spark, d, "events"), confidence, F.col("event_type") == "click")


def exact_coverage(spark, d):
    return review.coverage_faults(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"]).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def latest_decision(spark, d):
    return review.latest(t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def event_hash_chain(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("hash"))
    from pyspark.sql import Window

    chained = e.withColumn("prev_hash", F.lag("hash").over(Window.partitionBy("run_id").orderBy("seq")))
    broken = chained.withColumn("prev_hash", F.when(F.col("seq") % 50 == 0, F.lit("x")).otherwise(F.col("prev_hash")))
    return lineage.chain_faults(broken).select("run_id", "seq")


def rate_window(spark, d):
    return review.sliding_counts(t(spark, d, "events"), "user_id", "ts", 900).select("event_id", "hits")


def phase_durations(spark, d):
    e = t(spark, d, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    per = e.groupBy("user_id", "at").agg(F.min("event_id").alias("event_id"))
    return review.durations(per, "user_id", "at").select("user_id", "event_id", "seconds")


def manifest_digest(spark, d):
    """Nodes of the documents' digest tree, the root's prefix empty."""
    docs = t(spark, d, "documents")
    levels = digest_tree.tree(digest_tree.entries(docs, F.col("doc_id"), F.col("text")), about=docs.count())
    return digest_tree.nodes(levels).select(F.col("prefix").alias("bucket"), "n", "digest")


def manifest_difference(spark, d):
    """Changed documents between two stored trees, found from the roots down."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    gone, k = docs.where("doc_id % 10 <> 0"), F.col("doc_id")
    later = gone.select("doc_id", F.when(k % 31 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    later = later.unionByName(docs.where("doc_id % 50 = 0").select((k + 1_000_000_000).alias("doc_id"), "text"))
    old, new = (digest_tree.store(x, k, F.col("text"), work_path(spark, "tree")) for x in (docs, later))
    return digest_tree.difference(spark, old, new)


def snapshot_diff(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"), "o_orderkey")
    old = o.where("o_orderkey % 10 <> 0").select("path", "sha256")
    new = o.where("o_orderkey % 11 <> 0").select("path", F.when(F.col("o_orderkey") % 13 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return lineage.snapshot_diff(old, new)


def cleanup_check(spark, d):
    n = lambda q: t(spark, d, "orders").where(q).select(F.col("o_orderkey").alias("path"))
    return lineage.cleanup_faults(n("o_orderkey % 3 <> 0"), n("o_orderkey % 5 = 0"), n("o_orderkey % 7 = 0"))


def injective_check(spark, d):
    c = t(spark, d, "customer").select("c_name", F.substring(hashing.pseudonym(SALT, F.col("c_name")), 1, 3).alias("token"))
    return verify.pseudonym_faults(c, "c_name", "token")


def luhn_valid(spark, d):
    digits = F.concat(F.lit("80840"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 10, "1"))
    return t(spark, d, "part").select("p_partkey", digits.alias("digits")).select("p_partkey", numeric.luhn_valid(F.col("digits")).alias("valid"))


def normalize_header(spark, d):
    return t(spark, d, "part").select("p_partkey", text.normalize_header(F.concat_ws(" - ", "p_type", "p_name")).alias("header"))


def cells_long(spark, d):
    cells = shaping.to_cells(t(spark, d, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])
    return cells.select("n_nationkey", "column_index", "value")


def value_map_conflicts(spark, d):
    by = lambda code: shaping.value_map(t(spark, d, "orders").select(code, "o_orderpriority"), code, "o_orderpriority")
    clean = t(spark, d, "nation").select(F.col("n_name").alias("code"), F.col("n_regionkey").cast("string").alias("label"))
    return by("o_orderstatus").select("code", "label").unionByName(shaping.value_map(clean, "code", "label"))


def blank_segments(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("cell"))
    return shaping.blank_row_segments(rows, "l_orderkey", "l_linenumber", ["cell"]).groupBy("l_orderkey", "segment").agg(F.count(F.lit(1)).alias("n"))


def kept_scan_customer(spark, d):
    c = t(spark, d, "customer").withColumn("note", F.concat(F.lit("call "), F.lpad((F.col("c_custkey") % 900 + 2).cast("string"), 3, "2"), F.lit("-555-0100")))
    return policy.kept_column_hits(c.select("c_mktsegment", "note"), ["c_mktsegment", "note"], TEXT_GUARD)


def replay_customer(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("study_arm"), (F.col("c_nationkey") * 4).alias("age"))
    out, _ = policy.replay(c, SALT)
    return out


def release_actions(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lpad("c_custkey", 5, "0").alias("zip"))
    actions = {"c_custkey": "hash", "c_name": "drop", "c_mktsegment": "human_review", "zip": "zip3_truncate"}
    return transform.apply_actions(c, actions, SALT)


def shape_verdicts(spark, d):
    return verify.shape_verdicts(release_actions(spark, d), {"c_custkey": "hash", "c_name": "drop", "zip": "zip3_truncate", "c_mktsegment": "year_only"})


def stream_scrub_orders(spark, d):
    """The scrub plan on a stream of the orders, all that is there, written and read back."""
    path = work_path(spark, "stream")
    raw = spark.readStream.schema(t(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    cells = raw.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderpriority")
    config = scrub.ScrubConfig(subject_id_fields=("o_custkey",), id_fields={"^o_custkey$": "CUST", "^o_orderkey$": "ORD"})
    kept = scrub.scrub(cells, config, KEY).kept
    q = kept.writeStream.format("parquet").option("path", f"{path}/kept").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/kept")


def stream_tumbling_events(spark, d):
    """Windowed counts over a stream of the events with a watermark, all that is there."""
    path = work_path(spark, "windows")
    events = t(spark, d, "events")
    raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = streams.tumbling_counts(raw, F.col("ts"), "event_type", "1 hour", "1 day")

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/counts/no={number}")  # a window's later counts replace its earlier ones

    q = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{path}/counts").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def tumbling_events(spark, d):
    out = streams.tumbling_counts(t(spark, d, "events"), F.col("ts"), "event_type", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def session_events(spark, d):
    out = streams.sessions(t(spark, d, "events"), F.col("ts"), "user_id", "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def guard_all_patterns(spark, d):
    """The whole pack over the documents, labelled and conditional patterns too."""
    found = guard.cell_findings(_noted(spark, d), "source", {"text": None}, GUARD_US)
    return found.groupBy(F.col("file").alias("source"), "pid").agg(F.count(F.lit(1)).alias("texts"))


def _codes(spark, d):
    """Order rows with numbers in the shape of national identifiers."""
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("file"),
        F.when(k % 4 == 0, F.concat(F.lit("no "), F.lpad(k.cast("string"), 4, "2"), F.lit(" 1234 5678")))
        .when(k % 4 == 1, F.concat(F.lit("pan ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F")))
        .when(k % 4 == 2, F.concat(F.lit("sin "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-111-222")))
        .otherwise(F.concat(F.lit("cpf "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".111.222-33")))
        .alias("cell"),
    )


def _pack_counts(spark, d, jurisdiction):
    found = guard.cell_findings(_codes(spark, d), "file", {"cell": None}, pack(jurisdiction))
    return found.groupBy("file", "pid").agg(F.count(F.lit(1)).alias("cells"), F.min("match").alias("first"))


def guard_pack_india(spark, d):
    return _pack_counts(spark, d, "IN")


def guard_pack_canada(spark, d):
    return _pack_counts(spark, d, "ca")


def guard_pack_brazil(spark, d):
    return _pack_counts(spark, d, "br")


def guard_conditional_age(spark, d):
    """A conditional pattern counts in a column of its category, or with its word in the cell."""
    k = F.col("p_partkey")
    cells = t(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.when(k % 2 == 0, "aged ").otherwise("size "), (k % 100).cast("string")).alias("note"), (k % 100).cast("string").alias("years"))
    ages = tuple(p for p in GUARD_US if p.name == "AGE_OVER_89")
    found = guard.cell_findings(cells, "file", {"note": None, "years": "C"}, ages)
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("hits"))


HEADERS = "patient_name FNAME LNAME INIT SIGN BANKNAME DL_NO ICFDT p_h_o_n_e phone_number VISDAT AGE zip notes LB_PAXPROCSIG RESPNDT SUBJID2 hemoglobin OrigPgSeq village contacts_total unknownthing".split()


def header_policy(spark, d):
    return policy.decisions_table(spark, HEADERS)


def _births(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("SUBJID"), F.col("o_orderkey").cast("string").alias("ROW"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("BRTH"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("DEATHDT"))


def scrub_birthdate_no_age(spark, d):
    """A form without an age column: dates of birth and death are moved, never released as they are."""
    config = scrub.ScrubConfig(subject_id_fields=("SUBJID",), id_fields={"^SUBJID$": "CUST"}, birthdate_field="^BRTH$", death_date_fields=("^DEATHDT$",), age_fields=("^AGE$",))
    return scrub.scrub(_births(spark, d), config, KEY).kept.select("ROW", "BRTH", "DEATHDT")


def date_ambiguous_quarantine(spark, d):
    """Without a locale a row whose day and month could change places is held back; the column's own locale decides."""
    day = lambda f: F.date_format("o_orderdate", f)
    rows = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("SUBJID"), F.col("o_orderkey").cast("string").alias("ROW"), day("M/d/yyyy").alias("SEENDAT"), day("d/M/yyyy").alias("BACKDAT"))
    config = scrub.ScrubConfig(subject_id_fields=("SUBJID",), id_fields={"^SUBJID$": "CUST"}, date_fields=("DAT$",), date_locales={"backdat": "DMY"})
    return scrub.scrub(rows, config, KEY).flagged.select("ROW", F.col("__disposition").alias("disposition"))


def _decided(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("column"), "o_orderpriority", "o_orderstatus")
    actions = F.element_at(F.array(*[F.lit(a) for a in ("keep", "drop", "hash", "human_review", "year_only")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select("file", "column", F.when(F.col("o_orderstatus") == "F", "drop").when(F.col("o_orderstatus") == "O", "keep").otherwise("hash").alias("expected"), actions.alias("action"))


def _facts(spark, d):
    decided = _decided(spark, d)
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("column"), "l_linenumber", "l_returnflag").join(decided.select("file", "column"), "column")
    decisions = decided.where("column % 7 <> 0").select("file", "column", "action", F.lit(1).alias("seq")).unionByName(decided.where("column % 5 = 0").select("file", "column", F.lit("drop").alias("action"), F.lit(2).alias("seq")))
    leaks = lines.where("l_returnflag = 'R'").select("file", "column")
    planted = lines.select("file", "column", (F.col("l_linenumber") == 1).alias("verbatim"))
    return scoring.column_facts(decided.select("file", "column", "expected"), decisions, leaks, planted)


def column_facts(spark, d):
    return _facts(spark, d).select("column", "expected", "action", "verdict", "exact", "leak_hits", "cells", "changed")


def benchmark_totals(spark, d):
    return scoring.totals(_facts(spark, d))


def conformance_by_flag(spark, d):
    actual = F.when(F.col("l_linenumber") % 6 != 0, F.when(F.col("l_quantity") > 40, F.lit("x")).otherwise(F.col("l_linestatus")))
    return scoring.conformance(t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_linestatus"), actual, F.col("l_linenumber") == 2)


def leak_rate_by_segment(spark, d):
    planted = t(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").alias("plant"))
    return scoring.leak_rate(planted, t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("plant")), "plant", ["c_mktsegment"])


def campaign_rollup(spark, d):
    return scoring.rollup(t(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("plants")), ["l_returnflag"], ["plants"])


def action_counts(spark, d):
    return scoring.count_actions(_decided(spark, d))


def tool_coverage(spark, d):
    o = t(spark, d, "orders").select((F.col("o_orderkey") % 2 == 0).alias("rules"), (F.col("o_orderstatus") == "F").alias("model"), F.lit(None).cast("boolean").alias("review"))
    return scoring.coverage_counts(o, ["rules", "model", "review"])


def joined_policy_view(spark, d):
    return scoring.joined_view(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


def dictionary_drift(spark, d):
    """Listed customers without an early order, as columns that are documented and in no dataset."""
    listed = t(spark, d, "customer").where("c_custkey % 7 <> 0")
    return scoring.drift(listed, t(spark, d, "orders").where("o_orderdate < timestamp '1993-01-01'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def strengthen_actions(spark, d):
    decisions = _decided(spark, d).select("file", "column", "action")
    signals = _decided(spark, d).where("column % 3 = 0").select("file", "column", F.col("expected").alias("action"))
    return scoring.strengthen(decisions, signals, ["file", "column"], policy.CELL_RANK).select("column", "action", "changed")


def unmet_dependencies(spark, d):
    pairs = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("dependency")).distinct()
    return scoring.held_by_dependencies(pairs, pairs.where("dependency % 4 <> 0"))


def force_drop_columns(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("form"), F.col("l_partkey").alias("column"), "l_linenumber")  # noqa: E741
    return scoring.force_drop(l.where("l_linenumber = 1"), l.where("l_linenumber = 2"), l.where("l_linenumber = 3"))


def latest_snapshot(spark, d):
    return scoring.latest_snapshot(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def as_written_ledger(spark, d):
    before = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    after = before.where("c_custkey % 5 <> 0").select("c_custkey", hashing.pseudonym(SALT, F.col("c_name")).alias("c_name"), "c_mktsegment")
    return scoring.as_written(before, after, ["c_name", "c_mktsegment"], {"c_name": "pseudonymize", "c_mktsegment": "keep"}, "c_custkey")


def event_hash_recomputed(spark, d):
    """Stored hashes against the payload: every 50th was written with another payload."""
    e = t(spark, d, "events").select("event_id", "event_type", F.lit("seed").alias("prev_hash"))
    kind = F.when(F.col("event_id") % 50 == 0, "forged").otherwise(F.col("event_type"))
    e = e.withColumn("hash", F.sha2(F.concat(F.lit('seed{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), kind, F.lit('"}')), 256))
    return lineage.hash_faults(e, ["event_id", "event_type"]).select("event_id")


def _nested(spark, d):
    """Each conversation as one JSON document: turns with bodies, notes in lists, and audit keys; identifiers are planted by number."""
    c, n = t(spark, d, "conversations"), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0")
    said = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Call 555-010-"), n, F.lit(" under 45 CFR 164.514(b)."))).when(F.col("turn") % 3 == 1, F.lit(" Seen by Dr. Jane Roe, aged 93, 12 Oak Hill Road.")).otherwise(F.lit("")))
    notes = F.array(F.concat(F.lit("Date of Birth 1950-04-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit(", MRN 77"), n), F.concat(F.lit("mail p"), n, F.lit("@clinic.example.org or http://portal.example.org/u/"), n))
    body = F.struct(said.alias("text"), notes.alias("notes"), F.array(F.array(F.lit("host 10.0.0.7"))).alias("hosts"))
    turn = F.struct("turn", "role", "text", F.struct("role", body.alias("body"), F.concat(F.lit("r"), n, F.lit("@audit.example.org")).alias("reviewer"), F.lit("2024-05-20").alias("ts")).alias("made"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = F.struct(F.col("conv_id").cast("string").alias("session_id"), F.transform("turns", lambda x: x["made"]).alias("turns"))
    return whole.select("conv_id", F.to_json(made).alias("doc"))


def scrub_nested_conversations(spark, d):
    """Every leaf of the conversations' JSON after its strings were scrubbed and the text rebuilt."""
    return nested.leaves(nested.scrub_nested(_nested(spark, d), "doc"), "doc", ["conv_id"]).select("conv_id", "path", "key", "text")


def tree_scan_json(spark, d):
    """Leaves with residual identifiers: moved dates in ``ts`` are spared, and every seventh document is a dictionary."""
    found = nested.json_findings(_nested(spark, d), "doc", ["conv_id"], ("ts",), F.col("conv_id") % 7 == 0)
    return found.select("conv_id", "path", "column", "pattern")


def canonical_props(spark, d):
    """Properties of events in canonical form, whatever the order and spacing of their keys."""
    e = t(spark, d, "events")
    raw = F.concat(F.lit('{"z" : [1, {"b":"x", "a":null}],\n "type":"'), F.col("event_type"), F.lit('", "props":'), F.col("props"), F.lit("}"))
    return e.select("event_id", nested.canonical(raw).alias("doc"))


def scrub_persisted_documents(spark, d):
    """Documents as stored texts, with a citation ahead of each: identifiers outside citations and terms are replaced."""
    docs = _documents(spark, d)
    noted = F.concat(F.lit("Per 45 CFR \u00a7164.514(b)(2)(i), Safe Harbor; seen 20-May-2024 by Ann Lee: "), F.col("text"))
    return docs.select("doc_id", F.sha2(persisted.scrub_persisted(noted), 256).alias("digest"))


def redact_dictionary_part(spark, d):
    """A dictionary file, every cell scrubbed."""
    k = F.col("p_partkey")
    cells = t(spark, d, "part").select(k.alias("code"), F.concat(F.lit("ask Mr. Jo Poe, MRN "), F.lpad(k.cast("string"), 6, "0")).alias("help"), F.concat("p_brand", F.lit(" HIPAA 1/2/"), (k % 90 + 10).cast("string")).alias("note"))
    return nested.scrub_cells(cells)


def _log(spark, d):
    return event_log.chain(event_log.arrivals(t(spark, d, "events"), F.col("user_id"), F.col("event_id"), F.col("ts"), ["event_id", "event_type"]))


def event_chain(spark, d):
    """The events as a log: numbered and chained by user."""
    return _log(spark, d).select("run", "seq", F.col("id").cast("long").alias("event_id"), "prev_hash", "hash")


def event_seals(spark, d):
    return event_log.seals(_log(spark, d), 10)


def event_log_faults(spark, d):
    """Faults of the log after every 50th body was forged, every 97th event dropped and every 89th repeated, against seals of the log before."""
    whole, k = _log(spark, d), F.col("id").cast("long")
    bad = whole.where(k % 97 != 0).withColumn("body", F.when(k % 50 == 0, F.replace("body", F.lit('"event_type"'), F.lit('"type"'))).otherwise(F.col("body")))
    return event_log.faults(bad.unionByName(bad.where(k % 89 == 0)), event_log.seals(whole, 10))


def stream_event_chain(spark, d):
    """The log of a stream whose events come up to an hour late in four parts, every tenth of them twice."""
    path, moved = work_path(spark, "log"), F.col("at") + F.make_dt_interval(secs=F.col("id").cast("long") * 7919 % 3600)
    seen = event_log.arrivals(t(spark, d, "events"), F.col("user_id"), F.col("event_id"), F.col("ts"), ["event_id", "event_type"])
    whole = seen.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    k, part = F.col("id").cast("long"), F.width_bucket(F.unix_micros(moved).cast("double"), F.lit(whole["a"].timestamp() * 1e6), F.lit((whole["b"].timestamp() + 3600) * 1e6 + 1), F.lit(4)).cast("int")
    parts = F.array_compact(F.array(part, F.when(k % 10 == 0, part), F.when(k % 20 == 0, F.least(part + 1, F.lit(4)))))
    for n in range(1, 5):  # parts come in this order, and each is read before the next is there
        seen.withColumn("part", F.explode(parts)).where(F.col("part") == n).drop("part").write.parquet(f"{path}/in/{n}")
        raw = spark.readStream.schema(seen.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        q = log.chain_stream(raw, "1 hour").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(event_log.COLUMNS).parquet(f"{path}/out").select("run", "seq", F.col("id").cast("long").alias("event_id"), "hash")


def audited_scrub_orders(spark, d):
    """Counts by rule and column, observed by the job that wrote kept and held orders."""
    made = audit.write_audited(_orders_text(spark, d), ORDERS_SCRUB, KEY, work_path(spark, "audited"))
    return spark.createDataFrame(made.rows(), "scope string, field string, n long")


def audited_scrub_lines(spark, d):
    """Orders as JSON lines, with a blank line, a broken one and a list after every 50th: rows as written, read back by part and reason."""
    path, o = work_path(spark, "lines"), _orders_text(spark, d)
    k, line = F.col("o_orderkey").cast("long"), F.to_json(F.struct(*o.columns))
    o.select(F.explode(F.when(k % 50 == 0, F.array(line, F.lit(" "), F.lit("{broken"), F.lit("[1]"))).otherwise(F.array(line))).alias("value")).write.text(f"{path}/in")
    made = audit.scrub_lines(spark, f"{path}/in", o.columns, ORDERS_SCRUB, KEY, f"{path}/out")
    kept = spark.read.schema("o_orderkey string, o_custkey string, __part string, __reason string").json(f"{path}/out")
    rows = kept.groupBy(F.col("__part").alias("part"), F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_custkey").startswith("RID_CUST_"), 1)).alias("tokens"))
    return rows.unionByName(spark.createDataFrame([("skipped", why, n, 0) for why, n in made.skipped.items()], rows.schema))


def published_orders(spark, d):
    """The current release after three: one of orders and customers, one of later orders alone, and one that never got its pointer."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    p, keys = Publication(spark, work_path(spark, "publication")), {"orders": "o_orderkey", "customer": "c_custkey"}
    p.publish({"orders": o.where("o_orderstatus = 'F'"), "customer": c}, keys, "2024-01-01T00:00:00Z")
    p.publish({"orders": o.where("o_orderstatus <> 'F'")}, {"orders": "o_orderkey"}, "2024-01-02T00:00:00Z")
    p.seal(p.stage({"orders": o}), {"orders": "o_orderkey"}, "2024-01-03T00:00:00Z")
    now = p.manifest(p.current())
    rows = p.read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return rows.withColumn("release", F.lit(now.number)).withColumn("tables", F.lit(",".join(sorted(now.tables))))


def redact_log_lines(spark, d):
    """Events as log lines: subjects as keyed tags, keys and identifiers as their names."""
    k = F.col("event_id").cast("string")
    odd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" mail u"), k, F.lit("@example.org on 2024-05-20"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" key sk-ant-api03-"), F.sha2(k, 256))).otherwise(F.lit(" from 10.0.0.7 by Dr. Ann Lee"))
    line = F.concat(F.lit("run for SUBJ-"), F.col("user_id").cast("string"), F.lit(": "), F.col("event_type"), odd)
    return t(spark, d, "events").select("event_id", redact.redact_line(line, KEY).alias("line"))


def _phrases(spark, d):
    """Literals: a piece of each benchmark text."""
    return t(spark, d, "benchmark").select(F.substring("text", 11, 18).alias("literal"))


def redact_literal_documents(spark, d):
    """Documents in which every listed literal is replaced by its own keyed tag."""
    made = redact.redact_literals(_documents(spark, d).select("doc_id", "text"), "doc_id", "text", _phrases(spark, d), "literal", KEY)
    return made.select("doc_id", F.sha2("text", 256).alias("digest"))


def prompt_literals(spark, d):
    """Planted literals that documents, as prompts, still hold."""
    return redact.prompt_violations(_documents(spark, d), "doc_id", "text", _phrases(spark, d), "literal").withColumnRenamed("id", "doc_id")


def sheet_blocks(spark, d):
    """Line items as sheets by order: a blank row after the third line, columns that are blank in some strips."""
    l, no = t(spark, d, "lineitem"), F.col("l_linenumber")  # noqa: E741
    cells = F.array(
        F.struct(F.lit(0).alias("column_index"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit(1).alias("column_index"), F.when(F.col("l_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.col("l_linestatus")).alias("value")),
        F.struct(F.lit(2).alias("column_index"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_linestatus")).alias("value")),
        F.struct(F.lit(4).alias("column_index"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).alias("value")),
    )
    rows = l.select(F.col("l_orderkey").alias("sheet"), (no + (no > 3).cast("int")).alias("row_no"), F.explode(cells).alias("x")).select("sheet", "row_no", "x.*")
    return shaping.sheet_blocks(rows)


FORM_HEADERS = ("SUBJID", "VISDAT", "hemoglobin", "interviewer_remarks", "fname", "Visit Date", " ", "GPS lat", "e_mail_ok", "whatsapp", "sign_off", "visit_date", "weight_kg", "pincode", "notes", "age")


def review_headers_forms(spark, d):
    """Forms of the headers of neighbouring orders, with printed questions for some and human keeps for a few."""
    form = F.floor(F.col("o_orderkey") / 8)
    name = F.element_at(F.array(*[F.lit(h) for h in FORM_HEADERS]), ((F.col("o_orderkey") + form) % 16 + 1).cast("int"))
    o = t(spark, d, "orders").select(form.alias("form"), F.col("o_orderkey").alias("position"), name.alias("header"), "o_orderstatus")
    k = F.col("position")
    sot = F.when(k % 11 == 0, "drop").when(k % 7 == 0, "keep")
    signals = o.where("o_orderstatus = 'F'").select("form", "header", F.lit(True).alias("has_question"), (k % 5 == 0).alias("is_phi"), sot.alias("sot_phi"))
    return header_review.review_headers(o.drop("o_orderstatus"), signals, o.where(k % 13 == 0).select("form", "header"))


def rule_safety(spark, d):
    """Proposed rules for headers, some too broad, broken, costly or off the rulebook."""
    k, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    pattern = F.element_at(F.array(F.concat(F.lit("^c_"), seg), F.lit(".*"), F.lit("("), F.lit("zzz"), F.lit("c|visit"), F.lit("(a+)+b")), (k % 6 + 1).cast("int"))
    action = F.element_at(F.array(F.lit("drop"), F.lit("keep"), F.lit("zap")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    proposals = t(spark, d, "customer").select(k.alias("proposal_id"), F.concat(F.lit("c_"), seg).alias("header"), pattern.alias("pattern"), action.alias("action"), F.concat(F.lit("r"), (F.col("c_nationkey") % 4).cast("string")).alias("rule_id"))
    book = t(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.when(F.col("r_regionkey") == 1, "keep").otherwise("drop").alias("action"))
    return header_review.rule_safety(proposals, book)


def gate_lexicon_parts(spark, d):
    """Titles of parts under a clinical lexicon and a list of names, both made of their words."""
    texts = t(spark, d, "part").select(F.initcap(F.substring_index(F.lower("p_type"), " ", 2)).alias("text")).unionByName(t(spark, d, "part").select(F.concat(F.lit("Lot "), (F.col("p_partkey") + 1_000_000).cast("string")).alias("text")))
    tokens = t(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    phrases = texts.where("text like 'Promo B%'").select(F.col("text").alias("phrase"))
    return header_review.gate(texts, "text", tokens.where("length(word) % 2 = 0"), phrases, tokens.where("word like 'p%'").withColumnRenamed("word", "name"))


def _support(spark, d):
    """Data sets by market segment, each with a column a region, and a dictionary a region with its nations; region 2's has a
    second, changed copy, and region 3's gives one code two labels."""
    regions = F.explode(F.sequence(F.lit(0), F.lit(4)))
    sets = t(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct()
    headers = sets.select("dataset", F.sha2("dataset", 256).alias("dataset_sha"), regions.alias("r"))
    headers = headers.select("dataset", "dataset_sha", F.concat("dataset", F.lit("/"), F.col("r").cast("string")).alias("header_id"), F.concat(F.lit("NationR"), F.col("r").cast("string")).alias("raw_name"))
    n, key = t(spark, d, "nation"), F.col("n_nationkey")
    copy = F.explode(F.when(F.col("n_regionkey") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = n.select("*", copy.alias("copy"), F.explode(F.when((F.col("n_regionkey") == 3) & (key % 2 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("twice"))
    label = F.when((F.col("copy") == 1) | (F.col("twice") == 1), F.lower("n_name")).otherwise(F.col("n_name"))
    values = F.array(F.concat(F.lit("nation r"), F.col("n_regionkey").cast("string")), key.cast("string"), label, F.lit("a code"))
    cells = rows.select(F.concat(F.lit("dict"), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("artifact"), (key * 10 + F.col("twice")).alias("row"), F.posexplode(values).alias("column", "value"))
    return headers, cells, cells.select("artifact").distinct().select("artifact", F.sha2("artifact", 256).alias("artifact_sha"))


def dependency_links(spark, d):
    """Links of dictionaries to data sets under decisions: every fifth ignored, some stale since the dictionary changed."""
    headers, cells, artifacts = _support(spark, d)
    links = support.dictionary_links(headers, cells, artifacts)
    old = support.dictionary_links(headers, cells, artifacts.withColumn("artifact_sha", F.when(F.col("artifact") == "dict1-0", F.lit("older")).otherwise(F.col("artifact_sha"))))
    decisions = old.where("artifact in ('dict0-0', 'dict1-0')").select("link_id", "basis", F.lit("ignored").alias("level"))
    return support.decided(links, decisions).select("dataset", "artifact", F.array_join("header_ids", ",").alias("header_ids"), "current", "decided", "eligible")


def support_maps(spark, d):
    """Code maps on which all eligible dictionaries agree."""
    headers, cells, artifacts = _support(spark, d)
    links = support.decided(support.dictionary_links(headers, cells, artifacts), spark.createDataFrame([], "link_id string, basis string, level string"))
    return support.support_maps(support.code_entries(links, headers, cells))


STUDY = (
    ("packaged", {"subject_id_fields": ["SUBJID"], "date_fields": ["DAT$"], "drop_fields": ["NAME$", "total"], "generalize_fields": {"PRIORITY$": {"1-URGENT": "now"}}, "plausible_max_year": 2026}),
    ("study", {"subject_id_fields": ["o_custkey"], "date_fields": ["date$"], "generalize_fields": {"PRIORITY$": {"1-URGENT": "urgent", "2-HIGH": "high"}}, "plausible_max_year": 1997}),
)


def scrub_packaged_orders(spark, d):
    """Orders under a packaged configuration, a study's own on top and one made from classified headers."""
    raw, _ = study_config.merge(STUDY)
    made = study_config.synthesize([("o_custkey", "pseudonymize"), ("o_orderkey", "pseudonymize"), ("o_orderstatus", "keep")])
    plan = scrub.scrub(_orders_text(spark, d), study_config.build(study_config.extend(raw, made)), KEY)
    return plan.kept.drop(scrub.MARKER).unionByName(plan.quarantine.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit("held").alias("o_orderdate"), F.col("reason").alias("o_orderpriority")))

"""Operators on files, shapes and records applied to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.operators import lineage, nested, privacy, redact, review, scoring, scrub, shaping, transform, verify
from shroud.sources import tables
from shroud.sources.work import work_path
from shroud.streaming import streams

SALT = "study-salt"


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(at, *values):
    """The value of a number's place."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def formats_read_back(spark, d):
    """Orders with awkward notes written as CSV, TSV, JSON lines and Parquet, and read back as text cells."""
    k, path = F.col("o_orderkey"), work_path(spark, "formats")
    rows = _t(spark, d, "orders").select(k.cast("string").alias("o_orderkey"), _pick(k, 'a "quoted", cell', "two\nlines", "", None, "tab\there", "0012").alias("note"))
    tables.write_csv(rows, f"{path}/csv")
    rows.write.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{path}/tsv")
    tables.write_jsonl(rows, f"{path}/jsonl")
    rows.write.parquet(f"{path}/parquet")
    out = None
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        back = tables.read_any(spark, f"{path}/{kind}", kind).select(F.lit(kind).alias("format"), "o_orderkey", "note")
        out = back if out is None else out.unionByName(back)
    return out


def csv_rejects(spark, d):
    """Lines with a cell too many, of files that each task writes with a header of its own."""
    k, path = F.col("o_orderkey"), work_path(spark, "rejects")
    line = F.concat(k.cast("string"), F.lit(",x"), F.when(k % 50 == 0, ",more").otherwise(""))
    tables.write_lines(_t(spark, d, "orders").select(line), "key,cell", path)
    return tables.read_csv_rejects(spark, path, ["key", "cell"]).withColumnRenamed(tables.CORRUPT, "line")


def _package(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/study/"), _pick(k, "datasets", "Forms", "dictionary_mapping", "annex"), F.lit("/f"), k.cast("string"), F.lit("."), _pick(F.floor(k / 4), "csv", "pdf", "xlsx"))
    return tables.classify_package(_t(spark, d, "orders").select(name.alias("path"), (k * 1000).alias("bytes")))


def package_components(spark, d):
    """Files of a package by component; one whose extension does not suit its folder has none."""
    return _package(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def package_faults(spark, d):
    return tables.package_faults(_package(spark, d))


def union_text_records(spark, d):
    """Two tables as one of text cells, columns in the order first seen."""
    a = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return shaping.union_records([a, _t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))])


def promoted_header(spark, d):
    """A sheet with a title above its header and a footer below, as a table."""
    n = _t(spark, d, "nation")
    body = n.select((F.col("n_nationkey") + 10).alias("row_no"), F.col("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    extra = n.where("n_nationkey < 4").select(_pick(F.col("n_nationkey"), 1, 2, 3, 9000).cast(body.schema["row_no"].dataType).alias("row_no"), _pick(F.col("n_nationkey"), "Nations", None, "Nation", "Total: all").alias("a"), _pick(F.col("n_nationkey"), None, "", "Region", "x").alias("b"), F.lit(" ").alias("c"))
    made = shaping.promote_header(body.unionByName(extra), "row_no", ["a", "b", "c"], "Total")
    return made.select("row_no", F.col("Nation").alias("nation"), F.col("Region").alias("region"), F.col("`Unnamed: 2`").alias("rest"))


def cell_maps(spark, d):
    """Customers as long cells and back as one map a row."""
    cells = shaping.to_cells(_t(spark, d, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"])
    return shaping.to_cell_map(cells, ["c_custkey"]).select("c_custkey", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("segment"))


def sentinel_classes(spark, d):
    """Small classes where null and blank are one value."""
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(_pick(k, None, " ", "", "x").alias("a"), (k % 997).cast("string").alias("b"))
    return privacy.k_anonymity(privacy.with_null_sentinel(rows, ["a", "b"]), ["a", "b"], 10)


def compared_rows(spark, d):
    """Rows that differ between a source and what was written, or that one side lacks."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    written = o.where(k % 9 != 0).select("o_orderkey", F.when(k % 10 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    found = verify.compare_rows(o.where(k % 8 != 0), written, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderkey", F.col("a.o_orderstatus").alias("before"), F.col("b.o_orderstatus").alias("after"))


def first_planted(spark, d):
    planted = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    return verify.first_planted(planted, ["l_suppkey", "l_returnflag"], "row_no")


def expectation_checks(spark, d):
    """Whether exported cells are as a manifest expects them, by kind."""
    k = F.col("o_orderkey")
    kind = _pick(k, "literal", "regex", "human_review", "text_scrub")
    cell = F.when(k % 4 == 0, F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("  "))).when(k % 4 == 1, F.col("o_orderpriority")).when(k % 4 == 2, F.when(k % 3 == 0, "kept").otherwise("[HUMAN_REVIEW_PENDING]")).otherwise(F.concat(F.lit("mail [F] "), F.when(k % 3 == 0, "leak").otherwise("")))
    must, must_not = F.array(F.lit("[F]")), F.array(F.lit("leak"), F.lit("@"))
    ok = verify.check_expectation(kind, cell, F.lit("F"), F.lit(r"[1-3]-[A-Z]+"), must, must_not)
    return _t(spark, d, "orders").select("o_orderkey", kind.alias("kind"), ok.alias("ok"))


def regulation_coverage(spark, d):
    """Planted orders by regulation, without those that leaked or were violated."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    planted = o.select(k.alias("plant_id"), F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("keys"))
    return verify.regulation_coverage(planted, o.where(k % 7 == 0).select(k.alias("plant_id")), o.where(k % 11 == 0).select(k.alias("plant_id")))


def unique_file_names(spark, d):
    return review.unique_names(_t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("form_"), F.col("o_custkey").cast("string")).alias("stem")), "stem", "o_orderkey")


def blocked_attempts(spark, d):
    """Running number of blocking verdicts by column, and whether a human is due."""
    e = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("blocked"))
    return review.blocked_attempts(e, ["user_id"], "event_id").select("event_id", "attempts", "escalate")


def overridden_actions(spark, d):
    """Actions after a human's review of some headers, whatever their case."""
    c = _t(spark, d, "customer").select(F.col("c_name").alias("header"), F.lit("drop").alias("action"))
    reviews = _t(spark, d, "customer").where("c_custkey % 5 = 0").select(F.lower("c_name").alias("header"), F.lit("keep").alias("action"))
    return review.overridden(c, reviews)


def reversal_map(spark, d):
    return transform.reversal_map(_t(spark, d, "customer"), "c_mktsegment", SALT)


def expired_events(spark, d):
    """Events that a retention of ten days before the last one would remove."""
    e = _t(spark, d, "events")
    last = e.agg(F.max("ts").alias("last")).first()["last"]
    return streams.expired(e, F.col("ts"), F.lit(last).cast("timestamp"), "10 days").select("event_id")


def file_digests(spark, d):
    """Digests of a copied table's files, compared with a copy of them and with a changed one."""
    path = work_path(spark, "digests")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey")
    for name, rows in (("a", n), ("b", n), ("c", n.where("n_nationkey <> 3"))):
        rows.select(F.concat_ws(",", "n_nationkey", "n_name")).write.text(f"{path}/{name}")
    side = lambda x: lineage.manifest(spark, f"{path}/{x}", "*.txt").select(F.lit("part").alias("path"), "sha256")
    same, other = lineage.snapshot_diff(side("a"), side("b")), lineage.snapshot_diff(side("a"), side("c"))
    return other.withColumn("against", F.lit("changed")).unionByName(same.withColumn("against", F.lit("copy")))


def band_status_orders(spark, d):
    """Order states as bands of values; a state that no band lists holds its row."""
    config = scrub.ScrubConfig(subject_id_fields=("o_custkey",), band_fields={"^o_orderstatus$": {"f": "closed", " O ": "open"}})
    rows = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    plan = scrub.scrub(rows, config, b"public test key")
    return plan.kept.select("o_orderkey", "o_orderstatus").unionByName(plan.quarantine.select("o_orderkey", F.col("reason").alias("o_orderstatus")))


def strengthen_cited(spark, d):
    """Support signals strengthen only where they cite a candidate rule."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    signals = o.select("o_orderkey", _pick(k, "drop", "keep", "hash").alias("action"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("rule"))
    rules = _t(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("rule"))
    decisions = o.select("o_orderkey", _pick(k, "keep", "hash").alias("action"))
    return scoring.strengthen(decisions, signals, ["o_orderkey"], ("keep", "hash", "drop"), rules).select("o_orderkey", "action", "changed")


def context_hygiene(spark, d):
    """Conversations as prompts: their size, what was scrubbed, and planted names that they still hold."""
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.concat("text", F.when(F.col("turn") == 0, F.concat(F.lit(" Customer#"), F.lpad((F.col("conv_id") % 50).cast("string"), 9, "0"))).otherwise("")).alias("text"))
    found = redact.prompt_violations(c, "id", "text", _t(spark, d, "customer").where("c_custkey < 20").select(F.concat(F.lit("customer#"), F.lpad("c_custkey", 9, "0")).alias("literal")), "literal")
    return scoring.context_hygiene(c, "id", "text", found, F.col("turn") % 3)


def reviewer_coverage(spark, d):
    """Reviews of files, a customer's orders each: what was checked and found."""
    o = _t(spark, d, "orders")
    reviews = o.groupBy("o_custkey").agg(F.when(F.bool_or(F.col("o_orderstatus") == "P"), "findings").otherwise("clean").alias("verdict"), F.sum((F.col("o_orderkey") % 9 == 0).cast("long")).alias("missing"), F.count(F.lit(1)).alias("decisions_checked"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("verdicts_found"))
    return scoring.reviewer_coverage(reviews)


def unreviewed_decisions(spark, d):
    """Decisions without a verdict, and on files that are not there."""
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("column"))
    return scoring.unreviewed(rows, rows.where("column % 4 <> 0"), _t(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("file")))


def masked_telemetry(spark, d):
    k = F.col("event_id")
    line = F.concat(F.lit("user "), (k + 1_000_000).cast("string"), _pick(k, " at 10.0.0.7", " mail a@b.example.org", " on 1/2/2020 by Ann Lee", " idle"))
    return _t(spark, d, "events").select("event_id", redact.mask_telemetry(line).alias("line"))


def joint_gate_events(spark, d):
    """Events as JSON through both passes of the gate: words in either case, and dates with a month's name in a column of moved dates."""
    k = F.col("event_id")
    note = _pick(k, "quiet", "mrn 1234567", "seen by dr. Ann Lee", "subj-12", "SUBJ-12")
    doc = F.to_json(F.struct(F.struct(note.alias("note")).alias("body"), F.array(_pick(k, "2024-05-20", "Jan 2, 2020", "none", "none", "none", "none", "none")).alias("VISDAT")))
    rows = _t(spark, d, "events").select("event_id", doc.alias("doc"))
    return nested.gate_verdicts(rows, "doc", ["event_id"], ("VISDAT",))

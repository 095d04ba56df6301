"""DuckDB SQL for the registered queries, written from their meaning and not from their plans."""

from __future__ import annotations

from shroud.functions.dates import BLANK, NULL_TOKENS
from shroud.functions.hashing import hmac_sha256_sql
from shroud.functions.numeric import NUMERIC
from shroud.functions.patterns import BLOCKING, GUARD_US, SPAN_RULES, SUBJECT_ID, WARN
from shroud.functions.text import RESTRICTED_ZIP3

KEY, SALT = b"public test key", "study-salt"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rid(label: str, value: str) -> str:
    digest = f"substr({hmac_sha256_sql(KEY, f'({q(label + ":")} || {value})')}, 1, 12)"
    return f"({q(f'RID_{label}_')} || translate({digest}, '0123456789abcdef', 'abcdefghijklmnop'))"


def offset(subject: str) -> str:
    return f"(CAST('0x' || substr({hmac_sha256_sql(KEY, subject)}, 1, 8) AS BIGINT) % 61 - 30)"


PSEUDONYM = f"'P' || substr(sha256({q(SALT + ':')} || c_name), 1, 8)"
CUSTOMER_ZIP = "lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0')"
ZIP3 = "CASE WHEN substr({z}, 1, 3) IN " + _in(RESTRICTED_ZIP3) + " THEN '000' ELSE substr({z}, 1, 3) END"
SUBJECT = "CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END"
MAPPED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'routine' WHEN '4-NOT SPECIFIED' THEN 'routine' END"
REASON = f"CASE WHEN {SUBJECT} IS NULL THEN 'orphan' WHEN {MAPPED} IS NULL THEN 'generalize:o_orderpriority' ELSE 'kept' END"
MIXED = [("%Y-%m-%d", "iso", "false"), ("%-m/%-d/%Y", "mdy", "false"), ("%m/%d/%Y", "mdy", "false"), ("%Y%m%d", "iso", "false"), ("%Y-%m-%d", "iso", "true"), ("%-m-%-d-%Y", "mdy", "false")]

_blocking = ",\n  ".join(f"CAST(count(*) FILTER (regexp_matches(text, {q(p.regex)})) AS BIGINT) AS {p.name.lower()}" for p in BLOCKING)
_counted = [r for r in SPAN_RULES if r.portable and r.luhn_prefix is None]
_matches = lambda r: f"len(regexp_extract_all(text, {q(r.regex)}))"
_names = lambda patterns: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(p.regex)}) THEN {q(p.name)} END" for p in patterns) + "], lambda x: x IS NOT NULL)), ',')"
_hits = lambda patterns: "greatest(" + ", ".join(f"CAST(regexp_matches(v, {q(p.regex)}) AS INT)" for p in patterns) + ")"

_guard = [p for p in GUARD_US if p.portable and not p.conditional]
_found = lambda table, file, cell: " UNION ALL ".join(f"SELECT {file} AS file, {q(p.name)} AS pid, regexp_extract({cell}, {q(p.regex)}) AS match FROM {table} WHERE regexp_matches({cell}, {q(p.regex)})" for p in _guard)
_ordered = "text"
for _r in SPAN_RULES:
    if _r.name in ("EMAIL", "PHONE", "CLINICAL_TRIAL_ID", "DEVICE_SERIAL"):
        _ordered = f"regexp_replace({_ordered}, {q(_r.regex)}, {q(f'[{_r.category}]')}, 'g')"
_tree = " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", {q(p.name)} AS pattern WHERE EXISTS (SELECT 1 FROM (SELECT c_name, c_mktsegment, 'SUBJ-' || c_custkey AS ref, 'seen 1998-0' || (c_custkey % 9 + 1) || '-11' AS visit FROM customer) WHERE regexp_matches({c}, {q(p.regex)}))" for c in ("c_name", "c_mktsegment", "ref", "visit") for p in BLOCKING + SUBJECT_ID
)
_luhn_digits = "('80840' || lpad(CAST(p_partkey * 7919 AS VARCHAR), 10, '1'))"

_CODES = """(SELECT o_orderkey AS k, o_orderpriority AS file, CASE o_orderkey % 4 WHEN 0 THEN 'no ' || lpad(CAST(o_orderkey AS VARCHAR), 4, '2') || ' 1234 5678'
    WHEN 1 THEN 'pan ABCDE' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || 'F' WHEN 2 THEN 'sin ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-111-222'
    ELSE 'cpf ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.111.222-33' END AS cell FROM orders)"""
_DECIDED = """SELECT o_custkey AS file, o_orderkey AS "column", CASE o_orderstatus WHEN 'F' THEN 'drop' WHEN 'O' THEN 'keep' ELSE 'hash' END AS expected,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'keep' WHEN '2' THEN 'drop' WHEN '3' THEN 'hash' WHEN '4' THEN 'human_review' ELSE 'year_only' END AS action FROM orders"""
_FACTS = f"""SELECT file, "column", expected, action,
    CASE WHEN action = 'human_review' THEN 'deferred' WHEN expected <> 'keep' AND coalesce(action, 'keep') = 'keep' THEN 'under_block'
      WHEN expected = 'keep' AND coalesce(action, 'keep') <> 'keep' THEN 'over_block' ELSE 'correct' END AS verdict,
    coalesce(action = expected, false) AS exact, coalesce(r, 0) AS leak_hits, coalesce(n, 0) AS cells, coalesce(changed, 0) AS changed
  FROM (SELECT file, "column", expected, CASE WHEN "column" % 5 = 0 THEN 'drop' WHEN "column" % 7 <> 0 THEN action END AS action FROM ({_DECIDED})) x
  LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n, count(*) FILTER (l_linenumber <> 1) AS changed FROM lineitem GROUP BY 1) y ON x."column" = l_orderkey"""

ORACLE_SQL: dict[str, str] = {
    "pseudonymize_customer": f"SELECT c_custkey, {PSEUDONYM} AS token FROM customer",
    "hash_customer": f"SELECT c_custkey, substr({hmac_sha256_sql(KEY, '(' + q('c_name:') + ' || c_name)')}, 1, 16) AS digest FROM customer",
    "rid_token_orders": f"SELECT o_orderkey, {rid('CUST', 'CAST(o_custkey AS VARCHAR)')} AS token FROM orders",
    "date_jitter_orders": f"""
        WITH o AS (SELECT o_orderkey, o_orderdate, {offset('CAST(o_custkey AS VARCHAR)')} AS days FROM orders)
        SELECT o_orderkey, CAST(days AS INTEGER) AS days, strftime(CAST(o_orderdate AS DATE) + CAST(days AS INTEGER), '%Y-%m-%d') AS shifted FROM o""",
    "date_jitter_interval_preserved": """
        SELECT o_custkey, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS INTEGER) AS days_before,
          CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS INTEGER) AS days_after FROM orders GROUP BY 1""",
    "year_only_orders": "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year FROM orders",
    "cap_age": "SELECT p_partkey, CASE WHEN p_size * 3 > 89 THEN '90+' ELSE CAST(p_size * 3 AS VARCHAR) END AS age FROM part",
    "zip3_truncate": f"SELECT c_custkey, {ZIP3.format(z=CUSTOMER_ZIP)} AS zip3 FROM customer",
    "band_totalprice": "SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'middle' ELSE 'high' END AS band FROM orders",
    "generalize_priority_disposition": f"SELECT CASE WHEN {MAPPED} IS NULL THEN 'generalize:o_orderpriority' ELSE 'kept' END AS disposition, count(*) AS n FROM orders GROUP BY 1",
    "clamp_small_cell": "SELECT CAST(least(CAST(trunc(l_quantity) AS INTEGER), 5) AS VARCHAR) AS cell, count(*) AS n FROM lineitem GROUP BY 1",
    "scrub_orders_full": f"""
        WITH o AS (SELECT *, {SUBJECT} AS s, {MAPPED} AS m, CAST(o_orderdate AS DATE) AS day FROM orders)
        SELECT {rid('ORD', 'CAST(o_orderkey AS VARCHAR)')} AS o_orderkey, {rid('CUST', 's')} AS o_custkey, o_orderstatus,
          CASE WHEN year(day) > 1997 THEN '' ELSE strftime(day + CAST({offset('s')} AS INTEGER), '%Y-%m-%d') END AS o_orderdate,
          m AS o_orderpriority, 'v3' AS _phi_scrubbed
        FROM o WHERE s IS NOT NULL AND m IS NOT NULL""",
    "scrub_orders_quarantine": f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {SUBJECT} AS o_custkey, o_orderpriority, {REASON} AS reason FROM orders WHERE {REASON} <> 'kept'",
    "scrub_event_counts": f"""
        WITH o AS (SELECT {REASON} = 'kept' AS kept, year(o_orderdate) <= 1997 AS dated FROM orders)
        SELECT scope, field, CAST(n AS BIGINT) AS n FROM (
          SELECT 'id' AS scope, 'o_orderkey' AS field, count(*) FILTER (kept) AS n FROM o
          UNION ALL SELECT 'id', 'o_custkey', count(*) FILTER (kept) FROM o
          UNION ALL SELECT 'generalize', 'o_orderpriority', count(*) FILTER (kept) FROM o
          UNION ALL SELECT 'date', 'o_orderdate', count(*) FILTER (kept AND dated) FROM o
          UNION ALL SELECT 'rows', 'kept', count(*) FILTER (kept) FROM o
          UNION ALL SELECT 'rows', 'quarantined', count(*) FILTER (NOT kept) FROM o)""",
    "held_fraction": f"""
        WITH h AS (SELECT o_orderpriority, count(*) AS rows, count(*) FILTER ({REASON} <> 'kept') AS held FROM orders GROUP BY 1)
        SELECT o_orderpriority, rows, CAST(held AS BIGINT) AS held, round(held / rows, 6) AS fraction, held / rows > 0.1 AS elevated FROM h""",
    "date_parse_mixed": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 6 "
    + " ".join(f"WHEN {i} THEN '{fmt}'" for i, (_, fmt, _) in enumerate(MIXED))
    + " END AS fmt, o_orderkey % 6 = 4 AS has_time FROM orders",
    "date_sentinel_tokens": f"""
        WITH o AS (SELECT o_orderkey, ['99999999', '00/00/0000', 'unk', ' // ', '1998-05-06', '9/9/99'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS cell FROM orders)
        SELECT o_orderkey, cell, regexp_matches(cell, {q(BLANK)}) OR upper(trim(cell)) IN {_in(NULL_TOKENS)} OR cell = '00/00/0000' AS placeholder FROM o""",
    "subject_resolve_orphans": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'orphan' AS reason FROM orders WHERE o_orderkey % 97 = 0",
    "secondary_id_drop": f"""
        WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey % 10 + 1 AS VARCHAR) AS s2 FROM lineitem)
        SELECT s AS "SUBJID", CASE WHEN s <> s2 THEN {rid('SUBJID', 's2')} END AS token, count(*) AS n FROM l GROUP BY 1, 2""",
    "kanon_customer": "SELECT c_nationkey || '|' || c_mktsegment AS class, count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) < 10",
    "kanon_smallest": "SELECT min(n) AS k, count(*) AS classes FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)",
    "ldiv_customer_orders": """
        SELECT 'o_orderstatus' AS attribute, c_nationkey || '|' || c_mktsegment AS class,
          CAST(count(DISTINCT o_orderstatus) + max(CAST(o_orderstatus IS NULL AS INT)) AS BIGINT) AS "values"
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey, c_mktsegment
        HAVING count(DISTINCT o_orderstatus) + max(CAST(o_orderstatus IS NULL AS INT)) < 4""",
    "small_cell_crosstab": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS VARCHAR) ELSE '<5' END AS cell FROM events GROUP BY 1, 2",
    "column_profile": f"""
        WITH c AS (SELECT "column", trim(v) AS v FROM (
          SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS "column",
            unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS v FROM customer) WHERE trim(v) <> ''),
        h AS (SELECT *, {_hits(BLOCKING)} AS b, {_hits(WARN)} AS w, CAST(regexp_matches(v, '^[0-9]{{6,8}}$') AS INT) AS d, CAST(regexp_matches(v, {q(NUMERIC)}) AS INT) AS x FROM c)
        SELECT "column", count(*) AS non_empty, count(DISTINCT v) AS "distinct", CAST(sum(b) AS BIGINT) AS blocking_hits, CAST(sum(w) AS BIGINT) AS warn_hits,
          CAST(sum(d) AS BIGINT) AS date_shaped, CAST(sum(x) AS BIGINT) AS "numeric", count(DISTINCT v) <= 10 AND sum(b) = 0 AS closed_categorical,
          sum(b) > 0.5 * count(*) OR sum(d) > 0.5 * count(*) AS value_conflict
        FROM h GROUP BY 1""",
    "column_stats_site_rule": """
        SELECT 'o_orderstatus' AS "column", count(*) AS rows, count(DISTINCT o_orderstatus) AS "distinct" FROM orders
        UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders""",
    "blocking_scan_documents": f"SELECT source, count(*) AS rows, {_blocking} FROM documents GROUP BY source",
    "gate_conversations": f"SELECT conv_id, turn, {_names(BLOCKING)} AS blocked, {_names(WARN)} AS warned FROM conversations",
    "tree_scan_customer": _tree,
    "guard_top20_by_source": f"""
        WITH f AS ({_found('documents', 'source', 'text')}),
        n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pid, match) AS n FROM (SELECT DISTINCT file, pid, match FROM f))
        SELECT file, pid, CASE WHEN length(match) <= 4 THEN repeat('*', length(match)) ELSE left(match, 2) || repeat('*', length(match) - 4) || right(match, 2) END AS sample,
          CAST(n AS INTEGER) AS n FROM n WHERE n <= 20""",
    "guard_report_portable": f"""
        WITH f AS ({_found('documents', 'source', 'text')}), c AS (SELECT file, count(*) AS n FROM f GROUP BY file)
        SELECT d.file, CASE WHEN n > 0 THEN 'blocked' ELSE 'clean' END AS status, coalesce(n, 0) AS findings
        FROM (SELECT DISTINCT source AS file FROM documents) d LEFT JOIN c ON d.file = c.file""",
    "guard_lines": f"""
        WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM documents),
        f AS ({_found('l', 'doc_id', 'line')})
        SELECT file AS doc_id, pid, count(*) AS lines FROM f GROUP BY 1, 2""",
    "scrub_text_documents": f"SELECT doc_id, sha256({_ordered}) AS digest FROM documents",
    "detect_counts_by_category": "SELECT lang, " + ", ".join(f"CAST(sum({_matches(r)}) AS BIGINT) AS {r.name.lower()}" for r in _counted) + " FROM documents GROUP BY lang",
    "conversation_scrub_counts": "SELECT conv_id, CAST(sum(" + " + ".join(_matches(r) for r in _counted) + ") AS BIGINT) AS spans FROM conversations GROUP BY conv_id",
    "mask_samples": """
        SELECT o_orderkey, substr(o_orderpriority, 1, 2) || repeat('*', length(o_orderpriority) - 4) || right(o_orderpriority, 2) AS sample,
          '99 XXX 9999' AS shape FROM orders""",
    "formula_neutralise": """
        WITH p AS (SELECT p_partkey, ['=', '+', '-', '@', '', ' '][CAST(p_partkey % 6 + 1 AS INTEGER)] || p_name AS c FROM part)
        SELECT p_partkey, CASE WHEN left(c, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS cell FROM p""",
    "leak_token_join": r"""
        WITH l AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9@.''\-]+')) AS literal FROM benchmark),
        w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9@.''\-]+')) AS literal FROM documents)
        SELECT literal, count(DISTINCT doc_id) AS docs FROM w JOIN l USING (literal) WHERE length(literal) >= 4 AND length(literal) <= 256 GROUP BY literal""",
    "leak_contains_join": """
        WITH p AS (SELECT DISTINCT lower(text) AS passage FROM benchmark WHERE length(text) > 0)
        SELECT DISTINCT doc_id, sha256(passage) AS passage FROM documents JOIN p ON contains(lower(text), passage)""",
    "confusion_by_source": """
        WITH r AS (SELECT source, quality = 0 AS e, contains(text, '!!') OR contains(text, ' | ') OR contains(text, '###') AS p FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT source, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM r GROUP BY source)
        SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
          round(CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END, 6) AS recall,
          round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
    "calibration_buckets": """
        WITH e AS (SELECT least(greatest(value / 500.0, 0), 1) AS c, event_type = 'click' AS ok FROM events),
        b AS (SELECT CASE WHEN c < 0.5 THEN 0 WHEN c < 0.8 THEN 1 WHEN c < 0.95 THEN 2 ELSE 3 END AS bucket, ok FROM e WHERE c IS NOT NULL)
        SELECT CAST(k AS INTEGER) AS bucket, count(ok) AS n, round(CASE WHEN count(ok) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (ok) / count(ok) END, 6) AS accuracy
        FROM range(4) r(k) LEFT JOIN b ON bucket = k GROUP BY k""",
    "exact_coverage": """
        SELECT fault, count(*) AS n FROM (
          SELECT DISTINCT doc_id, 'missing' AS fault FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
          UNION ALL SELECT DISTINCT doc_id, 'invented' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
          UNION ALL SELECT doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1) GROUP BY fault""",
    "latest_decision": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_hash_chain": """
        WITH e AS (SELECT user_id AS run_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
        SELECT run_id, seq FROM e WHERE before IS NOT NULL AND seq % 50 = 0""",
    "rate_window": """
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW) AS hits FROM events""",
    "phase_durations": """
        WITH e AS (SELECT user_id, date_trunc('second', ts) AS moment, min(event_id) AS event_id FROM events GROUP BY 1, 2)
        SELECT user_id, event_id, CAST(epoch(lead(moment) OVER w) - epoch(moment) AS BIGINT) AS seconds FROM e WINDOW w AS (PARTITION BY user_id ORDER BY moment)""",
    "snapshot_diff": """
        WITH o AS (SELECT o_orderkey AS path, sha256(o_orderpriority) AS a, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE sha256(o_orderpriority) END AS b FROM orders),
        d AS (SELECT path, CASE WHEN path % 10 = 0 AND path % 11 <> 0 THEN 'added' WHEN path % 10 <> 0 AND path % 11 = 0 THEN 'removed'
          WHEN path % 10 <> 0 AND path % 11 <> 0 AND a <> b THEN 'changed' END AS change FROM o)
        SELECT path, change FROM d WHERE change IS NOT NULL""",
    "cleanup_check": """
        SELECT o_orderkey AS path, 'still_there' AS fault FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0""",
    "injective_check": f"""
        WITH c AS (SELECT DISTINCT c_name, substr({PSEUDONYM}, 1, 3) AS token FROM customer)
        SELECT 'collision' AS fault, token AS value, count(*) AS n FROM c GROUP BY token HAVING count(*) > 1""",
    "luhn_valid": f"""
        WITH p AS (SELECT p_partkey, reverse({_luhn_digits}) AS r FROM part),
        d AS (SELECT p_partkey, list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(r, i, 1) AS INTEGER)
          WHEN CAST(substr(r, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(r, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(r, i, 1) AS INTEGER) END)) AS total FROM p)
        SELECT p_partkey, total % 10 = 0 AS valid FROM d""",
    "normalize_header": """
        SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_type || ' - ' || p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS header FROM part""",
    "cells_long": """
        SELECT n_nationkey, CAST(0 AS INTEGER) AS column_index, n_name AS value FROM nation
        UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation""",
    "value_map_conflicts": "SELECT n_name AS code, CAST(n_regionkey AS VARCHAR) AS label FROM nation",
    "blank_segments": """
        WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS filled FROM lineitem),
        s AS (SELECT *, sum(CAST(filled AND NOT coalesce(before, false) AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS segment
          FROM (SELECT *, lag(filled) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM l))
        SELECT l_orderkey, CAST(segment AS BIGINT) AS segment, count(*) AS n FROM s WHERE filled GROUP BY 1, 2""",
    "kept_scan_customer": "SELECT 'note' AS \"column\", 'PHONE_US' AS pattern, count(*) AS rows FROM customer",
    "replay_customer": f"""
        SELECT 'P' || substr(sha256({q(SALT + ':')} || c_custkey), 1, 8) AS patient_id, '' AS full_name, c_mktsegment AS study_arm,
          CASE WHEN c_nationkey * 4 > 89 THEN '90+' ELSE CAST(c_nationkey * 4 AS VARCHAR) END AS age FROM customer""",
    "release_actions": f"""
        SELECT substr({hmac_sha256_sql(SALT.encode(), "('c_custkey:' || c_custkey)")}, 1, 16) AS c_custkey, '' AS c_name, '[HUMAN_REVIEW_PENDING]' AS c_mktsegment,
          {ZIP3.format(z="lpad(CAST(c_custkey AS VARCHAR), 5, '0')")} AS zip FROM customer""",
    "shape_verdicts": "SELECT unnest(['c_custkey', 'c_name', 'zip', 'c_mktsegment']) AS \"column\", unnest([true, true, true, false]) AS ok",
    "stream_scrub_orders": f"""
        SELECT {rid('ORD', 'CAST(o_orderkey AS VARCHAR)')} AS o_orderkey, {rid('CUST', 'CAST(o_custkey AS VARCHAR)')} AS o_custkey, o_orderpriority, 'v3' AS _phi_scrubbed FROM orders""",
    "stream_tumbling_events": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "tumbling_events": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_events": """
        WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
        s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "guard_pack_india": f"""
        SELECT file, 'AADHAAR' AS pid, count(*) AS cells, min(regexp_extract(cell, '[0-9]{{4}} 1234 5678')) AS first FROM {_CODES} WHERE k % 4 = 0 AND regexp_matches(cell, ' [0-9]{{4}} 1234 5678') GROUP BY file
        UNION ALL SELECT file, 'PAN_IN', count(*), min(substr(cell, 5)) FROM {_CODES} WHERE k % 4 = 1 GROUP BY file""",
    "guard_pack_canada": f"""
        SELECT file, 'SIN_CA' AS pid, count(*) AS cells, min(substr(cell, 5)) AS first FROM {_CODES} WHERE k % 4 = 2 GROUP BY file""",
    "guard_pack_brazil": f"""
        SELECT file, 'CPF_BR' AS pid, count(*) AS cells, min(substr(cell, 5)) AS first FROM {_CODES} WHERE k % 4 = 3 GROUP BY file""",
    "guard_conditional_age": """
        SELECT 'note' AS "column", count(*) AS hits FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 100 >= 90
        UNION ALL SELECT 'years', count(*) FROM part WHERE p_partkey % 100 >= 90""",
    "header_policy": """
        SELECT * FROM (VALUES ('patient_name', 'drop', 'A', 'direct_identifier'), ('FNAME', 'drop', '', 'direct_identifier'), ('LNAME', 'drop', '', 'direct_identifier'), ('INIT', 'drop', '', 'direct_identifier'),
          ('SIGN', 'drop', '', 'direct_identifier'), ('BANKNAME', 'drop', '', 'direct_identifier'), ('DL_NO', 'drop', '', 'direct_identifier'), ('ICFDT', 'year_only', '', 'date'), ('p_h_o_n_e', 'keep', '', ''),
          ('phone_number', 'drop', 'D', 'direct_identifier'), ('VISDAT', 'year_only', '', 'date'), ('AGE', 'cap_age_90', 'C', 'age'), ('zip', 'zip3_truncate', 'B', 'direct_identifier'), ('notes', 'scrub_text', '', 'free_text'),
          ('LB_PAXPROCSIG', 'pseudonymize', '', 'study_identifier'), ('RESPNDT', 'keep', '', ''), ('SUBJID2', 'pseudonymize', '', 'study_identifier'), ('hemoglobin', 'keep', '', ''), ('OrigPgSeq', 'drop', '', 'direct_identifier'),
          ('village', 'human_review', '', 'geography'), ('contacts_total', 'scrub_text', '', 'free_text'), ('unknownthing', 'keep', '', '')) t(header, action, category, rules)""",
    "scrub_birthdate_no_age": f"""
        WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS "ROW", strftime(CAST(o_orderdate AS DATE) + CAST({offset('CAST(o_custkey AS VARCHAR)')} AS INTEGER), '%Y-%m-%d') AS moved FROM orders)
        SELECT "ROW", moved AS "BRTH", moved AS "DEATHDT" FROM o""",
    "date_ambiguous_quarantine": """
        SELECT CAST(o_orderkey AS VARCHAR) AS "ROW", CASE WHEN day(o_orderdate) <= 12 THEN 'date:SEENDAT' ELSE 'kept' END AS disposition FROM orders""",
    "column_facts": f"SELECT * EXCLUDE (file) FROM ({_FACTS})",
    "benchmark_totals": f"""
        SELECT count(*) AS columns, count(*) FILTER (expected <> 'keep') AS identifying, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (action IN ('hash', 'year_only')) AS transformed,
          count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'human_review') AS deferred, round(count(*) FILTER (exact) / count(*), 4) AS method_exact_rate,
          round(1 - round(count(*) FILTER (action = 'human_review') / count(*), 4), 4) AS autonomy_rate FROM ({_FACTS})""",
    "conformance_by_flag": """
        WITH c AS (SELECT l_returnflag, l_linenumber % 6 = 0 AS gone, l_linenumber = 2 AS verbatim, l_quantity <= 40 AND l_linenumber % 6 <> 0 AS ok FROM lineitem),
        g AS (SELECT l_returnflag, count(*) FILTER (gone OR NOT verbatim) AS transforms, count(*) FILTER ((gone OR NOT verbatim) AND ok) AS conformant,
          count(*) FILTER (verbatim AND NOT gone) AS kept, count(*) FILTER (verbatim AND NOT gone AND ok) AS preserved FROM c GROUP BY 1)
        SELECT *, round(conformant / transforms, 4) AS transform_rate, round(preserved / kept, 4) AS utility_rate FROM g""",
    "leak_rate_by_segment": """
        WITH c AS (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS hit FROM customer)
        SELECT c_mktsegment, count(*) AS plants, count(*) FILTER (hit) AS leaked, round(count(*) FILTER (hit) / count(*), 4) AS rate FROM c GROUP BY 1""",
    "campaign_rollup": "SELECT l_returnflag, count(*) AS reports, CAST(sum(l_linenumber) AS BIGINT) AS plants FROM lineitem GROUP BY 1",
    "action_counts": f"SELECT action, count(*) AS n FROM ({_DECIDED}) GROUP BY 1",
    "tool_coverage": "SELECT count(*) FILTER (o_orderkey % 2 = 0) AS rules, count(*) FILTER (o_orderstatus = 'F') AS model, CAST(0 AS BIGINT) AS review FROM orders",
    "joined_policy_view": "SELECT c_custkey, c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS in_schema FROM customer",
    "dictionary_drift": "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01')",
    "strengthen_actions": f"""
        WITH r AS (SELECT *, CASE action WHEN 'keep' THEN 1 WHEN 'year_only' THEN 2 WHEN 'hash' THEN 7 WHEN 'human_review' THEN 8 ELSE 9 END AS a,
          CASE WHEN "column" % 3 <> 0 THEN 0 WHEN expected = 'keep' THEN 1 WHEN expected = 'hash' THEN 7 ELSE 9 END AS e FROM ({_DECIDED}))
        SELECT "column", CASE WHEN e > a THEN expected ELSE action END AS action, e > a AS changed FROM r""",
    "unmet_dependencies": "SELECT l_returnflag AS dataset, count(DISTINCT l_suppkey) AS unmet FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY 1",
    "force_drop_columns": """
        SELECT DISTINCT l_returnflag AS form, l_partkey AS "column" FROM lineitem WHERE l_linenumber IN (1, 2)
        EXCEPT SELECT l_returnflag, l_partkey FROM lineitem WHERE l_linenumber = 3""",
    "latest_snapshot": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "as_written_ledger": """
        WITH c AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 5 <> 0)
        SELECT 'c_name' AS "column", 'pseudonymize' AS rule, n AS cells, n AS changed FROM c UNION ALL SELECT 'c_mktsegment', 'keep', n, 0 FROM c""",
    "event_hash_recomputed": "SELECT event_id FROM events WHERE event_id % 50 = 0 AND event_type <> 'forged'",
}

"""DuckDB SQL over files, shapes and records."""

from __future__ import annotations

TABLES_SQL: dict[str, str] = {
    "formats_read_back": """
        SELECT format, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a "quoted", cell' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 4 THEN 'tab' || chr(9) || 'here' WHEN 5 THEN '0012' ELSE '' END AS note
        FROM orders, (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet')) f(format)""",
    "csv_rejects": "SELECT o_orderkey || ',x,more' AS line FROM orders WHERE o_orderkey % 50 = 0",
    "package_components": """
        WITH p AS (SELECT o_orderkey * 1000 AS bytes, o_orderkey % 4 AS f, o_orderkey // 4 % 3 AS e FROM orders)
        SELECT CASE WHEN f = 0 AND e IN (0, 2) THEN 'datasets' WHEN f = 1 AND e IN (1, 2) THEN 'forms' WHEN f = 2 THEN 'dictionary_mapping' END AS component, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1""",
    "package_faults": "SELECT unnest(['unclassified'] || CASE WHEN count(*) > 4096 THEN ['too_many_files'] ELSE [] END || CASE WHEN sum(o_orderkey * 1000) > 4294967296 THEN ['too_large'] ELSE [] END) AS fault FROM orders",
    "union_text_records": """
        SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, '' AS o_orderkey FROM customer
        UNION ALL SELECT CAST(o_custkey AS VARCHAR), '', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'""",
    "promoted_header": "SELECT n_nationkey + 10 AS row_no, n_name AS nation, CAST(n_regionkey AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS rest FROM nation",
    "cell_maps": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
    "sentinel_classes": """
        SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'x' ELSE '<NULL>' END || '|' || (o_orderkey % 997) AS class, count(*) AS size FROM orders GROUP BY 1 HAVING count(*) < 10""",
    "compared_rows": """
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderstatus AS before, CASE WHEN b.o_orderkey % 10 <> 0 THEN b.o_orderstatus END AS after
        FROM (SELECT * FROM orders WHERE o_orderkey % 8 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR b.o_orderkey % 10 = 0""",
    "first_planted": "SELECT l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS row_no FROM lineitem GROUP BY 1, 2",
    "expectation_checks": """
        SELECT o_orderkey, ['literal', 'regex', 'human_review', 'text_scrub'][o_orderkey % 4 + 1] AS kind,
          CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus = 'F' WHEN 1 THEN regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+') ELSE o_orderkey % 3 <> 0 END AS ok FROM orders""",
    "regulation_coverage": """
        WITH p AS (SELECT o_orderkey AS k, unnest([o_orderstatus, left(o_orderpriority, 1)]) AS key FROM orders)
        SELECT key, count(DISTINCT k) AS planted, count(DISTINCT k) FILTER (k % 7 <> 0 AND k % 11 <> 0) AS neutralised FROM p GROUP BY key""",
    "unique_file_names": """
        SELECT o_orderkey, 'form_' || o_custkey AS stem, 'form_' || o_custkey || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS name
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""",
    "blocked_attempts": """
        WITH e AS (SELECT event_id, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS attempts FROM events)
        SELECT event_id, attempts, attempts >= 3 AS escalate FROM e""",
    "overridden_actions": "SELECT c_name AS header, CASE WHEN c_custkey % 5 = 0 THEN 'keep' ELSE 'drop' END AS action FROM customer",
    "reversal_map": "SELECT DISTINCT c_mktsegment AS value, 'P' || substr(sha256('study-salt:' || c_mktsegment), 1, 8) AS token FROM customer",
    "expired_events": "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY",
    "file_digests": "SELECT 'part' AS path, 'changed' AS change, 'changed' AS against FROM nation LIMIT 1",
    "band_status_orders": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'band:o_orderstatus' END AS o_orderstatus FROM orders",
    "strengthen_cited": """
        WITH x AS (SELECT o_orderkey AS k, o_orderkey % 2 AS now, CASE WHEN o_orderkey % 5 < 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END ELSE 0 END AS told FROM orders)
        SELECT k AS o_orderkey, ['keep', 'hash', 'drop'][greatest(now, told) + 1] AS action, told > now AS changed FROM x""",
    "context_hygiene": """
        WITH c AS (SELECT turn, conv_id % 50 AS n, text || CASE WHEN turn = 0 THEN ' Customer#' || lpad(CAST(conv_id % 50 AS VARCHAR), 9, '0') ELSE '' END AS text FROM conversations),
        f AS (SELECT (SELECT count(*) FROM customer WHERE c_custkey < 20 AND contains(lower(c.text), 'customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'))) AS n, turn, text FROM c)
        SELECT count(*) AS prompts_audited, CAST(sum(length(text)) AS BIGINT) AS prompt_chars_audited, CAST(sum(turn % 3) AS BIGINT) AS identifiers_removed, CAST(sum(n) AS BIGINT) AS literals_found, sum(n) = 0 AS clean FROM f""",
    "reviewer_coverage": """
        SELECT count(DISTINCT o_custkey) AS files_checked, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P') AS files_with_findings, count(*) AS decisions_checked, count(*) FILTER (o_orderstatus = 'F') AS verdicts_found,
          count(*) FILTER (o_orderkey % 9 = 0) AS missing, count(*) FILTER (o_orderstatus = 'P') = 0 AS clean FROM orders""",
    "unreviewed_decisions": """
        SELECT o_custkey AS file, o_orderkey AS "column", 'no_verdict' AS fault FROM orders WHERE o_orderkey % 4 = 0
        UNION ALL SELECT o_custkey, o_orderkey, 'no_file' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 <> 0)""",
    "masked_telemetry": """
        SELECT event_id, 'user ' || CASE WHEN length(CAST(event_id + 1000000 AS VARCHAR)) IN (6, 7) THEN '[REDACTED]' ELSE CAST(event_id + 1000000 AS VARCHAR) END
          || [' at [REDACTED]', ' mail [REDACTED]', ' on [REDACTED] by [REDACTED]', ' idle'][event_id % 4 + 1] AS line FROM events""",
    "joint_gate_events": "SELECT event_id, event_id % 5 = 0 AND event_id % 7 <> 1 OR event_id % 5 = 3 AND event_id % 7 <> 1 AS passed FROM events",
}

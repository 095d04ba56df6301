"""DuckDB SQL over header reviews, lexicon gates and rule safety; what each header comes to is written out."""

from __future__ import annotations

_PADS = [bytes(b ^ x for b in b"public test key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def _mac(value: str) -> str:
    return f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({value}))))"


def _rid(label: str, value: str) -> str:
    return f"'RID_{label}_' || translate(substr({_mac(f"('{label}:' || {value})")}, 1, 12), '0123456789abcdef', 'abcdefghijklmnop')"


#: (place, header, normalised, action, risky, strong)
_HEADERS = """(VALUES (0, 'SUBJID', 'subjid', 'pseudonymize', false, false), (1, 'VISDAT', 'visdat', 'jitter_date', false, false), (2, 'hemoglobin', 'hemoglobin', 'keep', false, false),
    (3, 'interviewer_remarks', 'interviewer_remarks', 'suppress', true, false), (4, 'fname', 'fname', 'drop', true, true), (5, 'Visit Date', 'visit_date', 'jitter_date', false, false), (6, ' ', '', 'keep', false, false),
    (7, 'GPS lat', 'gps_lat', 'keep', true, false), (8, 'e_mail_ok', 'e_mail_ok', 'drop', true, true), (9, 'whatsapp', 'whatsapp', 'keep', true, true), (10, 'sign_off', 'sign_off', 'keep', false, true),
    (11, 'visit_date', 'visit_date', 'jitter_date', false, false), (12, 'weight_kg', 'weight_kg', 'keep', false, false), (13, 'pincode', 'pincode', 'keep', true, false), (14, 'notes', 'notes', 'suppress', true, false),
    (15, 'age', 'age', 'cap', false, false)) h(place, header, norm, action, risky, strong)"""

HEADERS_SQL: dict[str, str] = {
    "review_headers_forms": f"""
        WITH o AS (SELECT o_orderkey // 8 AS form, o_orderkey AS position, o_orderstatus, h.* FROM orders JOIN {_HEADERS} ON h.place = (o_orderkey + o_orderkey // 8) % 16),
        r AS (SELECT *, row_number() OVER (PARTITION BY form, norm ORDER BY position) > 1 AND norm <> '' AS repeated FROM o),
        f AS (SELECT form, string_agg(DISTINCT fault, '; ' ORDER BY fault) AS one, list(fault ORDER BY position) AS faults FROM (
          SELECT form, position, CASE WHEN norm = '' THEN 'blank header at position ' || position WHEN repeated THEN 'duplicate normalized header: ' || norm END AS fault FROM r) WHERE fault IS NOT NULL GROUP BY form),
        j AS (SELECT r.*, faults, o_orderstatus = 'F' AS asked, o_orderstatus = 'F' AND position % 5 = 0 AS phi,
          CASE WHEN o_orderstatus <> 'F' THEN '' WHEN position % 11 = 0 THEN 'drop' WHEN position % 7 = 0 THEN 'keep' ELSE '' END AS sot, position % 13 = 0 AS confirmed FROM r LEFT JOIN f USING (form))
        SELECT form, position, header, action,
          sot = 'drop' OR (action = 'drop' AND NOT confirmed) OR (action = 'keep' AND risky AND NOT (asked AND NOT phi AND (NOT strong OR sot <> '')) AND NOT confirmed) AS force_drop,
          CASE WHEN faults IS NULL THEN 'approved' ELSE 'held' END AS status, coalesce(array_to_string(faults, '; '), '') AS reasons FROM j""",
    "rule_safety": """
        WITH p AS (SELECT c_custkey AS proposal_id, c_custkey % 6 AS kind, CASE c_nationkey % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' ELSE 'zap' END AS action,
          CASE c_nationkey % 4 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' WHEN 2 THEN 'drop' END AS cited FROM customer),
        e AS (SELECT proposal_id, list_filter([CASE WHEN action = 'zap' THEN 'unknown action' END,
            CASE kind WHEN 1 THEN 'over-broad' WHEN 2 THEN 'does not compile' WHEN 3 THEN 'does not match its own header' WHEN 4 THEN 'matches a benign header' WHEN 5 THEN 'cost is not bounded' END,
            CASE WHEN cited IS NULL THEN 'rule is not in the rulebook' WHEN cited <> action THEN 'action is not the rule''s' END], lambda x: x IS NOT NULL) AS errors FROM p)
        SELECT proposal_id, len(errors) = 0 AS ok, array_to_string(errors, '; ') AS errors FROM e""",
    "gate_lexicon_parts": """
        WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS word FROM part),
        t AS (SELECT DISTINCT string_split(lower(p_type), ' ')[1:2] AS tokens FROM part),
        x AS (SELECT tokens, array_to_string(list_transform(tokens, lambda k: upper(left(k, 1)) || substr(k, 2)), ' ') AS text FROM t),
        y AS (SELECT text, (len(tokens) >= 2 AND (SELECT count(*) FROM w WHERE list_contains(tokens, word) AND length(word) % 2 = 0) = len(list_distinct(tokens))) OR text LIKE 'Promo B%' AS clinical,
            len(tokens) BETWEEN 2 AND 4 AND (SELECT count(*) FROM w WHERE list_contains(tokens, word) AND word LIKE 'p%') > 0 AS named FROM x)
        SELECT text, '' AS blocked, CASE WHEN NOT clinical AND named AND regexp_matches(text, '\\b[A-Z][a-z]{2,15}\\s+[A-Z][a-z]{2,15}\\b') THEN 'PERSON_NAME_GENERIC' ELSE '' END AS warned FROM y
        UNION ALL SELECT DISTINCT 'Lot ' || (p_partkey + 1000000), '', 'NUMERIC_ID_SHORT' FROM part""",
    "dependency_links": """
        SELECT dataset, 'dict' || n_regionkey || '-' || copy AS artifact, dataset || '/' || n_regionkey AS header_ids, n_regionkey = 0 AS current, CASE WHEN n_regionkey = 0 THEN 'ignored' END AS decided, n_regionkey <> 0 AS eligible
        FROM (SELECT DISTINCT c_mktsegment AS dataset FROM customer), (SELECT DISTINCT n_regionkey FROM nation), (VALUES (0), (1)) c(copy) WHERE copy = 0 OR n_regionkey = 2""",
    "support_maps": """
        SELECT 'nationr' || n_regionkey AS map_name, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS sources FROM nation
        WHERE n_regionkey NOT IN (2, 3) OR (n_regionkey = 2 AND (SELECT bool_and(n_name = lower(n_name)) FROM nation WHERE n_regionkey = 2)) OR (n_regionkey = 3 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3 AND n_nationkey % 2 = 0 AND n_name <> lower(n_name)))""",
    "scrub_packaged_orders": f"""
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS subject, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' END AS priority FROM orders),
        p AS (SELECT *, CASE WHEN subject IS NULL THEN 'orphan' WHEN priority IS NULL THEN 'generalize:o_orderpriority' END AS held FROM o)
        SELECT CASE WHEN held IS NULL THEN {_rid('O_ORDERKEY', 'CAST(o_orderkey AS VARCHAR)')} ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
          CASE WHEN held IS NULL THEN {_rid('O_CUSTKEY', 'subject')} ELSE subject END AS o_custkey, o_orderstatus,
          CASE WHEN held IS NOT NULL THEN 'held' WHEN year(day) > 1997 THEN '' ELSE strftime(day + CAST(CAST('0x' || substr({_mac('subject')}, 1, 8) AS BIGINT) % 61 - 30 AS INTEGER), '%Y-%m-%d') END AS o_orderdate,
          coalesce(held, priority) AS o_orderpriority FROM p""",
}

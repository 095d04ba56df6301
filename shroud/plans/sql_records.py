"""DuckDB SQL over digest trees and event logs."""

from __future__ import annotations


def _tree(depths: int = 4) -> str:
    """The digest tree of documents of up to 64 entries a lowest prefix; four digits are enough for a million rows."""
    with_ = ["e AS (SELECT sha256(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id || CASE WHEN text IS NULL THEN '-' ELSE '64:' || sha256(text) END) AS address, count(*) AS n FROM documents GROUP BY doc_id, text)"]
    for k in range(depths, -1, -1):
        with_.append(f"p{k} AS (SELECT substr(address, 1, {k}) AS prefix, count(*) AS entries, CAST(sum(n) AS BIGINT) AS n, string_agg(address || ':' || n, ',' ORDER BY address) AS lines FROM e GROUP BY 1)")
        children = f"(SELECT string_agg(substr(c.prefix, {k + 1}, 1) || c.digest, ',' ORDER BY c.prefix) FROM g{k + 1} c WHERE substr(c.prefix, 1, {k}) = p.prefix)" if k < depths else "''"
        with_.append(f"g{k} AS MATERIALIZED (SELECT prefix, entries, n, CASE WHEN entries <= 64 THEN sha256('entries ' || lines) ELSE sha256('nodes ' || {children}) END AS digest FROM p{k} p)")
    nodes = " UNION ALL ".join(f"SELECT prefix AS bucket, n, digest FROM g{k}" + (f" WHERE substr(prefix, 1, {k - 1}) IN (SELECT prefix FROM g{k - 1} WHERE entries > 64)" if k else "") for k in range(depths + 1))
    return f"WITH {', '.join(with_)} {nodes}"


_CHAIN = """WITH RECURSIVE o AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS run, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS seq,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS body FROM events),
  h AS (
    SELECT run, seq, event_id, ts, '' AS prev_hash, sha256('{"event":' || body || ',"prev_hash":"","run":"' || run || '","seq":0}') AS hash FROM o WHERE seq = 0
    UNION ALL
    SELECT o.run, o.seq, o.event_id, o.ts, h.hash, sha256(h.hash || '{"event":' || o.body || ',"prev_hash":"' || h.hash || '","run":"' || o.run || '","seq":' || o.seq || '}') FROM h JOIN o ON o.run = h.run AND o.seq = h.seq + 1)"""

_HELD = "CASE WHEN o_orderkey % 97 = 0 OR o_custkey IS NULL THEN 'orphan' WHEN left(o_orderpriority, 1) NOT IN ('1', '2', '3', '4') THEN 'generalize:o_orderpriority' END"

RECORDS_SQL: dict[str, str] = {
    "manifest_digest": _tree(),
    "manifest_difference": """
        SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 31 = 0 AND text IS NOT NULL)
        UNION ALL SELECT CAST(doc_id + 1000000000 AS VARCHAR), 'added' FROM documents WHERE doc_id % 50 = 0""",
    "event_chain": f"{_CHAIN} SELECT run, seq, event_id, prev_hash, hash FROM h",
    "event_seals": f"{_CHAIN} SELECT run, seq - 9 AS from_seq, seq AS to_seq, hash AS segment_hash FROM h WHERE seq % 10 = 9",
    "event_log_faults": """
        WITH o AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS seq FROM events),
        n AS (SELECT *, lag(k) OVER (PARTITION BY run ORDER BY seq) AS before FROM o)
        SELECT run, seq, 'forged' AS fault FROM o WHERE k % 97 <> 0 AND k % 50 = 0
        UNION ALL SELECT run, seq, 'gap' FROM n WHERE k % 97 <> 0 AND before % 97 = 0
        UNION ALL SELECT run, seq, 'repeated' FROM o WHERE k % 97 <> 0 AND k % 89 = 0
        UNION ALL SELECT run, seq, 'unsealed' FROM o WHERE k % 97 = 0 AND seq % 10 = 9""",
    "stream_event_chain": f"{_CHAIN} SELECT run, seq, event_id, hash FROM h WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "audited_scrub_orders": f"""
        WITH o AS (SELECT {_HELD} AS held, year(o_orderdate) <= 1997 AS dated FROM orders)
        SELECT 'id' AS scope, 'o_orderkey' AS field, count(*) FILTER (held IS NULL) AS n FROM o
        UNION ALL SELECT 'id', 'o_custkey', count(*) FILTER (held IS NULL) FROM o
        UNION ALL SELECT 'generalize', 'o_orderpriority', count(*) FILTER (held IS NULL) FROM o
        UNION ALL SELECT 'date', 'o_orderdate', count(*) FILTER (held IS NULL AND dated) FROM o
        UNION ALL SELECT 'rows', 'kept', count(*) FILTER (held IS NULL) FROM o
        UNION ALL SELECT 'rows', 'quarantined', count(*) FILTER (held IS NOT NULL) FROM o""",
    "audited_scrub_lines": f"""
        SELECT CASE WHEN held IS NULL THEN 'kept' ELSE 'quarantine' END AS part, coalesce(held, 'kept') AS reason, count(*) AS n, count(*) FILTER (held IS NULL) AS tokens FROM (SELECT {_HELD} AS held FROM orders) GROUP BY 1, 2
        UNION ALL SELECT 'skipped', why, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0), 0 FROM (VALUES ('blank'), ('not_json'), ('no_object')) v(why)""",
    "published_orders": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 2 AS release, 'orders' AS tables FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
}

"""DuckDB SQL over nested documents and stored texts; its patterns are written out here."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CITE, _TERM = "chr(57344)", "chr(57345)"
_CITED = q(r"(?i)\b\d{1,3}\s*C\.?\s*F\.?\s*R\.?\s*§?\s*\d+(?:\.\d+)*(?:\([a-zA-Z0-9]+\))*")
_TERMS = q(r"(?i)\b(?:Social Security Number|Social Security|Safe Harbor|Protected Health Information|Medical Record Number|Date of Birth|Personally Identifiable Information|Privacy Rule|HIPAA)\b")
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_ROADS = "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Ter|Terrace|Cir|Circle|Hwy|Highway|Pkwy|Parkway"
_STEPS = [
    (r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b", "[F]"),
    (r"\b(?:\+?\d{1,3}[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", "[D]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[G]"),
    (r"\b(?:MRN|mrn|Medical\s?Record(?:\s?Number)?|Chart(?:\s?ID)?|Account(?:\s?Number)?|Acct|HP|ACCT|DEV|UID)[\s#:\-]*[A-Z0-9]{4,}[\-A-Z0-9]{0,20}\b", "[H]"),
    (r"\bhttps?://[\w./\-?=&%+#:]{6,200}\b", "[N]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[O]"),
    (rf"\b\d{{1,6}}[a-z]?\s+[A-Z][\w.\- ]{{2,60}}?\s+(?:{_ROADS})(?:\.|,|\b)", "[B]"),
    (rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}-(?:{_MONTHS})-\d{{2,4}}|(?:{_MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}})\b", "[C]"),
    (r"(?i)(?:\baged?\s+(?:of\s+)?)?(?:9\d|1[01]\d|1[2-9]\d)\s*(?:years?|yrs?|y/o|-?year[-\s]?old)\b|\baged?\s+(?:of\s+)?(?:9\d|1[01]\d|1[2-9]\d)\b", "[C-age]"),
    # A name ends before what is no letter in any script; that character is put back.
    (r"\b(?:(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?|[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})([^\pL\pN_]|$)", r"[A]\1"),
]


def _back(text: str, mark: str, kept: str) -> str:
    return f"array_to_string(list_transform(list_zip(string_split({text}, {mark}), {kept}), lambda x: x[1] || coalesce(x[2], '')), '')"


def scrubbed(rows: str, keep: str = "false") -> str:
    """The columns of ``rows``, whose ``v`` is scrubbed unless ``keep``."""
    out = "w"
    for pattern, tag in _STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(tag)}, 'g')"
    one = f"SELECT *, regexp_replace(v, {_CITED}, {_CITE}, 'g') AS m FROM ({rows})"
    two = f"SELECT *, regexp_replace(m, {_TERMS}, {_TERM}, 'g') AS w FROM ({one})"
    three = f"SELECT *, {out} AS r FROM ({two})"
    four = f"SELECT *, {_back('r', _TERM, f'regexp_extract_all(m, {_TERMS})')} AS r2 FROM ({three})"
    return f"SELECT * EXCLUDE (v, m, w, r, r2), CASE WHEN {keep} THEN v ELSE {_back('r2', _CITE, f'regexp_extract_all(v, {_CITED})')} END AS v FROM ({four})"


_LEAVES = """
    SELECT conv_id, 'session_id' AS path, 'session_id' AS key, CAST(conv_id AS VARCHAR) AS v FROM (SELECT DISTINCT conv_id FROM c)
    UNION ALL SELECT conv_id, spot || '.role', 'role', role FROM c
    UNION ALL SELECT conv_id, spot || '.reviewer', 'reviewer', 'r' || n || '@audit.example.org' FROM c
    UNION ALL SELECT conv_id, spot || '.ts', 'ts', '2024-05-20' FROM c
    UNION ALL SELECT conv_id, spot || '.body.text', 'text', text || CASE turn % 3 WHEN 0 THEN ' Call 555-010-' || n || ' under 45 CFR 164.514(b).' WHEN 1 THEN ' Seen by Dr. Jane Roe, aged 93, 12 Oak Hill Road.' ELSE '' END FROM c
    UNION ALL SELECT conv_id, spot || '.body.notes[0]', 'notes', 'Date of Birth 1950-04-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || ', MRN 77' || n FROM c
    UNION ALL SELECT conv_id, spot || '.body.notes[1]', 'notes', 'mail p' || n || '@clinic.example.org or http://portal.example.org/u/' || n FROM c
    UNION ALL SELECT conv_id, spot || '.body.hosts[0][0]', 'hosts', 'host 10.0.0.7' FROM c"""
_CONVERSATIONS = "c AS (SELECT *, lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') AS n, 'turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || ']' AS spot FROM conversations)"

_SCANNED = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("URL", r"(?i)\bhttps?://[^\s/$.?#].[^\s]*\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("SSN_UNHYPHENATED", r"(?:(?i:\bssn|social\s*security(?:\s*number)?))\s*[:#]?\s*\d{9}\b"),
    ("MRN", r"(?i)\bMRN[-:]?\s*\d{6,10}\b"),
    ("MRN_LABELED", r"(?i:medical\s*record\s*(?:number|no\.?|#))\s*[:#]?\s*\d{4,10}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("US_PHONE", r"\(\d{3}\)\s?\d{3}[-.\s]\d{4}\b|\b\d{3}[-.]\d{3}[-.]\d{4}\b"),
    ("AGE_OVER_89", r"\b(?:9\d|1\d{2})\s*(?:years?[\s-]old|y\.?o\.?)\b|(?i:\baged?\s*:?\s*)(?:9\d|1\d{2})\b"),
    ("ADDRESS", r"\b\d{1,5}\s+[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)?\s+(?:St|Ave|Rd|Ln|Dr|Blvd|Way|Ct|Ter|Pl|Street|Avenue|Road|Lane|Drive|Boulevard|Court|Terrace|Place)\b\.?"),
    ("DATE_ISO", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\b"),
    ("DATE_TEXT", rf"\b(?:{_MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b"),
    ("PERSON_NAME_PREFIX", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"),
    ("SUBJECT_SUBJ", r"\bSUBJ[-_]?\d+\b"),
    ("SUBJECT_SC", r"\bSC\d{4,}\b"),
    ("SUBJECT_FID", r"\bFID\d{4,}\b"),
]
_spared = {"DATE_ISO": " AND key <> 'ts' AND conv_id % 7 <> 0", "DATE_TEXT": " AND key <> 'ts'"}

_KEY_PADS = [bytes(b ^ x for b in b"public test key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def _tag(label: str, value: str) -> str:
    return f"'<{label}_' || substr(sha256(unhex('{_KEY_PADS[1]}') || unhex(sha256(unhex('{_KEY_PADS[0]}') || encode({value})))), 1, 8) || '>'"


_LOGGED = [
    ("ANTHROPIC_KEY", r"sk-ant-[A-Za-z]+\d*-[A-Za-z0-9_\-]{20,}"),
    ("OPENAI_KEY", r"sk-(?:proj-)?[A-Za-z0-9]{40,}"),
    ("NVIDIA_KEY", r"nvapi-[A-Za-z0-9_\-]{30,}"),
    ("GOOGLE_KEY", r"AIza[A-Za-z0-9_\-]{35}"),
    *(x for x in _SCANNED if not x[0].startswith("SUBJECT")),
    ("NUMERIC_ID_SHORT", r"\b\d{6,7}\b"),
    ("DATE_MDY", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("PERSON_NAME_GENERIC", r"\b[A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15}\b"),
]
_line = "line"
for _name, _pattern in _LOGGED:
    _line = f"regexp_replace({_line}, {q(_pattern)}, '<{_name}>', 'g')"
_ODD = "CASE event_id % 3 WHEN 0 THEN ' mail u' || event_id || '@example.org on 2024-05-20' WHEN 1 THEN ' key sk-ant-api03-' || sha256(CAST(event_id AS VARCHAR)) ELSE ' from 10.0.0.7 by Dr. Ann Lee' END"
_PHRASES = "(SELECT DISTINCT substr(text, 11, 18) AS literal FROM benchmark WHERE length(substr(text, 11, 18)) >= 4)"

NESTED_SQL: dict[str, str] = {
    "redact_log_lines": f"SELECT event_id, {_line} AS line FROM (SELECT event_id, 'run for ' || {_tag('SUBJ', "'SUBJ-' || user_id")} || ': ' || event_type || {_ODD} AS line FROM events)",
    "redact_literal_documents": f"""
        WITH p AS (SELECT list({{'find': literal, 'put': {_tag('LIT', 'literal')}}}) AS all_of FROM {_PHRASES})
        SELECT doc_id, sha256(list_reduce(list_concat([{{'find': text, 'put': ''}}], all_of), lambda acc, x: {{'find': replace(acc.find, x.find, x.put), 'put': ''}}).find) AS digest FROM documents, p""",
    "prompt_literals": f"SELECT doc_id, left(literal, 2) || repeat('*', length(literal) - 4) || right(literal, 2) AS literal FROM documents JOIN (SELECT DISTINCT lower(literal) AS literal FROM {_PHRASES}) ON contains(lower(text), literal)",
    "sheet_blocks": """
        WITH c AS (SELECT l_orderkey AS sheet, l_linenumber + CAST(l_linenumber > 3 AS INT) AS r, unnest([0, 1, 2, 4]) AS c,
          unnest([l_returnflag, CASE WHEN l_orderkey % 2 = 0 THEN ' ' ELSE l_linestatus END, CASE WHEN l_partkey % 3 > 0 THEN l_linestatus END, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END]) AS value FROM lineitem),
        f AS (SELECT *, r - dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS strip FROM c WHERE trim(value) <> ''),
        g AS (SELECT *, c - dense_rank() OVER (PARTITION BY sheet, strip ORDER BY c) AS part FROM f),
        h AS (SELECT *, min(c) OVER (PARTITION BY sheet, strip, part) AS first FROM g),
        i AS (SELECT *, dense_rank() OVER (PARTITION BY sheet ORDER BY strip, first) AS no FROM h)
        SELECT sheet, CAST(no AS INTEGER) AS "table", CAST(dense_rank() OVER (PARTITION BY sheet, no ORDER BY r) AS INTEGER) AS "row", c - first AS "column", value FROM i""",
    "scrub_nested_conversations": f"WITH {_CONVERSATIONS}, l AS ({_LEAVES}) SELECT conv_id, path, key, v AS text FROM ({scrubbed('SELECT * FROM l', keep="key IN ('session_id', 'reviewer', 'ts')")})",
    "tree_scan_json": f"WITH {_CONVERSATIONS}, l AS MATERIALIZED ({_LEAVES}) " + " UNION ALL ".join(f"SELECT conv_id, path, key AS \"column\", {q(name)} AS pattern FROM l WHERE regexp_matches(v, {q(p)}){_spared.get(name, '')}" for name, p in _SCANNED),
    "canonical_props": """SELECT event_id, '{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '","z":[1,{"a":null,"b":"x"}]}' AS doc FROM events""",
    "scrub_persisted_documents": f"SELECT doc_id, sha256(v) AS digest FROM ({scrubbed("SELECT doc_id, 'Per 45 CFR §164.514(b)(2)(i), Safe Harbor; seen 20-May-2024 by Ann Lee: ' || text AS v FROM documents")})",
    "redact_dictionary_part": f"SELECT code, help, v AS note FROM ({scrubbed(f"SELECT code, note AS v, help FROM (SELECT code, note, v AS help FROM ({scrubbed("SELECT CAST(p_partkey AS VARCHAR) AS code, 'ask Mr. Jo Poe, MRN ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS v, p_brand || ' HIPAA 1/2/' || (p_partkey % 90 + 10) AS note FROM part")}))")})",
}

"""DuckDB SQL of the whole export guard over documents. Its patterns are written out here, without the look-around that RE2 lacks:
what may not stand beside a match is matched beside it, and a needed digit is asked for on its own."""

from __future__ import annotations


def _has(pattern: str, cell: str = "text") -> str:
    return f"regexp_matches({cell}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _labelled(labels: str) -> str:
    """A label before a code of four to twenty capitals, digits and dashes with a digit in it."""
    return _has(rf"\b(?i:{labels})[\s#:\-]*[A-Z0-9][A-Z0-9\-]{{3,19}}\b") + " AND " + _has(rf"\b(?i:{labels})[\s#:\-]*[A-Z0-9\-]*\d")


_BARE = r"regexp_extract(text, '\b\d{10}\b')"
_LUHN = f"(SELECT sum(CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 FROM (SELECT i, CAST(substr(reverse('80840' || {_BARE}), i + 1, 1) AS INT) AS d FROM range(15) r(i)))"

_CONDITIONS = {
    "SSN": _has(r"\b\d{3}-\d{2}-\d{4}\b"),
    "PHONE_US": _has(r"\b(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"),
    "EMAIL": _has(r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b"),
    "DATE_FULL_ISO": _has(r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    "DATE_FULL_US": _has(r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b"),
    "RESTRICTED_ZIP3": _has(r"\b(?:036|059|063|102|203|556|692|790|821|823|830|831|878|879|884|890|893)\d{2}\b"),
    "AGE_OVER_89": _has(r"\b9[0-9](?:[^\w+\-]|$)") + " AND " + _has(r"(?i)\b(?:age[sd]?|y/?o|yrs?|years?\s+old|elderly)\b"),
    "URL": _has(r"""(?i)\bhttps?://[^\s,"']{3,}"""),
    "IPV4": _has(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    "IPV6": _has(r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    "LICENSE_PLATE": _has(r"\b[A-Z]{2,3}[- ]?\d{3,4}\b") + " AND " + _has(r"(?i)\b(?:plate|license|licence|tag|vehicle)\b"),
    "IMEI": _has(r"(?:^|\D)\d{15}(?:\D|$)") + " AND " + _has(r"(?i)\b(?:imei|device[_ ]?id|handset)\b"),
    "DEVICE_SERIAL": _has(r"\b[Ss][Nn][:\- ]*[A-Z0-9\-]{6,}\b"),
    "IMAGE_REF": _has(r"(?i)\b[A-Za-z0-9_\-/.]+\.(?:jpe?g|png|bmp|tiff|heic|heif)\b"),
    "BIOMETRIC_HASH": _has(r"(?i)\b(?:fingerprint|iris|biometric|voice[_ ]?print)[:=\s]*[A-Fa-f0-9]{16,}\b"),
    "DNA_PROFILE": _has(r"(?i)\b(?:dna|str)[_ ]?(?:profile|locus)[:=\s]*[A-Z0-9\-]{8,}\b"),
    "NPI": _has(r"\bNPI[:\- ]*\d{10}\b"),
    "DEA": _has(r"\bDEA[:\- ]*[A-Z]{2}\d{7}\b"),
    "FAX_LABEL": _has(r"(?i)\bfax[:\s]+\(?\d{3}\)?[\s\-]?\d{3}-\d{4}\b"),
    "MRN": _labelled(r"MRN|MEDICAL\s?RECORD(?:\s?NUMBER)?|CHART\s?ID"),
    "HEALTH_PLAN_ID": _labelled(r"HP|MEMBER\s?ID|HEALTH\s?PLAN(?:\s?(?:ID|NUMBER))?|SUBSCRIBER\s?ID"),
    "MBI": _has(r"\b[1-9][ACDEFGHJKMNPQRTUVWXY][ACDEFGHJKMNPQRTUVWXY0-9]\d[ACDEFGHJKMNPQRTUVWXY][ACDEFGHJKMNPQRTUVWXY0-9]\d[ACDEFGHJKMNPQRTUVWXY][ACDEFGHJKMNPQRTUVWXY]\d{2}\b"),
    "ACCOUNT": _labelled(r"ACCOUNT(?:\s?NUMBER)?|ACCT"),
    "NPI_BARE": _has(r"\b\d{10}\b") + f" AND {_LUHN} AND " + _has(r"(?i)\b(?:npi|provider|clinician|physician)\b"),
    "VIN": _has(r"\b[A-HJ-NPR-Z0-9]{17}\b") + " AND " + _has(r"(?i)\b(?:vin|vehicle)\b"),
    "DEVICE_UDI": _has(r"\(01\)\d{14}\b"),
    "UNIQUE_CODE": _labelled(r"UID|TRACKING\s?CODE|LINKAGE\s?ID"),
    "CLINICAL_TRIAL_ID": _has(r"\bNCT\d{8}\b"),
}
_FOUND = " UNION ALL ".join(f"SELECT source, '{pid}' AS pid FROM noted WHERE {test}" for pid, test in _CONDITIONS.items())
#: A label and a code are added to every seventh document, of a kind by its number.
_NOTED = """noted AS (SELECT source, CASE WHEN doc_id % 7 <> 0 THEN text ELSE text || CASE doc_id % 5 WHEN 0 THEN ' MRN: AB-4471' WHEN 1 THEN ' acct 99X71' || ' member id ZZ12' WHEN 2 THEN ' aged 93, tag QX 4711'
    WHEN 3 THEN ' imei 490154203237518 uid K-7781' ELSE ' provider 1234567893 vin 1HGCM82633A004352' END END AS text FROM documents)"""

GUARD_SQL: dict[str, str] = {
    "guard_all_patterns": f"WITH {_NOTED} SELECT source, pid, count(*) AS texts FROM ({_FOUND}) GROUP BY 1, 2",
    "guard_report": f"""WITH {_NOTED}, c AS (SELECT source, count(*) AS n FROM ({_FOUND}) GROUP BY 1)
        SELECT d.source AS file, CASE WHEN n > 0 THEN 'blocked' ELSE 'clean' END AS status, coalesce(n, 0) AS findings FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN c ON d.source = c.source""",
}

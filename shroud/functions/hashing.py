"""Keyed digests as plain Column expressions, so they run inside generated code.

The key's pads are literals of the plan and show in ``explain`` and event logs; use these with keys
that may be seen there, and ``keyed_digest_udf`` with those that may not.
"""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX, LETTERS = "0123456789abcdef", "abcdefghijklmnop"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of the message's UTF-8 bytes; null for null."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def hmac_sha256_sql(key: bytes, message: str) -> str:
    """The same digest as DuckDB SQL over a text expression."""
    inner, outer = _pads(key)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({message}))))"


def keyed_digest_udf(key_variable: str = "SHROUD_KEY"):
    """HMAC-SHA256 whose key the executors read from their environment; it is in no plan."""

    @F.pandas_udf("string")
    def digest(message: pd.Series) -> pd.Series:
        key = os.environ[key_variable].encode()
        return message.map(lambda m: hmac.new(key, m.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return digest


def column_digest(salt: bytes, column: str, value: Column) -> Column:
    """16 hex digits that differ by column."""
    return F.substring(hmac_sha256(salt, F.concat(F.lit(f"{column}:"), value)), 1, 16)


def pseudonym(salt: str, value: Column) -> Column:
    """``P`` and 8 hex digits, the same in every column of a study."""
    return F.concat(F.lit("P"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, 8))


def record_token(key: bytes, label: str, value: Column) -> Column:
    """``RID_<label>_`` and 12 letters from a to p."""
    digest = F.substring(hmac_sha256(key, F.concat(F.lit(f"{label}:"), value)), 1, 12)
    return F.concat(F.lit(f"RID_{label}_"), F.translate(digest, HEX, LETTERS))


def offset_days(key: bytes, subject: Column, most: int) -> Column:
    """A subject's fixed shift, from ``-most`` to ``most`` days."""
    first = F.conv(F.substring(hmac_sha256(key, subject), 1, 8), 16, 10).cast("bigint")
    return (first % (2 * most + 1) - most).cast("int")


def header_id(artifact: Column, sha: Column, index: Column) -> Column:
    return F.concat(F.lit("h_"), F.substring(F.sha2(F.concat_ws("\0", artifact, sha, index.cast("string")), 256), 1, 24))

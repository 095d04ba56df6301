from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} w{i * 7919 % 10007}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows and columns with names that operators use."""
    mail = "reach me at jo.doe@mail.example.com or +44 20 7946 0958"
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", "en", "a", 4),
        (3, LONG, "en", "a", len(LONG)),
        (4, mail, "en", "b", len(mail)),
        (4, mail, "en", "b", len(mail)),
        (None, "no id here", "en", "b", 10),
        (5, "token = 'abcdefgh12345678' é ü 中文 😀", "xx", "c", 30),
        (6, "One", "en", "c", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = ("id", "row", "fp", "blob", "stats", "label", "train", "doc", "item", "part", "cands", "component_id", "count", "ids", "curve", "n_tokens", "_id")
    return df.withColumns({c: F.lit(7) for c in clashing})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

from __future__ import annotations

import pytest

#: Rows that every operator on documents must take: nulls in any column, empty
#: and blank texts, repeated rows, ties, and one very long text.
ODD = [
    (1, "the quick brown fox", "en", "a", 19),
    (1, "the quick brown fox", "en", "a", 19),
    (2, None, None, None, None),
    (None, "the quick brown fox", "en", None, 19),
    (None, None, None, "b", None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "x" * 120_000, None, "c", 120_000),
    (7, "é\u0000\U0001f600   ß", "fr", "é", 7),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for results of their own.
CLASHING = (
    "size long, score double, kept boolean, hash string, key long, fp long, n long, _key string, _row long, "
    "sources_ string, spans string, target double, part int, row_key long, m long, copies int"
)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash."""
    extra = (None,) * len(CLASHING.split(", "))
    return spark.createDataFrame([(*r, *extra) for r in ODD], f"{COLUMNS}, {CLASHING}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)

"""Faults that were found once: odd digits, templates of numbers alone, clashing names, caches."""

from __future__ import annotations

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from listinglens.llm import base, decontamination, exact, mixing, pii, simhash


@pytest.mark.parametrize("text", ["See notes ¹ ² ³ and 4.", "1 ① 2 ③ items", "area 10 20 30 ²"])
def test_digits_that_are_no_numbers(text):
    for window in pii.make_windows(text, []):
        pii.SemiMarkovField().decode(window)


def test_every_digit_of_unicode():
    digits = [chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c)) in ("Nd", "No", "Nl")]
    text = " ".join(f"1 {d} 22 {d}{d} 333 {d} 4444" for d in digits[::7])
    for window in pii.make_windows(text[:4000], []):
        pii.SemiMarkovField().decode(window)


def test_numbers_alone_are_no_template():
    item = " ".join(str(i) for i in range(1, 31))
    other = " ".join(str(i * 37 % 1009 + 100) for i in range(60))
    assert decontamination.align(item, other) is None
    assert decontamination.align(item, f"{other} {item} {other}")[1] == "verbatim"
    worded = "how many apples does 5 people with 3 baskets carry home from the market"
    changed = "how many apples does 8 people with 4 baskets carry home from the market"
    assert decontamination.align(worded, changed)[1] == "reparameterised"


def test_helper_columns_give_way(spark):
    rows = [(1, "one two three four", "a"), (2, "one two three four", "a"), (3, "other words are here now", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = docs.withColumns({c: F.lit(c) for c in ("_n", "_keep", "_copies", "_row", "_use", "_leak", "sources")})
    bench = spark.createDataFrame([(1, "other words are here now")], "item_id long, text string")
    for operator in (
        simhash.drop_near_duplicates,
        exact.drop_exact_duplicates,
        mixing.take_mix,
        lambda d: decontamination.drop_leaks(d, bench),
    ):
        got, want = operator(named), operator(docs)
        assert got.columns == named.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())
        assert {r["_n"] for r in got.collect()} == {"_n"}


def test_a_worker_lets_go_of_other_operators_caches(monkeypatch):
    dropped = []
    monkeypatch.setattr(base, "KEPT", {"one": lambda: dropped.append("one"), "two": lambda: dropped.append("two")})
    base.let_go("one")
    assert dropped == ["two"]

"""Vectors of the scalar functions, run through DataFrames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import numbers, text
from folioforge.functions.similarity import common_subsequence, similarity, token_set_ratio

AMOUNTS = [("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("DKK 1234.5", "1234.50"), ("8.750,00", "8750.00"), ("4,200", "4200.00"), ("(1,234.56)", "-1234.56"), ("-85", "-85.00"), ("100,00 kr.", "10000.00"), ("12.450,00 kr.", None), ("kr. 100,00", "100.00"), ("1.234", "1234.00"), ("1,234,567", "1234567.00"), ("1.234.56", "1234.56"), ("1 234,56", None), ("", None), ("  ", None), (None, None), ("abc", None), ("1'234.50", "1234.50"), ("€ 12,5", "12.50"), ("-(12)", None), ("-0,00", "-0.00"), ("Moms 25%", "25.00")]
DATES = [("2026-04-07", "2026-04-07"), ("05/04/2026", "2026-04-05"), ("14-04-2026", "2026-04-14"), ("14.04.2026", "2026-04-14"), ("2026-04-99", None), ("2026-02-30", None), ("1 2 2026", "2026-02-01"), ("2026/1/2", "2026-01-02"), ("01.02.26", None), ("1-2/2026", None), (" 2026-01-02 ", "2026-01-02"), ("", None), (None, None)]
CURRENCIES = [("dkk", "DKK"), ("€", "EUR"), ("Gesamt €", "EUR"), ("kr.", "DKK"), ("GBP", None), ("", None), (None, None), ("US$", "USD"), ("EUR 5 kr", "DKK"), ("5 kroner", None), ("total usd", "USD")]
QUANTITIES = [("2.00", "2"), ("1,5", "1.5"), ("100", "100"), ("10 pcs", "10"), (None, None), ("x", None), ("1.250", "1250")]
DISCOUNTS = [("2%", "2.00%"), ("DKK 50", "50.00"), (None, None), ("x%", None)]


def through(spark, function, values):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string").select("n", function(F.col("v")).alias("out")).orderBy("n").collect()
    return [r.out for r in rows]


@pytest.mark.parametrize(("function", "vectors"), [(numbers.amount, AMOUNTS), (numbers.iso_date, DATES), (numbers.currency, CURRENCIES), (numbers.quantity, QUANTITIES), (numbers.discount, DISCOUNTS)])
def test_numbers(spark, function, vectors):
    assert through(spark, function, [v for v, _ in vectors]) == [out for _, out in vectors]


def test_default_currency(spark):
    assert through(spark, lambda v: numbers.currency(v, "DKK"), ["", None, "GBP"]) == ["DKK", "DKK", None]
    assert through(spark, lambda v: numbers.currency(v, "GBP"), [""]) == [None]


def test_text(spark):
    assert through(spark, text.match_text, ["København Logistik ApS", "MÜNCHEN HARDWARE", "A/S", "Straße é ﬁ", "Ａ１", None]) == ["KOBENHAVN LOGISTIK APS", "MUENCHEN HARDWARE", "A S", "STRASSE E FI", "A1", None]
    assert through(spark, text.identifier, [" inv–2026 — 1", "re_1", ""]) == ["INV-2026-1", "RE1", ""]
    assert through(spark, text.name, ["Nordic  Steel A/S!", " ", None]) == ["nordic steel a/s", None, None]
    assert through(spark, text.code, [" ab ", "  ", None]) == ["AB", None, None]
    assert through(spark, text.is_missing, [None, "", "  \t", "x"]) == [True, True, True, False]


RATIOS = [("BERLINER MASCHINENBAU GMBH", "BERLINER MASCHINENBAU", 100), ("KOBENHAVN LOGISTIK APS", "KBH LOGISTIK", 80), ("SKANDINAVISK EL VVS", "SKAN EL VVS A S", 64.7059), ("BERLINER MASCHINENBAU GMBH", "BERLINER MASCH", 72.7273), ("GLOBAL OFFICE SUPPLIES LTD", "GLOBAL OFFICE SUPP", 83.871), ("HAMBURG VERPACKUNG", "HAMBURG VERPACKG", 94.1176), ("nordic steel a/s", "nordic steel as", 96.774), ("steel beams", "steel beam", 95.238), ("", "X", 0), ("AB", "YZ", 0)]


def test_similarity(spark):
    rows = spark.createDataFrame([(a, b, float(r)) for a, b, r in RATIOS] + [(None, "A", None)], "a string, b string, r double").select(similarity("a", "b").alias("got"), "r").collect()
    assert all((x.got is None and x.r is None) or abs(x.got - x.r) < 0.001 for x in rows)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    assert common_subsequence(a, b) == row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=12), st.text("ab ", max_size=12))
def test_ratio_is_symmetric(a, b):
    assert abs(token_set_ratio(a, b) - token_set_ratio(b, a)) < 1e-9 and 0 <= token_set_ratio(a, b) <= 100


def test_normalising_twice_changes_nothing(spark):
    for function, vectors in ((numbers.iso_date, DATES), (numbers.currency, CURRENCIES)):
        once = [x for x in through(spark, function, [v for v, _ in vectors]) if x is not None]
        assert through(spark, function, once) == once

"""Column transforms, on inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import pvalues as P
from tarnwell.functions import values as V

NONE = None


def run(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_coerce_numeric(spark):
    got = run(spark, ["$1,234", "€2,000", "15%", "(3.5)", "12k", "2 million", "1mm", "−42", "-1_234", "  +5  ", None, "", "abc", "7 thousand", "10 pct", "25 PERCENT"], V.coerce_numeric)
    want = [1234, 2000, 0.15, -3.5, 12000, 2e6, 1e6, -42, -1234, 5, None, None, None, 7000, 0.10, 0.25]
    assert [x if x is None else pytest.approx(x) for x in want] == got


def test_coerce_robust_and_clip(spark):
    got = run(spark, ["-5", "10", "$1,234.50", "(100)", "−20", None], lambda c: V.clip(V.coerce_robust(c), 0, 100))
    assert got == [0, 10, 100, 0, 0, None]
    got = run(spark, ["12.5 %", "(10%)", "1.2e3", "foo -3.4E-1 bar", " ( 2.5e2 ) "], V.coerce_robust)
    assert got == pytest.approx([0.125, -0.10, 1200, -0.34, -250])


@pytest.mark.parametrize(("sign", "want"), [("positive", [NONE, NONE, 4, 5, NONE, NONE]), ("nonnegative", [0, 0, 4, 5, 0, NONE]), ("negative", [-3, NONE, NONE, NONE, -2, NONE])])
def test_enforce_sign(spark, sign, want):
    assert run(spark, ["-3", "0", "4", "(5)", "−2", None], lambda c: V.enforce_sign(c, sign)) == want


def test_zero_as_missing(spark):
    assert run(spark, [0.0, 0.0001, 1e-6, -0.00004, 0.1], lambda c: V.zero_as_missing(c, 5e-5), "double") == [None, 0.0001, None, None, 0.1]


def test_text_and_null_tokens(spark):
    assert run(spark, ["  Hello world  ", "“q” — café", "", None], V.text_normalize) == ["Hello world", '"q" - café', None, None]
    assert run(spark, ["  Foo   BAR  "], lambda c: V.text_normalize(c, lower=True)) == ["foo bar"]
    assert run(spark, ["", "—", "n/a", "NaN", "NULL", " value ", "Missing"], lambda c: V.null_tokens(c, ("missing",))) == [None] * 5 + ["value", None]


def test_coerce_bool(spark):
    assert run(spark, [" yes ", "No", "t", "F", " TRUE!! ", "(false)", None, "", "1", "0", "2", "-1", "0.0", "3.14", "nope"], V.coerce_bool) == [True, False, True, False, True, False, None, None, True, False, None, None, False, None, None]
    assert run(spark, [2, -3, 0], lambda c: V.coerce_bool(c, truthy=True), "int") == [True, True, False]
    assert run(spark, ["maybe"], lambda c: V.coerce_bool(c, ("maybe",), ("maybe",))) == [None]


def test_regex_replace(spark):
    assert run(spark, ["foo", "ooo", "xyz", None], lambda c: V.regex_replace(c, "o", "X", count=1)) == ["fXo", "oXo", "xyz", None]
    assert run(spark, ["A-12-345"], lambda c: V.regex_replace(c, r"(?P<a>[A-Z])-(\d+)-(?P<z>\d+)", r"\g<a>:\2|\g<z>")) == ["A:12|345"]
    assert run(spark, ["a.b.c"], lambda c: V.regex_replace(c, ".", "-", literal=True)) == ["a-b-c"]
    assert run(spark, ["aXbY"], lambda c: V.regex_replace(c, ["x", "y"], "_", flags="I")) == ["a_b_"]


def test_ids(spark):
    assert run(spark, ["A-1B2C3", "x"], V.extract_digits) == ["123", None]
    assert run(spark, ["  +12.34% ", "-9,001"], lambda c: V.extract_digits(c, keep_sign=True, keep_decimal=True)) == ["+12.34", "-9001"]
    assert run(spark, ["٣x4"], lambda c: V.extract_digits(c)) == ["٣4"] and run(spark, ["٣x4"], lambda c: V.extract_digits(c, ascii_only=True)) == ["4"]
    assert run(spark, ["7", "  42 ", "123456"], lambda c: V.zero_pad(c, 5)) == ["00007", "00042", "123456"]
    assert run(spark, ["-7", "0"], lambda c: V.zero_pad(c, 4, "X")) == ["XX-7", "XXX0"]
    assert run(spark, [" INV-007 ", "A12B", "++-3"], lambda c: V.zero_pad(c, 4, numeric_only=True)) == ["-0007", "0012", "-0003"]
    assert run(spark, ["A-1_2.3 /B", "###", "Åland 123"], V.keep_alnum) == ["A123B", "", "Åland123"]
    assert run(spark, ["a--b__c"], lambda c: V.keep_alnum(c, "-_", case="upper")) == ["A-B_C"]


def test_dates(spark):
    got = run(spark, ["on 2024-01-02T03:04:05Z ok", "2024/1/2", "1/2/2024", "Jan 2, 2024", "2 January 2024", "20240102", "99999999", "none"], V.extract_datetime)
    assert got == ["2024-01-02T03:04:05Z", "2024/1/2", "1/2/2024", "Jan 2, 2024", "2 January 2024", "2024-01-02", None, None]
    day = dt.datetime(2021, 1, 1)
    assert run(spark, ["2021-01-01", "1609459200", "1609459200000", "1609459200000000", "1609459200000000000", "seen 2021-01-01 there", "bad"], V.parse_robust) == [day] * 6 + [None]
    assert run(spark, ["02/03/2024"], lambda c: V.parse_robust(c, dayfirst=True)) == [dt.datetime(2024, 3, 2)]
    assert run(spark, ["2024-01-02", "01/03/2024", "bad"], V.parse_datetime) == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), None]
    noon = ["2024-01-01 12:00:00", "2024-01-02 12:00:00"]
    assert run(spark, noon, lambda c: V.dt_step(c.cast("timestamp_ntz"), "D")) == [dt.datetime(2024, 1, 2)] * 2
    assert run(spark, noon[:1], lambda c: V.dt_step(c.cast("timestamp_ntz"), "bogus")) == [dt.datetime(2024, 1, 1, 12)]
    assert run(spark, ["2024-12-30 13:14:15"], lambda c: V.dt_part(c.cast("timestamp_ntz"), "iso_year")) == [2025]


def test_categories(spark):
    usa = {"us": "USA", "u.s.": "USA", "usa": "USA", "united states": "USA"}
    assert run(spark, [" us ", "U.S.", "USA", "United States", "x"], lambda c: V.map_synonyms(c, usa)) == ["USA"] * 4 + ["x"]
    assert run(spark, ["McDonldas", "mcdonalds ", "burger"], lambda c: V.nearest(c, ["McDonalds"])) == ["McDonalds", "McDonalds", "burger"]
    assert run(spark, ["Shop 12", "none"], lambda c: V.extract_key(c, [r"shop (\d+)"], 1, "Unknown")) == ["12", "Unknown"]


def test_p_values():
    assert P.z_two_tailed(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and P.chi2_sf(50, 10) == pytest.approx(2.669083e-07, rel=1e-4)
    assert P.t_two_tailed(2.085963, 20) == pytest.approx(0.05, abs=1e-6)
    assert P.f_sf(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert P.pearson_p(0.5, 2) == 1 and P.pearson_p(1, 9) == 0 and P.f_sf(float("inf"), 1, 2) == 0 and P.chi2_sf(float("nan"), 1) == 1
    for a, b, x in ((2, 3, 0.4), (0.5, 0.5, 0.1), (10, 1, 0.9)):
        assert P.reg_incomplete_beta(a, b, x) == pytest.approx(1 - P.reg_incomplete_beta(b, a, 1 - x))
    assert P.reg_incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)

"""Percent and dollar texts (X6-X8), with strings as they appear in the published outputs."""

import pytest
from pyspark.sql import functions as F

from wagelens.functions.text import dollar_text, percent_text, with_dollar_texts


def _pct(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r.t for r in df.orderBy("i").select(percent_text(F.col("x")).alias("t")).collect()]


def test_percent_texts(spark):
    assert _pct(spark, [0.018, -0.045, 0.0, None, 0.025]) == ["1.8%", "-4.5%", "0.0%", None, "2.5%"]


def test_percent_small_negative_has_no_sign(spark):
    # Men paid $97,064 and women $97,090 print as 0.0%, not -0.0%.
    gap = (97064 - 97090) / (97064 + 97090)
    assert _pct(spark, [gap, -0.000134]) == ["0.0%", "0.0%"]


def _dollars(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "fiscal_year int, i int, x double")
    out = with_dollar_texts(df, ["x"], by=["fiscal_year"])
    return [r.x for r in out.orderBy("i").collect()]


def test_dollar_column_below_limit_has_cents(spark):
    assert _dollars(spark, [4212.81, 429.74, -0.0003, 0.0, None]) == ["$4,212.81", "$429.74", "-$0.00", "$0.00", None]


def test_dollar_column_above_limit_has_no_cents(spark):
    assert _dollars(spark, [20090898.4, -78.2, 0.0, 1468722295.0]) == ["$20,090,898", "-$78", "$0", "$1,468,722,295"]


def test_dollar_whole_numbers_have_no_cents(spark):
    assert _dollars(spark, [15.0, 170.0, 0.0]) == ["$15", "$170", "$0"]


def test_dollar_limit_is_inclusive(spark):
    assert _dollars(spark, [100000.0, 0.5]) == ["$100,000.00", "$0.50"]
    assert _dollars(spark, [100000.01, 0.5]) == ["$100,000", "$0"]


def test_dollar_all_null_column(spark):
    assert _dollars(spark, [None, None]) == [None, None]


def test_cents_chosen_per_group(spark):
    df = spark.createDataFrame(
        [(2019, "a", 5.25), (2019, "b", 200000.0), (2020, "a", 5.25), (2020, "b", 7.0)],
        "fiscal_year int, k string, x double",
    )
    got = {(r.fiscal_year, r.k): r.x for r in with_dollar_texts(df, ["x"], by=["fiscal_year"]).collect()}
    assert got == {(2019, "a"): "$5", (2019, "b"): "$200,000", (2020, "a"): "$5.25", (2020, "b"): "$7.00"}


@pytest.mark.parametrize("value,cents,text", [(1234.5, True, "$1,234.50"), (-1234.5, False, "-$1,234"), (0.125, True, "$0.12")])
def test_dollar_text_expression(spark, value, cents, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(dollar_text(F.col("x"), F.lit(cents)).alias("t")).first().t == text


# -- property: Spark texts equal a plain-Python rendering of the same rules --------------------

from decimal import ROUND_HALF_EVEN, Decimal  # noqa: E402

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _py_dollar(x, cents):
    if x is None:
        return None
    body = format(abs(x), ",.2f" if cents else ",.0f")
    return ("-$" if x < 0 else "$") + body


def _py_percent(x):
    if x is None:
        return None
    # Half-to-even on the shortest decimal form of x*100, then a positive zero.
    v = float(Decimal(repr(x * 100.0)).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN)) + 0.0
    return format(v, ",.1f") + "%"


amounts = st.one_of(st.none(), st.floats(min_value=-5e9, max_value=5e9, allow_nan=False), st.integers(-10**6, 10**6).map(lambda c: c / 100))
ratios = st.one_of(st.none(), st.floats(min_value=-1, max_value=1, allow_nan=False), st.integers(-2000, 2000).map(lambda c: c / 2000))


@settings(max_examples=15, deadline=None)
@given(st.lists(amounts, min_size=1, max_size=60), st.booleans())
def test_dollar_text_matches_python(spark, values, cents):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.t for r in df.orderBy("i").select(dollar_text(F.col("x"), F.lit(cents)).alias("t")).collect()]
    assert got == [_py_dollar(v, cents) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(ratios, min_size=1, max_size=60))
def test_percent_text_matches_python(spark, values):
    assert _pct(spark, values) == [_py_percent(v) for v in values]

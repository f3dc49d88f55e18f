"""The test-table adapter reproduces the mapping facts recorded in FIXTURES.md §3."""

import pytest
from pyspark.sql import functions as F

from helpers import SF0001, SF001
from wagelens.operators.filters import eligible, group_size_having
from wagelens.operators.names import UNMATCHED_DROP, attach_weights, name_weights
from wagelens.sources import star

YEARS = list(range(1995, 2002))


@pytest.mark.parametrize("sf,rows,matched", [(SF0001, 6000, 5399), (SF001, 60000, 47904)])
def test_payroll_rows_and_matches(spark, sf, rows, matched):
    payroll = star.payroll(spark, sf)
    assert payroll.count() == rows
    assert attach_weights(payroll, name_weights(star.names(spark, sf)), UNMATCHED_DROP).count() == matched


def test_names_at_smallest_scale(spark):
    w = name_weights(star.names(spark, SF0001))
    assert w.count() == 25
    assert w.where(F.col("F") == 0).count() == 2
    assert w.where(F.col("M") == 0).count() == 0


def test_agency_groups_over_threshold_at_sf001(spark):
    rows = eligible(star.payroll(spark, SF001, YEARS), YEARS)
    matched = attach_weights(rows, name_weights(star.names(spark, SF001)), UNMATCHED_DROP)
    assert group_size_having(matched, ["fiscal_year", "agency"], 200).count() == 12
    assert group_size_having(rows, ["fiscal_year", "agency"], 200).count() == 40


def test_price_index_months(spark):
    idx = star.cpi(spark, SF001)
    assert idx.where(F.col("month") == 6).select("year").distinct().count() == 7
    assert sorted(r.year for r in idx.where(F.col("month") == 11).select("year").collect()) == list(range(1995, 2001))

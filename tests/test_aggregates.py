"""NULL rules, weighted means, threshold and citywide row, cube paths."""

import pytest
from pyspark.sql import functions as F

from helpers import by, names, payroll
from wagelens.operators.aggregates import CUBE_MEASURES, group_mean, group_sum, measure_cube, rollup, weighted_mean
from wagelens.operators.filters import eligible, group_size_having, group_size_keep_rows
from wagelens.operators.names import UNMATCHED_DROP, UNMATCHED_ZERO, attach_weights, name_weights
from wagelens.plans.reports import measures

LABEL = "ALL"


@pytest.fixture
def reg(spark):
    return names(spark, [("S", "F", 0, "ANN", 1), ("S", "M", 0, "BOB", 1), ("S", "F", 0, "KIM", 1), ("S", "M", 0, "KIM", 1)])


def test_mean_and_sum_are_null_if_any_amount_missing(spark):
    df = payroll(spark, [(2020, "A", "T", "ANN", 10, 1), (2020, "A", "T", "ANN", None, None), (2020, "B", "T", "ANN", 30, 2.5)])
    m = by(group_mean(df, ["agency"], "base_salary", "avg"), "agency")
    s = by(group_sum(df, ["agency"], "total_ot_paid", "tot"), "agency")
    assert m["A"]["avg"] is None and m["B"]["avg"] == 30.0
    assert s["A"]["tot"] is None and s["B"]["tot"] == 2.5


def test_fractions_of_a_cent_count_and_nan_is_missing(spark):
    df = payroll(spark, [(2020, "A", "T", "ANN", 0.004, 0.004)] * 1000 + [(2020, "B", "T", "ANN", float("nan"), float("nan"))])
    s = by(group_sum(df, ["agency"], "base_salary", "tot"), "agency")
    m = by(group_mean(df, ["agency"], "total_ot_paid", "avg"), "agency")
    assert s["A"]["tot"] == 4.0 and m["A"]["avg"] == 0.004
    assert s["B"]["tot"] is None and m["B"]["avg"] is None


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_cube_keeps_fractions_of_a_cent_and_counts_nan_as_missing(spark, reg, max_rows):
    rows = [(2020, "A", "T", "ANN", 0.004, 0.004)] * 1000 + [(2020, "B", "T", "ANN", float("nan"), 1.0)]
    got = by(measures(rollup(_cube(spark, reg, rows, max_rows=max_rows), "agency", city_label=LABEL), "gender"), "key")
    assert got["A"]["Average"] == 0.004 and got["A"]["Female"] == pytest.approx(0.004)
    assert got["B"]["Average"] is None and got["B"]["Female"] is None


def test_weighted_mean_ignores_missing_amount_with_zero_weight(spark, reg):
    df = payroll(spark, [(2020, "A", "T", "ANN", 10, 0), (2020, "A", "T", "BOB", None, 0), (2020, "A", "T", "KIM", 30, 0)])
    rows = attach_weights(df, name_weights(reg), UNMATCHED_DROP)
    female = by(weighted_mean(rows, ["agency"], "base_salary", "Female", "f"), "agency")["A"]["f"]
    male = by(weighted_mean(rows, ["agency"], "base_salary", "Male", "m"), "agency")["A"]["m"]
    # Female weights: ANN 1, BOB 0, KIM 0.5 -> (10 + 15) / 1.5; BOB's missing salary has weight 0.
    assert female == pytest.approx(25 / 1.5)
    # Male weights: BOB 1 carries a missing salary -> NULL.
    assert male is None


def _cube(spark, reg, rows, unmatched=UNMATCHED_DROP, max_rows=1_000_000):
    return measure_cube(payroll(spark, rows), name_weights(reg), unmatched, max_broadcast_rows=max_rows)


def test_zero_weight_sum_gives_null(spark, reg):
    # Second profile: an agency with unmatched names only has no weight at all.
    cube = _cube(spark, reg, [(2020, "A", "T", "NOBODY", 10, 0), (2020, "B", "T", "ANN", 20, 0)], UNMATCHED_ZERO)
    got = by(measures(rollup(cube, "agency", city_label=LABEL), "gender"), "key")
    assert got["A"]["Average"] == 10.0 and got["A"]["Male"] is None and got["A"]["Female"] is None
    names_m = by(measures(rollup(cube, "agency", city_label=LABEL), "names"), "key")
    assert names_m["A"]["Common"] is None and names_m["A"]["Uncommon"] == 10.0
    assert names_m["B"]["Uncommon"] is None and names_m["B"]["Common"] == 20.0


def test_threshold_is_strict_and_citywide_scope(spark, reg):
    rows = [(2020, "BIG", "T", "ANN", 1, 1)] * 201 + [(2020, "EDGE", "T", "ANN", 3, 1)] * 200
    cube = _cube(spark, reg, rows)
    kept_all = by(rollup(cube, "agency", 200, "all", LABEL), "key")
    assert set(kept_all) == {"BIG", LABEL}
    assert kept_all[LABEL]["n"] == 401
    kept_only = by(rollup(cube, "agency", 200, "kept", LABEL), "key")
    assert kept_only[LABEL]["n"] == 201


def test_keys_are_raw_and_null_key_is_not_citywide(spark, reg):
    rows = [(2020, "Police Department", "T", "ANN", 1, 0), (2020, "POLICE DEPARTMENT", "T", "ANN", 2, 0), (2020, None, "T", "ANN", 4, 0)]
    got = rollup(_cube(spark, reg, rows), "agency", city_label=None).collect()
    assert len(got) == 4
    assert sum(r.is_citywide for r in got) == 1
    nulls = [r for r in got if r.key is None]
    assert len(nulls) == 2 and {r.is_citywide for r in nulls} == {True, False}


def test_broadcast_and_shuffle_cube_paths_agree(spark, reg):
    rows = [(2020 + i % 2, f"A{i % 3}", f"T{i % 4}", ["ANN", "BOB", "KIM", "X"][i % 4], 100 + i, i % 5) for i in range(200)]
    a = _cube(spark, reg, rows, UNMATCHED_ZERO, 1_000_000)
    b = _cube(spark, reg, rows, UNMATCHED_ZERO, 0)
    ra = {(r.fiscal_year, r.agency, r.title): r for r in a.collect()}
    rb = {(r.fiscal_year, r.agency, r.title): r for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for c in CUBE_MEASURES:
            assert ra[k][c] == pytest.approx(rb[k][c]), (k, c)


def test_cube_equals_direct_aggregation(spark, reg):
    rows = [(2020, f"A{i % 3}", "T", ["ANN", "BOB", "KIM"][i % 3], 1000 + 7 * i, i * 0.25) for i in range(60)]
    cube = _cube(spark, reg, rows)
    got = by(measures(rollup(cube, "agency", city_label=LABEL), "overtime"), "key")
    direct = payroll(spark, rows).groupBy("agency").agg(F.avg("total_ot_paid").alias("a"), F.sum("total_ot_paid").alias("t"))
    for r in direct.collect():
        assert got[r.agency]["Average"] == pytest.approx(r.a)
        assert got[r.agency]["Total"] == pytest.approx(r.t)


def test_eligibility_filter(spark):
    rows = [
        (2020, "A", "T", "ANN", 1, 0),
        (2020, "A", "T", "ANN", 1, 0, "per Hour"),
        (2020, "A", "T", "ANN", 1, 0, "per Annum", "ON LEAVE"),
        (2020, "A", "T", "ANN", 1, 0, "per Annum", None),
        (2013, "A", "T", "ANN", 1, 0),
    ]
    assert eligible(payroll(spark, rows), [2020]).count() == 1


def test_group_size_forms(spark):
    rows = [(2020, "A", "T", "X", 1, 0)] * 3 + [(2020, None, "T", "X", 1, 0)] * 3 + [(2020, "B", "T", "X", 1, 0)] * 2
    df = payroll(spark, rows)
    having = by(group_size_having(df, ["agency"], 2), "agency")
    assert set(having) == {"A", None} and having["A"]["n"] == 3
    kept = group_size_keep_rows(df, ["agency"], 2).collect()
    assert len(kept) == 6 and {r.agency for r in kept} == {"A", None}

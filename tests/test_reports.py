"""Report-level properties on the test tables, plan shape, and the DuckDB oracle for every query."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from helpers import SF0001, SF001
from wagelens import STAR_V2020, STAR_V2022, Inputs, ReportSuite
from wagelens.plans import catalog
from wagelens.sources import star


def _suite(spark, profile=STAR_V2020, sf=SF001, **changes):
    p = profile.with_(**changes) if changes else profile
    inputs = Inputs(star.payroll(spark, sf, p.years), star.names(spark, sf), star.cpi(spark, sf))
    return ReportSuite(inputs, p, keep_cube=True)


def _money(text):
    if text is None:
        return None
    v = float(text.replace("$", "").replace(",", ""))
    return -abs(v) if text.startswith("-") else v


@pytest.fixture(scope="module")
def v2020(spark):
    return _suite(spark)


def test_chart_cells_are_cells_of_full_report(v2020):
    full = {r.Agency: r.asDict() for r in v2020.overtime("agency").collect()}
    chart = {r.Agency: r.asDict() for r in v2020.overtime_chart("agency").collect()}
    assert set(chart) <= set(full)
    for k, row in chart.items():
        for c, v in row.items():
            if v is not None:
                assert full[k][c] == v


def test_keys_unique_one_citywide_and_year_columns_null_together(v2020):
    label = STAR_V2020.city_label
    for df in (v2020.overtime("title"), v2020.gender_gap("agency"), v2020.overtime_chart("title")):
        rows = df.collect()
        key = df.columns[0]
        keys = [r[key] for r in rows]
        assert len(keys) == len(set(keys))
        assert keys.count(label) == 1
        for r in rows:
            for y in STAR_V2020.years:
                cells = [r[c] for c in df.columns if c.endswith(f"_{y}")]
                assert all(c is None for c in cells) or all(c is not None for c in cells[:-1])


def test_agency_totals_add_up_to_citywide(v2020):
    long = v2020.long("overtime", "agency", chart=False).collect()
    for y in STAR_V2020.years:
        parts = sum(r.Total for r in long if r.fiscal_year == y and not r.is_citywide)
        city = [r.Total for r in long if r.fiscal_year == y and r.is_citywide][0]
        assert parts == pytest.approx(city, rel=1e-12)


def test_latest_table_equals_latest_year_of_chart(v2020):
    y = STAR_V2020.base_year
    table = {r.Agency: r for r in v2020.overtime_latest("agency").collect()}
    chart = {r.Agency: r for r in v2020.overtime_chart("agency").collect()}
    for k, r in table.items():
        assert _money(r.Total) == pytest.approx(_money(chart[k][f"Total_{y}"]), abs=1)


def test_gap_and_average_between_male_and_female(v2020):
    for r in v2020.gender_gap_table("title").collect():
        m, f, a = _money(r.Male), _money(r.Female), _money(r.Average)
        g = float(r.Gap.rstrip("%"))
        assert g == pytest.approx(100 * (m - f) / (m + f), abs=0.06)
        assert min(m, f) - 1 <= a <= max(m, f) + 1


def test_citywide_scope_changes_only_the_citywide_row(spark, v2020):
    kept = _suite(spark, city_scope="kept").overtime_chart("title")
    a = {r.Title: r for r in v2020.overtime_chart("title").collect()}
    b = {r.Title: r for r in kept.collect()}
    label = STAR_V2020.city_label
    assert set(a) == set(b)
    for k in a:
        if k != label:
            assert a[k] == b[k]


def test_second_profile_keeps_unmatched(spark):
    s = _suite(spark, STAR_V2022)
    reports = s.all_reports()
    assert "Uncommon_Names_Agency" in reports
    v20 = _suite(spark, STAR_V2022, unmatched="drop").long("gender", "agency", chart=False)
    v22 = s.long("gender", "agency", chart=False)
    n20 = sum(r.n for r in v20.collect() if r.is_citywide)
    n22 = sum(r.n for r in v22.collect() if r.is_citywide)
    assert n22 > n20


def _explain(df, mode="simple"):
    """Plan text from the public explain(), captured instead of printed."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def _plan(df):
    return _explain(df, "simple")


def test_plan_single_fact_scan_broadcast_lookup_no_python(spark, v2020):
    cube = catalog.q_measure_cube(spark, SF001)
    scans = re.findall(r"FileScan parquet[^\n]*lineitem\.parquet", _plan(cube))
    assert len(scans) == 1
    text = _explain(cube, "extended")
    assert "BroadcastHashJoin" in text
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    # One shuffle for the cube itself: partial aggregate -> exchange -> final aggregate.
    assert "partial_sum" in text


def test_suite_reports_read_the_stored_cube(v2020):
    v2020.cube()
    for name, df in v2020.all_reports().items():
        if name != "baby_names":
            assert "lineitem" not in _plan(df), name


def test_plan_fallback_pre_aggregates_before_shuffle_join(spark):
    # With the planner's own broadcast turned off too, the weights really are shuffle-joined.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cube = catalog.q_measure_cube_shuffle(spark, SF001)
        text = _explain(cube, "extended")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    phys = text[text.index("== Physical Plan ==") :]
    # The facts are summed per name before the join.
    assert phys.count("HashAggregate") >= 4


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns[0] == "Agency"


def _norm(v):
    if v is None:
        return "<NULL>"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sql = entry_module.oracle_sql()[name]
    df = entry_module.queries()[name](spark, SF001)
    rel = duck.sql(sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    to_duck = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: to_duck.get(t, t) for c, t in df.dtypes} == duck_types
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order_s = [df.columns.index(c) for c in sorted(df.columns)]
    order_d = [dcols.index(c) for c in sorted(dcols)]
    a = sorted(tuple(_norm(r[i]) for i in order_s) for r in df.collect())
    b = sorted(tuple(_norm(r[i]) for i in order_d) for r in res.fetchall())
    assert a == b


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_nested_loop_cartesian_or_python_in_plans(spark, name):
    plan = _plan(entry_module.queries()[name](spark, SF0001))
    for bad in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert bad not in plan, bad


def test_gender_and_overtime_tables_have_the_same_keys(v2020):
    a = sorted(r.Title for r in v2020.gender_gap_table("title").collect())
    b = sorted(r.Title for r in v2020.overtime_latest("title").collect())
    assert a == b


def test_chart_keeps_exactly_the_groups_over_the_threshold(v2020):
    long = v2020.long("overtime", "title", chart=False).collect()
    chart = v2020.long("overtime", "title", chart=True).collect()
    expect = {(r.fiscal_year, r.key) for r in long if r.is_citywide or r.n > STAR_V2020.min_group_title}
    assert {(r.fiscal_year, r.key) for r in chart} == expect

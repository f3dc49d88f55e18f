"""Report rows against a plain-Python, year-by-year computation on a small hand-made fixture.

The fixture has a hot agency (a third of the rows), a hot first name, unmatched names, a name
whose counts sum to 0, missing salaries and overtime, rows of other pay bases and statuses, and
groups right at the threshold. The Python side follows the report rules literally, one year
at a time, the way the published scripts loop.
"""

import math
import random

import pytest

from helpers import names, payroll
from wagelens import Inputs, ReportSuite, STAR_V2020, STAR_V2022
from wagelens.operators.names import UNMATCHED_DROP

YEARS = (2019, 2020)
LABEL = "ALL"

NAME_ROWS = [
    ("NY", "F", 2000, "ann", 5), ("NJ", "F", 2001, "ANN", 1), ("NY", "M", 2000, "Ann", 2),
    ("NY", "M", 2000, "BOB", 7), ("NY", "F", 2000, "KIM", 3), ("NY", "M", 2000, "KIM", 3),
    ("NY", "F", 2000, "EVE", 4), ("NY", "X", 2000, "ZED", 2),
]


def _fixture():
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        year = YEARS[i % 2]
        agency = "HOT" if i % 3 == 0 else f"A{i % 7}"
        name = "ANN" if i % 3 == 1 else rnd.choice(["BOB", "KIM", "EVE", "ZED", "NOBODY", "Ann", None])
        sal = None if i % 97 == 0 else round(rnd.uniform(30000, 150000), 2)
        ot = None if i % 89 == 0 else round(rnd.uniform(-50, 9000), 2)
        basis = "per Hour" if i % 31 == 0 else "per Annum"
        status = "ON LEAVE" if i % 37 == 0 else "ACTIVE"
        rows.append((year, agency, f"T{i % 4}", name, sal, ot, basis, status))
    return rows


def _weights():
    counts = {}
    for _, sex, _, name, c in NAME_ROWS:
        key = name.upper()
        counts.setdefault(key, {"F": 0, "M": 0})
        if sex in ("F", "M"):
            counts[key][sex] += c
    out = {}
    for n, c in counts.items():
        t = c["F"] + c["M"]
        out[n] = (c["M"] / t, c["F"] / t) if t else None  # None: unmatched
    return out


def _mean(xs):
    return None if not xs or any(x is None for x in xs) else sum(xs) / len(xs)


def _total(xs):
    return None if any(x is None for x in xs) else sum(xs)


def _wmean(xs, ws):
    if any(x is None for x, w in zip(xs, ws) if w != 0):
        return None
    sw = sum(ws)
    return None if sw == 0 else sum(x * w for x, w in zip(xs, ws) if w != 0) / sw


def _brute(rows, unmatched, grain, threshold):
    w = _weights()
    kept = []
    for fy, agency, title, name, sal, ot, basis, status in rows:
        weight = w.get(name) if name is not None else None
        if weight is None and unmatched == UNMATCHED_DROP:
            continue
        m, f = weight if weight else (0.0, 0.0)
        common = 1 if weight else 0
        kept.append(dict(fy=fy, agency=agency, title=title, sal=sal, ot=ot, basis=basis, status=status, m=m, f=f, c=common, u=1 - common))
    out = {}
    for k in YEARS:
        year_rows = [r for r in kept if r["fy"] == k and r["basis"] == "per Annum" and r["status"] == "ACTIVE"]

        def summary(rs):
            sal = [r["sal"] for r in rs]
            return dict(
                n=len(rs),
                Average=_mean(sal),
                Male=_wmean(sal, [r["m"] for r in rs]),
                Female=_wmean(sal, [r["f"] for r in rs]),
                Common=_wmean(sal, [r["c"] for r in rs]),
                Uncommon=_wmean(sal, [r["u"] for r in rs]),
                OT_Average=_mean([r["ot"] for r in rs]),
                OT_Total=_total([r["ot"] for r in rs]),
            )

        out[(k, LABEL, True)] = summary(year_rows)
        for key in {r[grain] for r in year_rows}:
            group = [r for r in year_rows if r[grain] == key]
            if threshold is None or len(group) > threshold:
                out[(k, key, False)] = summary(group)
    return out


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("profile", [STAR_V2020, STAR_V2022], ids=["drop", "zero"])
@pytest.mark.parametrize("grain,threshold", [("agency", None), ("agency", 100), ("title", 95)])
@pytest.mark.parametrize("max_rows", [1_000_000, 0], ids=["broadcast", "shuffle"])
def test_reports_equal_brute_force(spark, profile, grain, threshold, max_rows):
    rows = _fixture()
    p = profile.with_(years=YEARS, city_label=LABEL, min_group_agency=threshold or 0, min_group_title=threshold or 0, max_broadcast_rows=max_rows)
    inputs = Inputs(payroll(spark, rows), names(spark, NAME_ROWS), None)
    suite = ReportSuite(inputs, p)
    chart = threshold is not None
    expect = _brute(rows, p.unmatched, grain, threshold)
    kinds = {"gender": ("Average", "Male", "Female"), "overtime": ("Average", "Total"), "names": ("Average", "Common", "Uncommon")}
    for kind, cols in kinds.items():
        got = {(r.fiscal_year, r.key, r.is_citywide): r for r in suite.long(kind, grain, chart, restated=False).collect()}
        assert set(got) == set(expect), kind
        for k, e in expect.items():
            assert got[k].n == e["n"]
            for c in cols:
                want = e[f"OT_{c}"] if kind == "overtime" else e[c]
                assert _close(got[k][c], want), (kind, k, c, got[k][c], want)


def _py_dollar_column(values):
    """Dollar texts of one column: cents unless max |x| > 100,000 or all values whole."""
    present = [v for v in values if v is not None]
    cents = bool(present) and max(abs(v) for v in present) <= 100_000 and any(v != math.floor(v) for v in present)
    return [None if v is None else ("-$" if v < 0 else "$") + format(abs(v), ",.2f" if cents else ",.0f") for v in values]


def test_wide_overtime_report_equals_brute_force(spark):
    from helpers import cpi

    rows = _fixture()
    p = STAR_V2020.with_(years=YEARS, city_label=LABEL)
    index = {2019: 250.0, 2020: 262.5}
    suite = ReportSuite(Inputs(payroll(spark, rows), names(spark, NAME_ROWS), cpi(spark, [(y, 6, v) for y, v in index.items()])), p)
    got = {r["Agency"]: r.asDict() for r in suite.overtime("agency").collect()}

    expect = _brute(rows, p.unmatched, "agency", None)
    base = index[max(YEARS)]
    by_year = {}
    for (fy, key, city), e in expect.items():
        restated = {c: None if e[f"OT_{c}"] is None else (e[f"OT_{c}"] / index[fy]) * base for c in ("Average", "Total")}
        by_year.setdefault(fy, {})[(key, city)] = restated
    want = {}
    for fy, cells in by_year.items():
        keys = list(cells)
        for c in ("Average", "Total"):
            texts = _py_dollar_column([cells[k][c] for k in keys])
            for k, t in zip(keys, texts):
                want.setdefault(k[0], {})[f"{c}_{fy}"] = t
    assert set(got) == set(want)
    for key, cols in want.items():
        for c, t in cols.items():
            assert got[key][c] == t, (key, c, got[key][c], t)
        for y in YEARS:  # a key missing in a year is NULL in all of that year's columns
            if f"Average_{y}" not in cols:
                assert got[key][f"Average_{y}"] is None and got[key][f"Total_{y}"] is None


def _py_percent(x):
    from decimal import ROUND_HALF_EVEN, Decimal

    if x is None:
        return None
    v = float(Decimal(repr(x * 100.0)).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN)) + 0.0
    return format(v, ",.1f") + "%"


@pytest.mark.parametrize("profile", [STAR_V2020, STAR_V2022], ids=["drop", "zero"])
def test_one_year_gender_table_equals_brute_force(spark, profile):
    rows = _fixture()
    p = profile.with_(years=YEARS, city_label=LABEL, min_group_agency=100)
    table = {r["Agency"]: r.asDict() for r in ReportSuite(Inputs(payroll(spark, rows), names(spark, NAME_ROWS), None), p).gender_gap_table("agency").collect()}
    expect = {key: e for (fy, key, city), e in _brute(rows, p.unmatched, "agency", 100).items() if fy == max(YEARS)}
    assert set(table) == set(expect)
    keys = list(expect)
    for c in ("Average", "Male", "Female"):
        for k, t in zip(keys, _py_dollar_column([expect[k][c] for k in keys])):
            assert table[k][c] == t, (k, c)
    for k in keys:
        m, f = expect[k]["Male"], expect[k]["Female"]
        g = None if m is None or f is None or m + f == 0 else (m - f) / (m + f)
        assert table[k]["Gap"] == _py_percent(g), k


# -- randomized: hypothesis draws small payrolls, both profiles must match the brute force -----

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_row = st.tuples(
    st.sampled_from(YEARS),
    st.sampled_from(["A", "B", None]),
    st.sampled_from(["T1", "T2"]),
    st.sampled_from(["ANN", "BOB", "KIM", "ZED", "NOBODY", None]),
    st.one_of(st.none(), st.integers(1, 10**7).map(lambda c: c / 100)),
    st.one_of(st.none(), st.integers(-5000, 10**6).map(lambda c: c / 100)),
    st.sampled_from(["per Annum", "per Annum", "per Hour"]),
    st.sampled_from(["ACTIVE", "ACTIVE", "ON LEAVE"]),
)


@settings(max_examples=8, deadline=None)
@given(st.lists(_row, min_size=1, max_size=40), st.sampled_from([STAR_V2020, STAR_V2022]))
def test_random_payrolls_equal_brute_force(spark, rows, profile):
    p = profile.with_(years=YEARS, city_label=LABEL)
    suite = ReportSuite(Inputs(payroll(spark, rows), names(spark, NAME_ROWS), None), p)
    expect = _brute(rows, p.unmatched, "agency", None)
    for kind, cols in {"gender": ("Average", "Male", "Female"), "overtime": ("Average", "Total")}.items():
        got = {(r.fiscal_year, r.key, r.is_citywide): r for r in suite.long(kind, "agency", False, restated=False).collect()}
        # A year without eligible rows has no rows at all (no citywide row either).
        want = {k: e for k, e in expect.items() if e["n"] > 0}
        assert set(got) == set(want), kind
        for k, e in want.items():
            for c in cols:
                w = e[f"OT_{c}"] if kind == "overtime" else e[c]
                assert _close(got[k][c], w), (kind, k, c, got[k][c], w)

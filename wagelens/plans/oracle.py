"""DuckDB SQL for every registered query, over the generated test tables (pre-registered views).

Written independently of the Spark code, straight from the report definitions; the SQL is the
reference answer the Spark results are checked against.
"""

from __future__ import annotations

from .profiles import CITY_LABEL, STAR_V2020, STAR_V2022, Profile, passing

D = "::DOUBLE"


def _years(p: Profile) -> str:
    return ", ".join(str(y) for y in p.years)


def _sum(x: str) -> str:
    """Sum of raw amounts; only the result is rounded, to take off the noise of adding doubles."""
    return f"round(fsum({x}), 4)"


PAYROLL = """payroll AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS fiscal_year,
         p.p_type AS agency, p.p_brand AS title, n.n_name AS first_name,
         CASE WHEN l.l_returnflag = 'R' THEN 'per Annum' ELSE l.l_returnflag END AS pay_basis,
         CASE WHEN l.l_linestatus = 'F' THEN 'ACTIVE' ELSE l.l_linestatus END AS leave_status,
         l.l_extendedprice AS base_salary,
         l.l_quantity * l.l_discount AS total_ot_paid
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

# The same payroll with amounts missing: no salary where no overtime was paid, no overtime below a salary.
PAYROLL_MISSING = PAYROLL.replace("payroll AS (", "full_payroll AS (", 1) + """,
payroll AS (
  SELECT fiscal_year, agency, title, first_name, pay_basis, leave_status,
         CASE WHEN total_ot_paid <> 0 THEN base_salary END AS base_salary,
         CASE WHEN base_salary >= 2000 THEN total_ot_paid END AS total_ot_paid
  FROM full_payroll
)"""

NAMES = """names AS (
  SELECT r.r_name AS state,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'F' ELSE 'M' END AS sex,
         0 AS year, CASE WHEN r.r_name = 'ASIA' THEN 'de ' || lower(n.n_name) ELSE lower(n.n_name) END AS name, CAST(1 AS BIGINT) AS count
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# Names that carry the market segment: each is registered for one sex only.
NAMES_ONE_SEX = NAMES.replace("lower(n.n_name) END AS name", "lower(n.n_name) END || ' ' || lower(c.c_mktsegment) AS name", 1)

COUNTS = """counts AS (
  SELECT upper(name) AS name, sex, CAST(sum(count) AS BIGINT) AS count FROM names GROUP BY upper(name), sex
)"""

WEIGHTS = """weights AS (
  SELECT name, F, M,
         CASE WHEN F + M = 0 THEN NULL ELSE CAST(M AS DOUBLE) / CAST(F + M AS DOUBLE) END AS M_weight,
         CASE WHEN F + M = 0 THEN NULL ELSE CAST(F AS DOUBLE) / CAST(F + M AS DOUBLE) END AS F_weight
  FROM (
    SELECT upper(name) AS name,
           CAST(coalesce(sum(CASE WHEN sex = 'F' THEN count END), 0) AS BIGINT) AS F,
           CAST(coalesce(sum(CASE WHEN sex = 'M' THEN count END), 0) AS BIGINT) AS M
    FROM names GROUP BY upper(name)
  )
)"""

CPI = f"""cpi AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         {_sum('o_totalprice')} / CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2
)"""


def eligible_cte(p: Profile) -> str:
    return f"""eligible AS (
  SELECT * FROM payroll
  WHERE fiscal_year IN ({_years(p)}) AND pay_basis = 'per Annum' AND leave_status = 'ACTIVE'
)"""


def enriched_cte(unmatched: str) -> str:
    if unmatched == "drop":
        return """enriched AS (
  SELECT e.*, w.M_weight AS Male, w.F_weight AS Female, 1 AS Common, 0 AS Uncommon
  FROM eligible e JOIN weights w ON e.first_name = w.name
  WHERE w.M_weight IS NOT NULL AND w.F_weight IS NOT NULL
)"""
    return """enriched AS (
  SELECT e.*, coalesce(w.M_weight, 0.0::DOUBLE) AS Male, coalesce(w.F_weight, 0.0::DOUBLE) AS Female,
         CASE WHEN w.M_weight IS NOT NULL THEN 1 ELSE 0 END AS Common,
         CASE WHEN w.M_weight IS NOT NULL THEN 0 ELSE 1 END AS Uncommon
  FROM eligible e LEFT JOIN weights w ON e.first_name = w.name
)"""


def _sums() -> str:
    """Additive measures over enriched rows (the cube's columns)."""
    sal, ot = "base_salary", "total_ot_paid"
    parts = [
        "count(*) AS n",
        "count(base_salary) AS n_salary",
        f"{_sum(sal)} AS salary_sum",
        "count(total_ot_paid) AS n_ot",
        f"{_sum(ot)} AS ot_sum",
    ]
    for tag, w in (("m", "Male"), ("f", "Female")):
        parts += [
            f"sum({w}) AS w_{tag}",
            f"sum(CASE WHEN {w} <> 0 THEN {w} * {sal} ELSE 0.0{D} END) AS xw_{tag}",
            f"CAST(sum(CASE WHEN {w} <> 0 AND base_salary IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_{tag}",
            f"sum(CASE WHEN base_salary IS NOT NULL THEN {w} ELSE 0.0{D} END) AS wv_{tag}",
        ]
    for tag, w in (("c", "Common"), ("u", "Uncommon")):
        parts += [
            f"CAST(sum({w}) AS BIGINT) AS w_{tag}",
            f"{_sum(f'{w} * {sal}')} AS xw_{tag}",
            f"CAST(sum(CASE WHEN base_salary IS NULL THEN {w} ELSE 0 END) AS BIGINT) AS bad_{tag}",
        ]
    return ",\n         ".join(parts)


DOUBLE_MEASURES = ("w_m", "xw_m", "w_f", "xw_f", "wv_m", "wv_f")
MONEY_MEASURES = ("salary_sum", "ot_sum", "xw_c", "xw_u")


def _resum(cols: list[str]) -> str:
    def one(c: str) -> str:
        return _sum(c) if c in MONEY_MEASURES else f"sum({c})" if c in DOUBLE_MEASURES else f"CAST(sum({c}) AS BIGINT)"

    return ", ".join(f"{one(c)} AS {c}" for c in cols)


def _mean(s: str, v: str, n: str) -> str:
    return f"CASE WHEN {v} = {n} THEN {s} / CAST({n} AS DOUBLE) END"


def _total(s: str, v: str, n: str) -> str:
    return f"CASE WHEN {v} = {n} THEN {s} END"


def _weighted(xw: str, w: str, bad: str) -> str:
    return f"CASE WHEN {bad} = 0 AND {w} <> 0 THEN {xw} / CAST({w} AS DOUBLE) END"


def _gap(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) + ({b}) <> 0 THEN (({a}) - ({b})) / (({a}) + ({b})) END"


def _pct(x: str) -> str:
    return f"format('{{:,.1f}}', round_even(({x}) * 100.0{D}, 1) + 0.0{D}) || '%'"


def _dollar(x: str, cents_flag: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL ELSE (CASE WHEN {x} < 0 THEN '-$' ELSE '$' END) || "
        f"(CASE WHEN {cents_flag} THEN format('{{:,.2f}}', abs({x})) ELSE format('{{:,.0f}}', abs({x})) END) END"
    )


def _cents_flag(x: str, part: str = "fiscal_year") -> str:
    mx = f"max(abs({x})) OVER (PARTITION BY {part})"
    frac = f"bool_or({x} <> floor({x})) OVER (PARTITION BY {part})"
    return f"coalesce(({mx}) IS NOT NULL AND ({mx}) <= 100000 AND ({frac}), false)"


MEASURE_COLS = [
    "n", "n_salary", "salary_sum", "n_ot", "ot_sum", "w_m", "xw_m", "bad_m", "w_f", "xw_f", "bad_f",
    "w_c", "xw_c", "bad_c", "w_u", "xw_u", "bad_u", "wv_m", "wv_f",
]


def rolled_cte(key: str, min_group: int | None, city_scope: str = "all") -> str:
    """``rolled``: per (fiscal_year, key) sums, threshold applied, plus citywide rows."""
    where = "" if min_group is None else f"WHERE n > {min_group}"
    city_src = "per_key" if city_scope == "all" else "kept"
    return f"""per_key AS (
  SELECT fiscal_year, {key} AS key,
         {_sums()}
  FROM enriched GROUP BY fiscal_year, {key}
),
kept AS (SELECT * FROM per_key {where}),
rolled AS (
  SELECT fiscal_year, key, false AS is_citywide, {', '.join(MEASURE_COLS)} FROM kept
  UNION ALL
  SELECT fiscal_year, '{CITY_LABEL}' AS key, true AS is_citywide, {_resum(MEASURE_COLS)}
  FROM {city_src} GROUP BY fiscal_year
)"""


def index_cte(p: Profile) -> str:
    return f"""idx AS (
  SELECT y.year AS fiscal_year, y.value AS year_value, b.value AS base_value
  FROM cpi y JOIN cpi b ON b.year = {p.base_year} AND b.month = {p.cpi_month}
  WHERE y.month = {p.cpi_month} AND y.year IN ({_years(p)})
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _base(p: Profile, unmatched: str, payroll: str = PAYROLL) -> list[str]:
    return [payroll, NAMES, WEIGHTS, CPI, eligible_cte(p), enriched_cte(unmatched)]


def _salary_mean(strict: bool) -> str:
    return _mean("salary_sum", "n_salary", "n") if strict else "CASE WHEN n_salary > 0 THEN salary_sum / CAST(n_salary AS DOUBLE) END"


def _gender_measures(strict: bool = True) -> str:
    if strict:
        male, female = _weighted("xw_m", "w_m", "bad_m"), _weighted("xw_f", "w_f", "bad_f")
    else:
        male, female = _weighted("xw_m", "wv_m", "0"), _weighted("xw_f", "wv_f", "0")
    return f"{_salary_mean(strict)} AS Average, {male} AS Male, {female} AS Female"


def _names_measures(strict: bool = True) -> str:
    if strict:
        common, uncommon = _weighted("xw_c", "w_c", "bad_c"), _weighted("xw_u", "w_u", "bad_u")
    else:
        common, uncommon = _weighted("xw_c", "(w_c - bad_c)", "0"), _weighted("xw_u", "(w_u - bad_u)", "0")
    return f"{_salary_mean(strict)} AS Average, {common} AS Common, {uncommon} AS Uncommon"


def _ot_measures(strict: bool = True) -> str:
    if strict:
        return f"{_mean('ot_sum', 'n_ot', 'n')} AS Average, {_total('ot_sum', 'n_ot', 'n')} AS Total"
    return f"CASE WHEN n_ot > 0 THEN ot_sum / CAST(n_ot AS DOUBLE) END AS Average, coalesce(ot_sum, 0.0{D}) AS Total"


def _restated(x: str) -> str:
    return f"(({x}) / i.year_value) * i.base_value"


def _wide_select(label: str, cols: dict[str, str], years, round_cols=()) -> str:
    out = [f"key AS {label}"]
    for y in years:
        for name, expr in cols.items():
            v = f"max(CASE WHEN fiscal_year = {y} THEN {expr} END)"
            if name in round_cols:
                v = f"round({v}, 2)"
            out.append(f"{v} AS {name}_{y}")
    return ", ".join(out)


def ratio_wide_sql(p: Profile, grain: str, chart: bool, kind: str, payroll: str = PAYROLL) -> str:
    label = {"agency": "Agency", "title": "Title"}[grain]
    min_group = (p.min_group_agency if grain == "agency" else p.min_group_title) if chart else None
    a, b = ("Male", "Female") if kind == "gender" else ("Common", "Uncommon")
    meas = _gender_measures(p.strict_nulls) if kind == "gender" else _names_measures(p.strict_nulls)
    ctes = _base(p, p.unmatched, payroll) + [
        rolled_cte(grain, min_group, p.city_scope),
        index_cte(p),
        f"""m AS (SELECT fiscal_year, key, is_citywide, {meas} FROM rolled)""",
        f"""r AS (
  SELECT m.fiscal_year, key, is_citywide, {_restated('Average')} AS Average,
         {_restated(a)} AS {a}, {_restated(b)} AS {b}
  FROM m JOIN idx i ON m.fiscal_year = i.fiscal_year
)""",
        f"""g AS (SELECT *, {_pct(_gap(a, b))} AS Gap FROM r)""",
    ]
    rnd = ("Male", "Female") if kind == "gender" else ()
    cols = {"Average": "Average", a: a, b: b, "Gap": "Gap"}
    return _with(*ctes) + f"SELECT {_wide_select(label, cols, p.years, rnd)} FROM g GROUP BY key, is_citywide"


def overtime_wide_sql(p: Profile, grain: str, chart: bool, payroll: str = PAYROLL) -> str:
    label = {"agency": "Agency", "title": "Title"}[grain]
    min_group = (p.min_group_agency if grain == "agency" else p.min_group_title) if chart else None
    ctes = _base(p, p.unmatched, payroll) + [
        rolled_cte(grain, min_group, p.city_scope),
        index_cte(p),
        f"""m AS (SELECT fiscal_year, key, is_citywide, {_ot_measures(p.strict_nulls)} FROM rolled)""",
        f"""r AS (
  SELECT m.fiscal_year, key, is_citywide, {_restated('Average')} AS Average, {_restated('Total')} AS Total
  FROM m JOIN idx i ON m.fiscal_year = i.fiscal_year
)""",
        f"""t AS (
  SELECT fiscal_year, key, is_citywide,
         {_dollar('Average', _cents_flag('Average'))} AS Average,
         {_dollar('Total', _cents_flag('Total'))} AS Total
  FROM r
)""",
    ]
    cols = {"Average": "Average", "Total": "Total"}
    return _with(*ctes) + f"SELECT {_wide_select(label, cols, p.years)} FROM t GROUP BY key, is_citywide"


def gender_table_sql(p: Profile, grain: str) -> str:
    label = {"agency": "Agency", "title": "Title"}[grain]
    min_group = p.min_group_agency if grain == "agency" else p.min_group_title
    ctes = _base(p, p.unmatched) + [
        rolled_cte(grain, min_group, p.city_scope),
        f"""m AS (SELECT fiscal_year, key, is_citywide, {_gender_measures()} FROM rolled WHERE fiscal_year = {p.base_year})""",
    ]
    return _with(*ctes) + f"""SELECT key AS {label},
  {_dollar('Average', _cents_flag('Average'))} AS Average,
  {_dollar('Male', _cents_flag('Male'))} AS Male,
  {_dollar('Female', _cents_flag('Female'))} AS Female,
  {_pct(_gap('Male', 'Female'))} AS Gap
FROM m"""


def overtime_latest_sql(p: Profile, grain: str) -> str:
    label = {"agency": "Agency", "title": "Title"}[grain]
    min_group = p.min_group_agency if grain == "agency" else p.min_group_title
    ctes = _base(p, p.unmatched) + [
        rolled_cte(grain, min_group, p.city_scope),
        f"""m AS (SELECT fiscal_year, key, is_citywide, {_ot_measures()} FROM rolled WHERE fiscal_year = {p.base_year})""",
    ]
    return _with(*ctes) + f"""SELECT key AS {label},
  {_dollar('Average', _cents_flag('Average'))} AS Average,
  {_dollar('Total', _cents_flag('Total'))} AS Total
FROM m"""


def _cube_sql(p: Profile, unmatched: str) -> str:
    ctes = _base(p, unmatched)
    sel = _sums()
    return _with(*ctes) + f"""SELECT fiscal_year, agency, title, {', '.join(c for c in MEASURE_COLS if c not in DOUBLE_MEASURES)},
  round(wv_m, 6) AS wv_m, round(wv_f, 6) AS wv_f, round(w_m, 6) AS w_m, round(w_f, 6) AS w_f, round(xw_m, 4) AS xw_m, round(xw_f, 4) AS xw_f
FROM (SELECT fiscal_year, agency, title, {sel} FROM enriched GROUP BY fiscal_year, agency, title)"""


def build() -> dict[str, str]:
    p, p2 = STAR_V2020, STAR_V2022
    lookup_cols = "e.fiscal_year, e.agency, e.title, e.first_name, e.base_salary"
    sql: dict[str, str] = {}
    sql["name_sex_counts"] = _with(NAMES, COUNTS) + "SELECT name, sex, count FROM counts"
    sql["name_spread"] = _with(NAMES, COUNTS) + """SELECT name,
  CAST(coalesce(sum(CASE WHEN sex = 'F' THEN count END), 0) AS BIGINT) AS F,
  CAST(coalesce(sum(CASE WHEN sex = 'M' THEN count END), 0) AS BIGINT) AS M
FROM counts GROUP BY name"""
    sql["name_weights"] = _with(NAMES, WEIGHTS) + "SELECT * FROM weights"
    sql["name_weights_from_spread"] = sql["name_weights"]
    sql["lookup_left"] = _with(PAYROLL, NAMES, WEIGHTS) + f"""SELECT {lookup_cols}, w.M_weight AS Male, w.F_weight AS Female
FROM payroll e LEFT JOIN weights w ON e.first_name = w.name"""
    sql["lookup_matched_only"] = _with(PAYROLL, NAMES, WEIGHTS) + f"""SELECT {lookup_cols}, w.M_weight AS Male, w.F_weight AS Female
FROM payroll e JOIN weights w ON e.first_name = w.name WHERE w.M_weight IS NOT NULL AND w.F_weight IS NOT NULL"""
    sql["common_flags"] = _with(PAYROLL, NAMES, WEIGHTS) + f"""SELECT {lookup_cols},
  CASE WHEN w.M_weight IS NOT NULL THEN 1 ELSE 0 END AS Common, CASE WHEN w.M_weight IS NOT NULL THEN 0 ELSE 1 END AS Uncommon
FROM payroll e LEFT JOIN weights w ON e.first_name = w.name"""
    sql["zero_fill_weights"] = _with(PAYROLL, NAMES, WEIGHTS) + f"""SELECT {lookup_cols},
  coalesce(w.M_weight, 0.0::DOUBLE) AS Male, coalesce(w.F_weight, 0.0::DOUBLE) AS Female
FROM payroll e LEFT JOIN weights w ON e.first_name = w.name"""
    sql["eligible_filter"] = _with(PAYROLL, eligible_cte(p)) + "SELECT * FROM eligible"
    sal, ot = "base_salary", "total_ot_paid"
    sql["group_mean"] = _with(PAYROLL, eligible_cte(p)) + f"""SELECT fiscal_year, agency,
  {_mean(_sum(sal), 'count(base_salary)', 'count(*)')} AS avg_salary
FROM eligible GROUP BY fiscal_year, agency"""
    sql["group_sum"] = _with(PAYROLL, eligible_cte(p)) + f"""SELECT fiscal_year, agency,
  {_total(_sum(ot), 'count(total_ot_paid)', 'count(*)')} AS total_ot
FROM eligible GROUP BY fiscal_year, agency"""
    sql["weighted_mean"] = _with(*_base(p, "drop")) + f"""SELECT fiscal_year, agency, round(
  {_weighted(f'sum(CASE WHEN Male <> 0 THEN Male * {sal} END)', 'sum(Male)', 'sum(CASE WHEN Male <> 0 AND base_salary IS NULL THEN 1 ELSE 0 END)')}, 2) AS male_avg_salary
FROM enriched GROUP BY fiscal_year, agency"""
    sql["group_size_having"] = _with(*_base(p, "drop")) + f"""SELECT fiscal_year, title, count(*) AS n
FROM enriched GROUP BY fiscal_year, title HAVING count(*) > {p.min_group_title}"""
    sql["group_size_keep_rows"] = _with(PAYROLL, eligible_cte(p)) + f"""SELECT e.* FROM eligible e
JOIN (SELECT fiscal_year, agency FROM eligible GROUP BY fiscal_year, agency HAVING count(*) > {p.min_group_agency}) k
  ON e.fiscal_year = k.fiscal_year AND e.agency IS NOT DISTINCT FROM k.agency"""
    sql["measure_cube"] = _cube_sql(p, "drop")
    sql["measure_cube_shuffle"] = sql["measure_cube"]
    sql["measure_cube_uncommon"] = _cube_sql(p2, "zero")
    sql["streaming_cube"] = sql["measure_cube"]
    sql["append_citywide"] = _with(*_base(p, "drop"), rolled_cte("agency", None)) + f"""SELECT fiscal_year, key AS agency, is_citywide, n, {_ot_measures()} FROM rolled"""
    sql["cpi_parse_period"] = _with(CPI) + "SELECT year, month, value FROM cpi"
    sql["cpi_month_names"] = sql["cpi_parse_period"]
    sql["names_csv_source"] = sql["name_sex_counts"]
    sql["cpi_factor"] = _with(CPI, index_cte(p)) + "SELECT fiscal_year, year_value, base_value FROM idx"
    sql["restate_money"] = _with(PAYROLL, CPI, eligible_cte(p), index_cte(p)) + f"""SELECT g.fiscal_year, agency, {_restated('avg_salary')} AS avg_salary
FROM (SELECT fiscal_year, agency, {_mean(_sum(sal), 'count(base_salary)', 'count(*)')} AS avg_salary FROM eligible GROUP BY fiscal_year, agency) g
JOIN idx i ON g.fiscal_year = i.fiscal_year"""
    gender_long = _with(*_base(p, "drop"), rolled_cte("agency", None))
    sql["gap_ratio"] = gender_long + f"""SELECT fiscal_year, key AS agency, is_citywide, round({_gap('Male', 'Female')}, 6) AS gap
FROM (SELECT fiscal_year, key, is_citywide, {_gender_measures()} FROM rolled)"""
    sql["fmt_percent"] = gender_long + f"""SELECT fiscal_year, key AS agency, is_citywide, {_pct(_gap('Male', 'Female'))} AS gap_text
FROM (SELECT fiscal_year, key, is_citywide, {_gender_measures()} FROM rolled)"""
    sql["fmt_dollar"] = _with(*_base(p, "drop"), rolled_cte("title", None)) + f"""SELECT fiscal_year, key AS title, is_citywide,
  {_dollar('Average', _cents_flag('Average'))} AS Average, {_dollar('Total', _cents_flag('Total'))} AS Total
FROM (SELECT fiscal_year, key, is_citywide, {_ot_measures()} FROM rolled)"""
    sql["pivot_years_wide"] = _with(PAYROLL, eligible_cte(p)) + f"""SELECT {_wide_select('Agency', {'Average': 'avg_salary'}, p.years)}
FROM (SELECT fiscal_year, agency AS key, {_mean(_sum(sal), 'count(base_salary)', 'count(*)')} AS avg_salary FROM eligible GROUP BY fiscal_year, agency)
GROUP BY key"""
    sizes = f"""sizes AS (SELECT fiscal_year, title, count(*) AS n FROM enriched GROUP BY fiscal_year, title HAVING count(*) > {p.min_group_title})"""
    sql["outer_merge_two_years"] = _with(*_base(p, "drop"), sizes) + f"""SELECT coalesce(a.title, b.title) AS title, a.n AS n_first, b.n AS n_last
FROM (SELECT title, n FROM sizes WHERE fiscal_year = {min(p.years)}) a
FULL OUTER JOIN (SELECT title, n FROM sizes WHERE fiscal_year = {max(p.years)}) b ON a.title IS NOT DISTINCT FROM b.title"""
    years = list(p.years)
    merged = f"(SELECT title, n AS n_{years[0]} FROM sizes WHERE fiscal_year = {years[0]})"
    for i, y in enumerate(years[1:], 1):
        have = ", ".join(f"a.n_{x}" for x in years[:i])
        merged = f"""(SELECT coalesce(a.title, b.title) AS title, {have}, b.n AS n_{y}
  FROM {merged} a FULL OUTER JOIN (SELECT title, n FROM sizes WHERE fiscal_year = {y}) b ON a.title IS NOT DISTINCT FROM b.title)"""
    sql["outer_merge_years"] = _with(*_base(p, "drop"), sizes) + f"SELECT * FROM {merged}"
    sql["distinct_keys"] = _with(PAYROLL, eligible_cte(p)) + f"SELECT DISTINCT agency FROM eligible WHERE fiscal_year = {p.base_year}"
    sql["csv_round_trip"] = sql["eligible_filter"]
    sql["payroll_csv_source"] = _with(PAYROLL) + "SELECT * FROM payroll"
    sql["name_weights_export"] = sql["name_weights"]
    sql["payroll_partitioned"] = sql["eligible_filter"]
    for grain in ("agency", "title"):
        sql[f"gender_gap_{grain}"] = ratio_wide_sql(p, grain, False, "gender")
        sql[f"gender_gap_{grain}_chart"] = ratio_wide_sql(p, grain, True, "gender")
        sql[f"gender_gap_{grain}_table"] = gender_table_sql(p, grain)
        sql[f"overtime_{grain}"] = overtime_wide_sql(p, grain, False)
        sql[f"overtime_{grain}_chart"] = overtime_wide_sql(p, grain, True)
        sql[f"overtime_{grain}_latest"] = overtime_latest_sql(p, grain)
    sql["uncommon_names_agency"] = ratio_wide_sql(p2, "agency", False, "names")
    sql["gender_gap_agency_v2022"] = ratio_wide_sql(p2, "agency", False, "gender")
    sql["overtime_agency_v2022"] = overtime_wide_sql(p2, "agency", False)
    sql["gender_gap_title_table_v2022"] = gender_table_sql(p2, "title")
    sql["overtime_title_chart_kept"] = overtime_wide_sql(p.with_(city_scope="kept"), "title", True)
    # Lookups and cubes by their other paths.
    sql["lookup_left_shuffle"] = sql["lookup_left"]
    sql["lookup_matched_only_shuffle"] = sql["lookup_matched_only"]
    sql["streaming_cube_shuffle"] = sql["streaming_cube_csv"] = sql["measure_cube"]
    sql["cpi_two_layouts"] = sql["cpi_month_names"]
    sql["name_weights_csv_parts"] = sql["name_weights"]
    sql["reports_published"] = sql["overtime_agency"]
    sql["name_spread_one_sex"] = _with(NAMES_ONE_SEX, COUNTS) + sql["name_spread"][sql["name_spread"].rindex("SELECT name,"):]
    low = passing(p)
    sql["gender_gap_agency_table_passing"] = gender_table_sql(low, "agency")
    sql["overtime_agency_latest_passing"] = overtime_latest_sql(low, "agency")
    sql["uncommon_names_agency_chart"] = ratio_wide_sql(p2, "agency", True, "names")
    lenient, lenient2 = p.with_(strict_nulls=False), p2.with_(strict_nulls=False)
    sql["gender_gap_agency_missing"] = ratio_wide_sql(p, "agency", False, "gender", PAYROLL_MISSING)
    sql["gender_gap_agency_lenient"] = ratio_wide_sql(lenient, "agency", False, "gender", PAYROLL_MISSING)
    sql["overtime_title_lenient"] = overtime_wide_sql(lenient, "title", False, PAYROLL_MISSING)
    sql["uncommon_names_agency_lenient"] = ratio_wide_sql(lenient2, "agency", False, "names", PAYROLL_MISSING)
    return sql

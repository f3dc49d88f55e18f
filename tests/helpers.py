"""Small builders for hand-made test rows."""

from wagelens import schemas

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"

A, ACT = "per Annum", "ACTIVE"


def payroll(spark, rows):
    """Rows of (fiscal_year, agency, title, first_name, base_salary, total_ot_paid[, basis, status])."""
    full = []
    for r in rows:
        fy, agency, title, name, sal, ot = r[:6]
        basis = r[6] if len(r) > 6 else A
        status = r[7] if len(r) > 7 else ACT
        full.append((fy, agency, title, name, basis, status, None if sal is None else float(sal), None if ot is None else float(ot)))
    return spark.createDataFrame(full, schemas.PAYROLL)


def names(spark, rows):
    """Rows of (state, sex, year, name, count)."""
    return spark.createDataFrame(rows, schemas.NAMES)


def cpi(spark, rows):
    """Rows of (year, month, value)."""
    return spark.createDataFrame([(y, m, float(v)) for y, m, v in rows], schemas.CPI)


def by(df, *keys):
    """Collect into a dict keyed by the given columns."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        k = tuple(d[c] for c in keys)
        out[k if len(k) > 1 else k[0]] = d
    return out

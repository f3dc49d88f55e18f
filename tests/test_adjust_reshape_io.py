"""Price index, restatement, wide layout, outer merge and CSV round trips."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import by, cpi
from wagelens.operators.adjust import index_values, restate_columns
from wagelens.operators.joins import outer_merge
from wagelens.operators.reshape import to_wide
from wagelens.session import scratch_path
from wagelens.sources import files
from wagelens.sources.sinks import write_csv


def test_index_values_and_base_year_factor(spark):
    idx = by(index_values(cpi(spark, [(2019, 6, 250.0), (2020, 6, 260.0), (2020, 11, 1.0)]), [2019, 2020], 6, 2020), "fiscal_year")
    assert idx[2019]["year_value"] == 250.0 and idx[2019]["base_value"] == 260.0
    df = spark.createDataFrame([(2019, 100.0), (2020, 100.0)], "fiscal_year int, x double")
    got = by(restate_columns(df, index_values(cpi(spark, [(2019, 6, 250.0), (2020, 6, 260.0)]), [2019, 2020], 6, 2020), ["x"]), "fiscal_year")
    assert got[2020]["x"] == 100.0
    assert got[2019]["x"] == pytest.approx(104.0)


def test_missing_index_month_fails(spark):
    with pytest.raises(PySparkException, match="no row for year 2019"):
        index_values(cpi(spark, [(2020, 6, 1.0)]), [2019, 2020], 6, 2020).collect()


def test_duplicate_index_month_fails(spark):
    with pytest.raises(PySparkException, match="2 rows for year 2020"):
        index_values(cpi(spark, [(2020, 6, 1.0), (2020, 6, 2.0), (2019, 6, 1.0)]), [2019, 2020], 6, 2020).collect()


def test_period_parse(spark):
    df = spark.createDataFrame([("2014-11", 1.5), ("junk", 2.0)], "period string, value double")
    got = files.cpi_from_periods(df).collect()
    assert (got[0].year, got[0].month, got[0].value) == (2014, 11, 1.5)
    assert got[1].year is None and got[1].month is None


def test_month_names(spark):
    df = spark.createDataFrame([(2020, "June", 1.0), (2020, "November", 2.0)], "year int, periodName string, value double")
    assert [r.month for r in files.cpi_from_month_names(df).collect()] == [6, 11]


def test_wide_layout_missing_year_and_null_key(spark):
    long = spark.createDataFrame(
        [(2019, "A", False, 1.0, 2.0), (2020, None, False, 3.0, 4.0), (2019, None, False, 5.0, 6.0), (2020, "C", True, 7.0, 8.0)],
        "fiscal_year int, key string, is_citywide boolean, Average double, Total double",
    )
    wide = to_wide(long, "key", ["Average", "Total"], [2019, 2020], "Agency")
    assert wide.columns == ["Agency", "Average_2019", "Total_2019", "Average_2020", "Total_2020", "is_citywide"]
    got = {(r.Agency, r.is_citywide): r for r in wide.collect()}
    assert len(got) == 3
    assert got[("A", False)].Average_2020 is None and got[("A", False)].Total_2020 is None
    assert (got[(None, False)].Average_2019, got[(None, False)].Average_2020) == (5.0, 3.0)


def test_outer_merge_matches_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    got = {r.k: (r.a, r.b) for r in outer_merge(a, b, ["k"]).collect()}
    assert got == {"x": (1, None), None: (2, 3), "y": (None, 4)}


def test_csv_round_trip_quotes_commas_and_na(spark):
    df = spark.createDataFrame(
        [(2020, 'BOARD "OF", CORRECTION', "T", "ANN", "per Annum", "ACTIVE", 1.5, None), (2020, None, "T", "BOB", "per Annum", "ACTIVE", 2.0, -78.0)],
        "fiscal_year int, agency string, title string, first_name string, pay_basis string, leave_status string, base_salary double, total_ot_paid double",
    )
    path = scratch_path(spark, "test-csv")
    write_csv(df, path, single_file=True)
    back = files.read_payroll(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_literal_na_reads_as_null(spark, tmp_path):
    p = tmp_path / "pay.csv"
    p.write_text(
        "Fiscal Year,Agency Name,Title Description,First Name,Pay Basis,Leave Status as of June 30,Base Salary,Total OT Paid,Other\n"
        "2020,NA,CLERK,ANN,per Annum,ACTIVE,100.5,NA,x\n"
    )
    r = files.read_payroll(spark, str(p)).first()
    assert r.agency is None and r.total_ot_paid is None and r.base_salary == 100.5 and r.fiscal_year == 2020


def test_headerless_names(spark, tmp_path):
    (tmp_path / "NY.txt").write_text("NY,F,1910,Mary,295\nNY,M,1910,John,10\n")
    got = files.read_names(spark, str(tmp_path)).select(F.sum("count").alias("c")).first().c
    assert got == 305


def test_read_cpi_both_styles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("year,period,periodName,value,footnotes\n2020,M06,June,257.2,\n2020,M11,November,260.2,x\n")
    a = {(r.year, r.month): r.value for r in files.read_cpi(spark, str(tmp_path / "a.csv"), "month_name").collect()}
    assert a == {(2020, 6): 257.2, (2020, 11): 260.2}
    (tmp_path / "b.csv").write_text("period,U.S. city average - all items (badly encoded)\n2021-11,277.9\n")
    b = files.read_cpi(spark, str(tmp_path / "b.csv"), "period").first()
    assert (b.year, b.month, b.value) == (2021, 11, 277.9)


def test_payroll_headers_in_r_style(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(
        '"Fiscal.Year","Agency","Last.Name","First.Name","Title","Leave.Status.as.of.June.30","Base.Salary","Pay.Basis","Total.OT.Paid"\n'
        '2020,"POLICE","X","ANN","CLERK","ACTIVE",100.5,"per Annum",-78\n'
    )
    r = files.read_payroll(spark, str(p)).first()
    assert (r.fiscal_year, r.agency, r.title, r.first_name, r.pay_basis, r.leave_status, r.base_salary, r.total_ot_paid) == (
        2020, "POLICE", "CLERK", "ANN", "per Annum", "ACTIVE", 100.5, -78.0
    )


def test_payroll_missing_column_is_an_error(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("Fiscal Year,Agency Name\n2020,X\n")
    with pytest.raises(ValueError, match="title"):
        files.read_payroll(spark, str(p))


def _payroll_csv(spark, files_):
    """Writes CSV texts as files of one folder."""
    folder = scratch_path(spark, "payroll-texts")
    for i, text in enumerate(files_):
        spark.createDataFrame([(line,) for line in text], "value string").coalesce(1).write.text(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(len(files_))]


HEADER = "fiscal_year,agency,title,first_name,pay_basis,leave_status,base_salary,total_ot_paid"


def test_payroll_csv_keeps_blank_text(spark):
    (path,) = _payroll_csv(spark, [[HEADER, "2020,POLICE,,ANNA,per Annum,ACTIVE,10.5,", "2020,NA,CLERK,NA,per Annum,ACTIVE,NA,0"]])
    got = sorted(tuple(r) for r in files.read_payroll(spark, path).collect() if r.title == "")
    assert got == [(2020, "POLICE", "", "ANNA", "per Annum", "ACTIVE", 10.5, None)]
    other = files.read_payroll(spark, path).where("title = 'CLERK'").first()
    assert other.agency is None and other.first_name is None and other.base_salary is None


def test_payroll_csv_with_another_column_order_fails(spark):
    swapped = HEADER.replace("agency,title", "title,agency")
    paths = _payroll_csv(spark, [[HEADER, "2020,POLICE,CLERK,ANNA,per Annum,ACTIVE,1,1"], [swapped, "2020,CLERK,POLICE,ANNA,per Annum,ACTIVE,1,1"]])
    with pytest.raises(Exception, match="(?i)header"):  # from the task that reads the second file
        files.read_payroll(spark, paths).collect()


def test_wide_layout_refuses_two_rows_for_a_key_and_year(spark):
    long = spark.createDataFrame([(2020, "A", False, 1.0), (2020, "A", False, 2.0)], "fiscal_year int, key string, is_citywide boolean, x double")
    with pytest.raises(PySparkException, match="more than one row"):
        to_wide(long, "key", ["x"], [2020], "Agency").collect()

"""The command line writes every report of a profile as CSV."""

import glob
import os

import pytest

from helpers import SF0001
from wagelens import cli
from wagelens.session import scratch_path


def test_cli_writes_all_reports(spark):
    out = scratch_path(spark, "cli-out")
    cli.main(["--star", SF0001, "--profile", "star_v2022", "--out", out])
    out = out.removeprefix("file:")
    names = sorted(os.path.basename(p) for p in glob.glob(f"{out}/*.csv"))
    assert "Uncommon_Names_Agency.csv" in names
    assert "GenderGap_Title_2001_table.csv" in names and "Overtime_Agency_2001_chart.csv" in names
    assert "Uncommon_Names_Agency_chart.csv" in names and len(names) == 15
    lines = open(glob.glob(f"{out}/Overtime_Agency.csv/part-*.csv")[0]).read().splitlines()
    assert lines[0].startswith("Agency,Average_1995,Total_1995")
    assert lines[-1].startswith("CITY OF NEW YORK (ALL AGENCIES / TITLES),")
    assert os.path.isdir(f"{out}/baby_names.parquet")
    header = open(glob.glob(f"{out}/baby_names.csv/part-*.csv")[0]).readline().strip()
    assert header == "Name,F,M,M_weight,F_weight"


def _csv_rows(path):
    import csv

    part = glob.glob(f"{path}/part-*.csv")[0]
    with open(part, newline="") as fh:
        rows = list(csv.reader(fh))
    return rows[0], sorted(rows[1:])


@pytest.mark.parametrize("profile", ["v2020", "v2022"])
def test_cli_on_published_style_files_matches_star_reports(spark, profile):
    from wagelens import STAR_V2020, STAR_V2022, Inputs, ReportSuite
    from wagelens.sources import files, star
    from wagelens.sources.sinks import write_csv, write_reports

    base = scratch_path(spark, "published")
    published = {v: k for k, v in files.PAYROLL_SOURCE_NAMES.items()}
    write_csv(star.payroll(spark, SF0001).withColumnsRenamed(published), f"{base}/payroll")
    star.names(spark, SF0001).write.csv(f"{base}/names")  # headerless, like per-state name files
    cpi_rows = star.cpi_month_names(spark, SF0001) if profile == "v2020" else star.cpi_periods(spark, SF0001)
    write_csv(cpi_rows, f"{base}/cpi", single_file=True)
    cpi_file = glob.glob(f"{base.removeprefix('file:')}/cpi/part-*.csv")[0]

    out = scratch_path(spark, "cli-published")
    years, month, p = ("1995-2001", "6", STAR_V2020) if profile == "v2020" else ("1995-2001", "6", STAR_V2022)
    cli.main([
        "--payroll", f"{base}/payroll", "--names", f"{base}/names", "--cpi", cpi_file,
        "--profile", profile, "--years", years, "--cpi-month", month, "--out", out,
    ])
    # The same reports straight from the star tables (same years, month, rules for agencies).
    direct = ReportSuite(Inputs(star.payroll(spark, SF0001, p.years), star.names(spark, SF0001), star.cpi(spark, SF0001)), p)
    ref = scratch_path(spark, "direct")
    names = ["Overtime_Agency", "GenderGap_Agency"] + (["Uncommon_Names_Agency"] if profile == "v2022" else [])
    builders = {"Overtime_Agency": direct.overtime, "GenderGap_Agency": direct.gender_gap, "Uncommon_Names_Agency": direct.uncommon_names}
    write_reports({n: builders[n]("agency") for n in names}, ref, p.city_label)
    for name in names:
        a = _csv_rows(f"{out.removeprefix('file:')}/{name}.csv")
        b = _csv_rows(f"{ref.removeprefix('file:')}/{name}.csv")
        assert a == b, name


def test_cli_parquet_output(spark):
    out = scratch_path(spark, "cli-parquet")
    cli.main(["--star", SF0001, "--profile", "star_v2020", "--out", out, "--out-format", "parquet"])
    df = spark.read.parquet(f"{out}/Overtime_Agency.parquet")
    assert df.columns[:3] == ["Agency", "Average_1995", "Total_1995"]
    assert df.count() >= 1


def test_cli_long_tables(spark):
    out = scratch_path(spark, "cli-long")
    cli.main(["--star", SF0001, "--profile", "star_v2022", "--out", out, "--long"])
    df = spark.read.parquet(f"{out}/long_overtime_agency.parquet")
    assert {"fiscal_year", "key", "is_citywide", "n", "Average", "Total"} <= set(df.columns)
    assert df.where("is_citywide").select("fiscal_year").distinct().count() == 7
    assert spark.read.parquet(f"{out}/long_names_agency.parquet").count() >= 6

"""Command line: compute every report of a profile and write them as CSV.

    python -m wagelens.cli --payroll payroll.csv --names names/ --cpi cpi.csv \
        --profile v2022 --out reports/
    python -m wagelens.cli --star /root/testdata/sf0.1 --profile star_v2020 --out reports/

On a cluster, submit the same module with spark-submit; the session is taken as configured.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import STAR_V2020, STAR_V2022, V2020, V2022, Inputs, ReportSuite
from .sources import files, star
from .sources.sinks import write_parquet, write_reports

PROFILES = {p.name: p for p in (V2020, V2022, STAR_V2020, STAR_V2022)}


def parse_args(argv=None):
    ap = argparse.ArgumentParser(prog="wagelens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--payroll", help="payroll CSV (published header) or Parquet (canonical names)")
    src.add_argument("--star", help="folder of the generated star-schema test tables")
    ap.add_argument("--payroll-format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--names", help="folder or glob of headerless name files (state,sex,year,name,count)")
    ap.add_argument("--cpi", help="price-index CSV")
    ap.add_argument(
        "--cpi-style",
        choices=["period", "month_name"],
        help="price-index file layout (default: month names for v2020, YYYY-MM periods otherwise)",
    )
    ap.add_argument("--profile", choices=sorted(PROFILES), default="v2022")
    ap.add_argument("--years", help="first-last fiscal years, e.g. 2014-2021 (default: the profile's)")
    ap.add_argument("--cpi-month", type=int)
    ap.add_argument("--city-scope", choices=["all", "kept"])
    ap.add_argument("--min-group-agency", type=int, help="show an agency only with more rows than this (default 200)")
    ap.add_argument("--min-group-title", type=int, help="show a title only with more rows than this (default 200)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--out-format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--publish", action="store_true", help="write a new version of the output folder that becomes current when all reports are written")
    ap.add_argument("--lenient-nulls", action="store_true", help="leave missing amounts out of means and totals instead of making them missing")
    ap.add_argument("--long", action="store_true", help="also write the numeric long tables as Parquet, by fiscal year")
    return ap.parse_args(argv)


def main(argv=None) -> None:
    args = parse_args(argv)
    profile = PROFILES[args.profile]
    changes = {}
    if args.years:
        lo, hi = (int(x) for x in args.years.split("-"))
        changes["years"] = tuple(range(lo, hi + 1))
    if args.cpi_month:
        changes["cpi_month"] = args.cpi_month
    if args.city_scope:
        changes["city_scope"] = args.city_scope
    if args.min_group_agency is not None:
        changes["min_group_agency"] = args.min_group_agency
    if args.min_group_title is not None:
        changes["min_group_title"] = args.min_group_title
    if args.lenient_nulls:
        changes["strict_nulls"] = False
    if changes:
        profile = profile.with_(**changes)

    spark = SparkSession.builder.appName("wagelens").config("spark.ui.enabled", "false").getOrCreate()
    if args.star:
        inputs = Inputs(
            star.payroll(spark, args.star, profile.years),
            star.names(spark, args.star),
            star.cpi(spark, args.star),
        )
    else:
        if not (args.names and args.cpi):
            raise SystemExit("--names and --cpi are required with --payroll")
        inputs = Inputs(
            files.read_payroll(spark, args.payroll, args.payroll_format),
            files.read_names(spark, args.names),
            files.read_cpi(spark, args.cpi, args.cpi_style or ("month_name" if profile.name == "v2020" else "period")),
        )
    suite = ReportSuite(inputs, profile, keep_cube=True).prepare()
    for path in write_reports(suite.report_builders(), args.out, profile.city_label, fmt=args.out_format, publish=args.publish):
        print(path)
    if args.long:
        for name, df in suite.long_tables().items():
            path = f"{args.out.rstrip('/')}/{name}.parquet"
            write_parquet(df, path, partition_by=["fiscal_year"])
            print(path)


if __name__ == "__main__":
    main()

"""Registered queries: one per operator and per report, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the generated test tables through the star adapter, over whole tables.
Columns that are weighted sums (order-dependent floating point) are rounded -- means to cents, sums
to 4 and weights to 6 places -- so that results are comparable between engines; plain sums of money
are exact and left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import gap
from ..functions.text import percent_text, with_dollar_texts
from ..operators.adjust import index_values, restate_columns
from ..operators.aggregates import group_mean, group_sum, measure_cube, rollup, weighted_mean
from ..operators.filters import eligible, group_size_having, group_size_keep_rows
from ..operators.joins import outer_merge, outer_merge_all
from ..operators.names import (
    UNMATCHED_DROP,
    UNMATCHED_KEEP,
    UNMATCHED_ZERO,
    attach_weights,
    name_sex_counts,
    name_spread,
    name_weights,
    weights_from_spread,
)
from ..operators.reshape import distinct_keys, to_wide
from ..session import scratch_path
from ..sources import files, star
from ..sources.sinks import published_reports, write_csv, write_parquet, write_reports, write_sorted_parts
from .profiles import STAR_V2020, STAR_V2022, Profile, passing
from .reports import Inputs, ReportSuite, measures

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items() if c in df.columns})


def _inputs(spark: SparkSession, sf_dir: str, profile: Profile) -> Inputs:
    return Inputs(
        payroll=star.payroll(spark, sf_dir, profile.years),
        names=star.names(spark, sf_dir),
        cpi=star.cpi(spark, sf_dir),
    )


def _suite(spark: SparkSession, sf_dir: str, profile: Profile = STAR_V2020) -> ReportSuite:
    return ReportSuite(_inputs(spark, sf_dir, profile), profile)


def _eligible(spark: SparkSession, sf_dir: str, profile: Profile = STAR_V2020) -> DataFrame:
    return eligible(star.payroll(spark, sf_dir, profile.years), profile.years)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_weights(star.names(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str, profile: Profile = STAR_V2020) -> DataFrame:
    return attach_weights(_eligible(spark, sf_dir, profile), _weights(spark, sf_dir), UNMATCHED_DROP)


# -- names ------------------------------------------------------------------------------------


def q_name_sex_counts(spark, sf_dir):
    """Registrations per upper-cased name and sex."""
    return name_sex_counts(star.names(spark, sf_dir))


def q_name_spread(spark, sf_dir):
    """Sexes spread into F and M columns, missing as 0 (A10, P5)."""
    return name_spread(name_sex_counts(star.names(spark, sf_dir)))


def q_name_spread_one_sex(spark, sf_dir):
    """The spread of names that are registered for one sex only: the other counts 0 (A10, P5)."""
    return name_spread(name_sex_counts(star.names(spark, sf_dir, by_segment=True)))


def q_name_weights(spark, sf_dir):
    """Name weights from registrations in one aggregate."""
    return _weights(spark, sf_dir)


def q_name_weights_from_spread(spark, sf_dir):
    """R0 through the explicit counts -> spread -> weights path."""
    return weights_from_spread(name_spread(name_sex_counts(star.names(spark, sf_dir))))


# -- lookup -----------------------------------------------------------------------------------

_LOOKUP_COLS = ["fiscal_year", "agency", "title", "first_name", "base_salary"]


def q_lookup_left(spark, sf_dir):
    """Plain lookup of every payroll row; unmatched keep NULL weights."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_KEEP)


def q_lookup_matched_only(spark, sf_dir):
    """Lookup keeping matched rows only."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_DROP)


def q_lookup_left_shuffle(spark, sf_dir):
    """J1 with weights too large to broadcast: hot and NULL names stay in place, the rest is shuffled."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_KEEP, max_broadcast_rows=0)


def q_lookup_matched_only_shuffle(spark, sf_dir):
    """J2 with weights too large to broadcast."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_DROP, max_broadcast_rows=0)


def q_common_flags(spark, sf_dir):
    """Common / Uncommon flags of the second profile."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_ZERO).drop("Male", "Female")


def q_zero_fill_weights(spark, sf_dir):
    """Unmatched weights set to 0."""
    rows = star.payroll(spark, sf_dir).select(*_LOOKUP_COLS)
    return attach_weights(rows, _weights(spark, sf_dir), UNMATCHED_ZERO).drop("Common", "Uncommon")


# -- filters and plain aggregates ------------------------------------------------------------


def q_eligible_filter(spark, sf_dir):
    """Annual, active employees of the profile years (F1)."""
    return _eligible(spark, sf_dir)


def q_group_mean(spark, sf_dir):
    """Mean base salary per year and agency, exact sums, NULL rule."""
    return group_mean(_eligible(spark, sf_dir), ["fiscal_year", "agency"], "base_salary", "avg_salary")


def q_group_sum(spark, sf_dir):
    """Total overtime per year and agency (A5)."""
    return group_sum(_eligible(spark, sf_dir), ["fiscal_year", "agency"], "total_ot_paid", "total_ot")


def q_weighted_mean(spark, sf_dir):
    """Male-weighted mean salary per year and agency (A4)."""
    df = weighted_mean(_matched(spark, sf_dir), ["fiscal_year", "agency"], "base_salary", "Male", "male_avg_salary")
    return _round(df, {"male_avg_salary": 2})


def q_group_size_having(spark, sf_dir):
    """Year-title groups with more than the threshold of rows (F4, aggregate form)."""
    return group_size_having(_matched(spark, sf_dir), ["fiscal_year", "title"], STAR_V2020.min_group_title)


def q_group_size_keep_rows(spark, sf_dir):
    """Rows of year-agency groups over the threshold (F4, row form, semi-join)."""
    return group_size_keep_rows(_eligible(spark, sf_dir), ["fiscal_year", "agency"], STAR_V2020.min_group_agency)


# -- cube -------------------------------------------------------------------------------------

_CUBE_ROUND = {"w_m": 6, "w_f": 6, "wv_m": 6, "wv_f": 6, "xw_m": 4, "xw_f": 4}


def _cube_rows(cube: DataFrame) -> DataFrame:
    """The cube with its exact money sums as doubles."""
    return _round(cube.withColumns({c: F.col(c).cast("double") for c in ("salary_sum", "ot_sum", "xw_c", "xw_u")}), _CUBE_ROUND)


def q_measure_cube(spark, sf_dir):
    """The measure cube, broadcast lookup path."""
    cube = measure_cube(_eligible(spark, sf_dir), _weights(spark, sf_dir), UNMATCHED_DROP)
    return _cube_rows(cube)


def q_measure_cube_shuffle(spark, sf_dir):
    """The same cube through the path for weights too large to broadcast (pre-aggregate, shuffle join)."""
    cube = measure_cube(_eligible(spark, sf_dir), _weights(spark, sf_dir), UNMATCHED_DROP, max_broadcast_rows=0)
    return _cube_rows(cube)


def q_measure_cube_uncommon(spark, sf_dir):
    """The measure cube of the second profile (unmatched kept)."""
    p = STAR_V2022
    cube = measure_cube(_eligible(spark, sf_dir, p), _weights(spark, sf_dir), UNMATCHED_ZERO)
    return _cube_rows(cube)


def _streamed(spark, sf_dir, profile, write, fmt="parquet"):
    """The cube after payroll files have landed in two rounds; ``write(round, rows, folder)`` lands one."""
    from ..streaming.cube_stream import read_cube, read_payroll_stream, start_cube_upkeep

    payroll = star.payroll(spark, sf_dir, profile.years)
    landing, cube_path, ckpt = (scratch_path(spark, n) for n in ("landing", "stream-cube", "stream-ckpt"))
    middle = profile.years[len(profile.years) // 2]
    for i, part in enumerate((payroll.where(F.col("fiscal_year") < middle), payroll.where(F.col("fiscal_year") >= middle))):
        write(i, part, f"{landing}/round={i}")
        start_cube_upkeep(read_payroll_stream(spark, f"{landing}/*", fmt), _weights(spark, sf_dir), profile, cube_path, ckpt).awaitTermination()
    return _cube_rows(read_cube(spark, cube_path))


def q_streaming_cube(spark, sf_dir):
    """The cube kept up to date by the streaming job while payroll files land in two rounds."""
    return _streamed(spark, sf_dir, STAR_V2020, lambda i, rows, folder: rows.write.parquet(folder))


def q_streaming_cube_shuffle(spark, sf_dir):
    """The same with weights too large to broadcast: each batch is summed per name before the lookup."""
    return _streamed(spark, sf_dir, STAR_V2020.with_(max_broadcast_rows=0), lambda i, rows, folder: rows.write.parquet(folder))


def q_streaming_cube_csv(spark, sf_dir):
    """The same from CSV files with the published header, whose columns stand in another order in the second round."""
    published = {v: k for k, v in files.PAYROLL_SOURCE_NAMES.items()}

    def write(i, rows, folder):
        rows = rows.withColumnsRenamed(published).withColumn("Payroll Number", F.lit("x"))
        write_csv(rows.select(*(reversed(rows.columns) if i else rows.columns)), folder)

    return _streamed(spark, sf_dir, STAR_V2020, write, "csv")


def q_append_citywide(spark, sf_dir):
    """Per-agency overtime rows plus one citywide row per year."""
    s = _suite(spark, sf_dir)
    rolled = rollup(s.cube(), "agency", city_label=STAR_V2020.city_label)
    return measures(rolled, "overtime").withColumnRenamed("key", "agency")


# -- price index ------------------------------------------------------------------------------


def q_cpi_parse_period(spark, sf_dir):
    """A price-index CSV with 'YYYY-MM' texts, read by position and split into numbers."""
    path = scratch_path(spark, "cpi-periods")
    write_csv(star.cpi_periods(spark, sf_dir), path)
    return files.read_cpi(spark, path, style="period")


def q_cpi_month_names(spark, sf_dir):
    """A price-index CSV with month names, mapped to numbers (S3)."""
    path = scratch_path(spark, "cpi-months")
    write_csv(star.cpi_month_names(spark, sf_dir), path)
    return files.read_cpi(spark, path, style="month_name")


def q_cpi_two_layouts(spark, sf_dir):
    """Price-index files whose columns stand in different orders, each read by its own header (S3)."""
    path = scratch_path(spark, "cpi-layouts")
    rows = star.cpi_month_names(spark, sf_dir)
    early = F.col("year") < STAR_V2020.base_year
    write_csv(rows.where(early), f"{path}/early")
    write_csv(rows.where(~early).select("value", F.lit("M").alias("period"), "periodName", "year"), f"{path}/late")
    return files.read_cpi(spark, f"{path}/*", style="month_name")


def q_names_csv_source(spark, sf_dir):
    """Headerless name-registration files, columns by position (S2, P2), summed per name and sex."""
    path = scratch_path(spark, "names-csv")
    star.names(spark, sf_dir).write.csv(path, header=False)
    return name_sex_counts(files.read_names(spark, path))


def q_cpi_factor(spark, sf_dir):
    """Per-year and base-year index values, checked unique."""
    p = STAR_V2020
    return index_values(star.cpi(spark, sf_dir), p.years, p.cpi_month, p.base_year)


def q_restate_money(spark, sf_dir):
    """Mean salary restated in base-year money."""
    means = group_mean(_eligible(spark, sf_dir), ["fiscal_year", "agency"], "base_salary", "avg_salary")
    return restate_columns(means, q_cpi_factor(spark, sf_dir), ["avg_salary"])


# -- gap and texts ----------------------------------------------------------------------------


def _gender_long(spark, sf_dir):
    s = _suite(spark, sf_dir)
    return measures(rollup(s.cube(), "agency", city_label=STAR_V2020.city_label), "gender")


def q_gap_ratio(spark, sf_dir):
    """(M - F) / (M + F) per year and agency."""
    df = _gender_long(spark, sf_dir).select(
        "fiscal_year", F.col("key").alias("agency"), "is_citywide", gap(F.col("Male"), F.col("Female")).alias("gap")
    )
    return _round(df, {"gap": 6})


def q_fmt_percent(spark, sf_dir):
    """Gap as percent text with one decimal."""
    return _gender_long(spark, sf_dir).select(
        "fiscal_year", F.col("key").alias("agency"), "is_citywide",
        percent_text(gap(F.col("Male"), F.col("Female"))).alias("gap_text"),
    )


def q_fmt_dollar(spark, sf_dir):
    """Overtime as dollar text, cents chosen per year column."""
    s = _suite(spark, sf_dir)
    long = measures(rollup(s.cube(), "title", city_label=STAR_V2020.city_label), "overtime")
    texts = with_dollar_texts(long, ["Average", "Total"], by=["fiscal_year"])
    return texts.select("fiscal_year", F.col("key").alias("title"), "is_citywide", "Average", "Total")


# -- reshaping --------------------------------------------------------------------------------


def q_pivot_years_wide(spark, sf_dir):
    """Years side by side, Average_<year> columns."""
    p = STAR_V2020
    means = group_mean(_eligible(spark, sf_dir), ["fiscal_year", "agency"], "base_salary", "Average")
    return to_wide(means, "agency", ["Average"], p.years, "Agency", extra_keys=())


def q_outer_merge_two_years(spark, sf_dir):
    """NULL-safe full outer merge of two years' title groups."""
    p = STAR_V2020
    sizes = group_size_having(_matched(spark, sf_dir), ["fiscal_year", "title"], p.min_group_title)
    first = sizes.where(F.col("fiscal_year") == min(p.years)).select("title", F.col("n").alias("n_first"))
    last = sizes.where(F.col("fiscal_year") == max(p.years)).select("title", F.col("n").alias("n_last"))
    return outer_merge(first, last, ["title"])


def q_outer_merge_years(spark, sf_dir):
    """NULL-safe full outer merge of every year's title groups in one exchange, one row per key checked."""
    p = STAR_V2020
    sizes = group_size_having(_matched(spark, sf_dir), ["fiscal_year", "title"], p.min_group_title)
    return outer_merge_all([sizes.where(F.col("fiscal_year") == y).select("title", F.col("n").alias(f"n_{y}")) for y in p.years], ["title"])


def q_distinct_keys(spark, sf_dir):
    """Distinct agencies of the latest year."""
    p = STAR_V2020
    return distinct_keys(_eligible(spark, sf_dir).where(F.col("fiscal_year") == p.base_year), "agency")


# -- sink / source round trip -----------------------------------------------------------------


def q_csv_round_trip(spark, sf_dir):
    """Eligible rows written as CSV and read back."""
    path = scratch_path(spark, "csv-round-trip")
    write_csv(_eligible(spark, sf_dir), path)
    return files.read_payroll(spark, path)


def q_payroll_csv_source(spark, sf_dir):
    """Payroll written with the published header names, read back through the source mapping."""
    path = scratch_path(spark, "payroll-csv")
    published = {v: k for k, v in files.PAYROLL_SOURCE_NAMES.items()}
    rows = star.payroll(spark, sf_dir).withColumnsRenamed(published).withColumn("Payroll Number", F.lit("x"))
    write_csv(rows, path)
    return files.read_payroll(spark, path)


def q_payroll_partitioned(spark, sf_dir):
    """Payroll stored by fiscal year; the eligibility filter then prunes year folders."""
    path = scratch_path(spark, "payroll-by-year")
    files.store_payroll(star.payroll(spark, sf_dir), path)
    return eligible(files.read_stored_payroll(spark, path), STAR_V2020.years)


def q_name_weights_export(spark, sf_dir):
    """R0 written as Parquet and read back (K2)."""
    path = scratch_path(spark, "baby-names")
    write_parquet(_weights(spark, sf_dir), path)
    return spark.read.parquet(path)


def q_name_weights_csv_parts(spark, sf_dir):
    """R0 written as several sorted CSV parts with a manifest and read back (K2)."""
    path = scratch_path(spark, "baby-names-csv")
    weights = _weights(spark, sf_dir)
    write_sorted_parts(weights, path, "name", rows_per_part=10)
    return spark.read.schema(weights.schema).csv(path, header=True, nullValue="NA", escape='"', enforceSchema=False)


def q_reports_published(spark, sf_dir):
    """A report published twice as a whole; the current version is read back (K1)."""
    path = scratch_path(spark, "published")
    suite = _suite(spark, sf_dir)
    for _ in range(2):
        write_reports({"Overtime_Agency": suite.overtime("agency")}, path, STAR_V2020.city_label, publish=True)
    return spark.read.csv(f"{published_reports(spark, path)}/Overtime_Agency.csv", header=True, nullValue="NA", escape='"')


# -- reports ----------------------------------------------------------------------------------

_GENDER_ROUND = {f"{m}_{y}": 2 for m in ("Male", "Female") for y in range(1990, 2030)}


def q_gender_gap_agency(spark, sf_dir):
    """Gender gap by agency, years side by side."""
    return _round(_suite(spark, sf_dir).gender_gap("agency"), _GENDER_ROUND)


def q_gender_gap_agency_chart(spark, sf_dir):
    """R2: as R1, agencies over the threshold."""
    return _round(_suite(spark, sf_dir).gender_gap_chart("agency"), _GENDER_ROUND)


def q_gender_gap_agency_table(spark, sf_dir):
    """Latest-year table by agency, dollar and percent text."""
    return _suite(spark, sf_dir).gender_gap_table("agency")


def q_gender_gap_title(spark, sf_dir):
    """Gender gap by title."""
    return _round(_suite(spark, sf_dir).gender_gap("title"), _GENDER_ROUND)


def q_gender_gap_title_chart(spark, sf_dir):
    """As R4, titles over the threshold."""
    return _round(_suite(spark, sf_dir).gender_gap_chart("title"), _GENDER_ROUND)


def q_gender_gap_title_table(spark, sf_dir):
    """Latest-year table by title."""
    return _suite(spark, sf_dir).gender_gap_table("title")


def q_overtime_agency(spark, sf_dir):
    """Overtime by agency, years side by side, dollar text."""
    return _suite(spark, sf_dir).overtime("agency")


def q_overtime_agency_chart(spark, sf_dir):
    """As R7, agencies over the threshold."""
    return _suite(spark, sf_dir).overtime_chart("agency")


def q_overtime_agency_latest(spark, sf_dir):
    """Latest-year overtime by agency."""
    return _suite(spark, sf_dir).overtime_latest("agency")


def q_overtime_title(spark, sf_dir):
    """Overtime by title."""
    return _suite(spark, sf_dir).overtime("title")


def q_overtime_title_chart(spark, sf_dir):
    """As R10, titles over the threshold."""
    return _suite(spark, sf_dir).overtime_chart("title")


def q_overtime_title_latest(spark, sf_dir):
    """Latest-year overtime by title."""
    return _suite(spark, sf_dir).overtime_latest("title")


def q_uncommon_names_agency(spark, sf_dir):
    """Pay by common vs uncommon names, by agency (second profile)."""
    return _suite(spark, sf_dir, STAR_V2022).uncommon_names("agency")


def q_gender_gap_agency_v2022(spark, sf_dir):
    """R1 under the second profile (unmatched kept with zero weights)."""
    return _round(_suite(spark, sf_dir, STAR_V2022).gender_gap("agency"), _GENDER_ROUND)


def q_overtime_agency_v2022(spark, sf_dir):
    """R7 under the second profile (unmatched employees counted)."""
    return _suite(spark, sf_dir, STAR_V2022).overtime("agency")


def q_gender_gap_title_table_v2022(spark, sf_dir):
    """R6 under the second profile."""
    return _suite(spark, sf_dir, STAR_V2022).gender_gap_table("title")


def q_overtime_title_chart_kept(spark, sf_dir):
    """R11 with the citywide row taken after the threshold."""
    p = STAR_V2020.with_(city_scope="kept")
    return ReportSuite(_inputs(spark, sf_dir, p), p).overtime_chart("title")


def q_uncommon_names_agency_chart(spark, sf_dir):
    """R13 for agencies over the threshold only."""
    return _suite(spark, sf_dir, STAR_V2022).uncommon_names_chart("agency")


def q_gender_gap_agency_table_passing(spark, sf_dir):
    """R3 with a threshold that many agencies of the last year pass."""
    return _suite(spark, sf_dir, passing(STAR_V2020)).gender_gap_table("agency")


def q_overtime_agency_latest_passing(spark, sf_dir):
    """R9 with a threshold that many agencies of the last year pass."""
    return _suite(spark, sf_dir, passing(STAR_V2020)).overtime_latest("agency")


def _suite_missing(spark, sf_dir, profile):
    """Reports over a payroll with missing amounts: no salary where no overtime was paid, no overtime below a salary."""
    inputs = _inputs(spark, sf_dir, profile)
    salary, overtime = F.col("base_salary"), F.col("total_ot_paid")
    inputs.payroll = inputs.payroll.withColumns({"base_salary": F.when(overtime != 0, salary), "total_ot_paid": F.when(salary >= 2000, overtime)})
    return ReportSuite(inputs, profile)


def q_gender_gap_agency_missing(spark, sf_dir):
    """R1 over a payroll with missing amounts: a group with one has no mean."""
    return _round(_suite_missing(spark, sf_dir, STAR_V2020).gender_gap("agency"), _GENDER_ROUND)


def q_gender_gap_agency_lenient(spark, sf_dir):
    """R1 over the same payroll, missing amounts left out with their weights (N1, lenient)."""
    return _round(_suite_missing(spark, sf_dir, STAR_V2020.with_(strict_nulls=False)).gender_gap("agency"), _GENDER_ROUND)


def q_overtime_title_lenient(spark, sf_dir):
    """R10 over the same payroll, missing amounts left out (N1, lenient)."""
    return _suite_missing(spark, sf_dir, STAR_V2020.with_(strict_nulls=False)).overtime("title")


def q_uncommon_names_agency_lenient(spark, sf_dir):
    """R13 over the same payroll, missing amounts left out (N1, lenient)."""
    return _suite_missing(spark, sf_dir, STAR_V2022.with_(strict_nulls=False)).uncommon_names("agency")


QUERIES: dict[str, Query] = {
    "name_sex_counts": q_name_sex_counts,
    "name_spread": q_name_spread,
    "name_weights": q_name_weights,
    "name_weights_from_spread": q_name_weights_from_spread,
    "lookup_left": q_lookup_left,
    "lookup_matched_only": q_lookup_matched_only,
    "common_flags": q_common_flags,
    "zero_fill_weights": q_zero_fill_weights,
    "eligible_filter": q_eligible_filter,
    "group_mean": q_group_mean,
    "group_sum": q_group_sum,
    "weighted_mean": q_weighted_mean,
    "group_size_having": q_group_size_having,
    "group_size_keep_rows": q_group_size_keep_rows,
    "measure_cube": q_measure_cube,
    "measure_cube_shuffle": q_measure_cube_shuffle,
    "measure_cube_uncommon": q_measure_cube_uncommon,
    "streaming_cube": q_streaming_cube,
    "append_citywide": q_append_citywide,
    "cpi_parse_period": q_cpi_parse_period,
    "cpi_month_names": q_cpi_month_names,
    "names_csv_source": q_names_csv_source,
    "cpi_factor": q_cpi_factor,
    "restate_money": q_restate_money,
    "gap_ratio": q_gap_ratio,
    "fmt_percent": q_fmt_percent,
    "fmt_dollar": q_fmt_dollar,
    "pivot_years_wide": q_pivot_years_wide,
    "outer_merge_two_years": q_outer_merge_two_years,
    "distinct_keys": q_distinct_keys,
    "csv_round_trip": q_csv_round_trip,
    "payroll_csv_source": q_payroll_csv_source,
    "name_weights_export": q_name_weights_export,
    "payroll_partitioned": q_payroll_partitioned,
    "gender_gap_agency": q_gender_gap_agency,
    "gender_gap_agency_chart": q_gender_gap_agency_chart,
    "gender_gap_agency_table": q_gender_gap_agency_table,
    "gender_gap_title": q_gender_gap_title,
    "gender_gap_title_chart": q_gender_gap_title_chart,
    "gender_gap_title_table": q_gender_gap_title_table,
    "overtime_agency": q_overtime_agency,
    "overtime_agency_chart": q_overtime_agency_chart,
    "overtime_agency_latest": q_overtime_agency_latest,
    "overtime_title": q_overtime_title,
    "overtime_title_chart": q_overtime_title_chart,
    "overtime_title_latest": q_overtime_title_latest,
    "uncommon_names_agency": q_uncommon_names_agency,
    "gender_gap_agency_v2022": q_gender_gap_agency_v2022,
    "overtime_agency_v2022": q_overtime_agency_v2022,
    "gender_gap_title_table_v2022": q_gender_gap_title_table_v2022,
    "overtime_title_chart_kept": q_overtime_title_chart_kept,
    "lookup_left_shuffle": q_lookup_left_shuffle,
    "lookup_matched_only_shuffle": q_lookup_matched_only_shuffle,
    "name_spread_one_sex": q_name_spread_one_sex,
    "streaming_cube_shuffle": q_streaming_cube_shuffle,
    "streaming_cube_csv": q_streaming_cube_csv,
    "cpi_two_layouts": q_cpi_two_layouts,
    "outer_merge_years": q_outer_merge_years,
    "name_weights_csv_parts": q_name_weights_csv_parts,
    "reports_published": q_reports_published,
    "uncommon_names_agency_chart": q_uncommon_names_agency_chart,
    "gender_gap_agency_table_passing": q_gender_gap_agency_table_passing,
    "overtime_agency_latest_passing": q_overtime_agency_latest_passing,
    "gender_gap_agency_missing": q_gender_gap_agency_missing,
    "gender_gap_agency_lenient": q_gender_gap_agency_lenient,
    "overtime_title_lenient": q_overtime_title_lenient,
    "uncommon_names_agency_lenient": q_uncommon_names_agency_lenient,
}

"""Hot names in the lookup, files read by header, checked merges, sorted exports and published folders."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import SF0001, by, payroll
from wagelens import STAR_V2020, Inputs, ReportSuite
from wagelens.operators.joins import outer_merge, outer_merge_all
from wagelens.operators.names import UNMATCHED_DROP, UNMATCHED_KEEP, UNMATCHED_ZERO, attach_weights, hot_names, join_weights_split, weight_lookup
from wagelens.plans import catalog
from wagelens.plans.profiles import V2020
from wagelens.session import scratch_path
from wagelens.sources import files, star, versions
from wagelens.sources.sinks import published_reports, read_manifest, unsorted_parts, write_reports, write_sorted_parts


@pytest.fixture
def skewed(spark):
    """30,000 rows: a third on one name, a third without a name, the rest over 2,000 names; and weights of most names."""
    rows = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, F.concat(F.lit("N"), (F.col("id") * 7919 % 2000).cast("string"))).alias("first_name")
    )
    weights = spark.range(1900).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"), F.lit(0.25).alias("M_weight"), F.lit(0.75).alias("F_weight"))
    return rows, weights.unionByName(spark.createDataFrame([("HOT", 0.9, 0.1)], "name string, M_weight double, F_weight double"))


@pytest.mark.parametrize("unmatched", [UNMATCHED_KEEP, UNMATCHED_DROP, UNMATCHED_ZERO])
def test_split_lookup_equals_broadcast(spark, skewed, unmatched):
    rows, weights = skewed
    want = attach_weights(rows, weights, unmatched)
    got = attach_weights(rows, weights, unmatched, max_broadcast_rows=0)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_and_null_names_are_not_shuffled(spark, skewed):
    rows, weights = skewed
    assert hot_names(rows) == ["HOT"]
    assert hot_names(rows.limit(0)) == []
    lookup, small = weight_lookup(weights, 0)
    assert not small
    # Rows of each task of the name shuffle: only those of names that are neither hot nor NULL.
    moved = rows.where(F.col("first_name").isNotNull() & (F.col("first_name") != "HOT"))
    sizes = [r.n for r in moved.repartition(8, "first_name").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    plan = join_weights_split(rows, lookup, UNMATCHED_KEEP, "first_name", ["HOT"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("strategy=broadcast") == 1 and plan.count("strategy=merge") == 1


def test_merge_of_many_tables(spark):
    sides = [spark.createDataFrame(rows, f"k string, j int, v{i} long") for i, rows in enumerate([[("a", 1, 10), (None, 1, 11)], [("a", 1, 20), ("b", None, 21)], [(None, 1, 32), ("b", None, None)]])]
    got = {(r.k, r.j): (r.v0, r.v1, r.v2) for r in outer_merge_all(sides, ["k", "j"]).collect()}
    assert got == {("a", 1): (10, 20, None), (None, 1): (11, None, 32), ("b", None): (None, 21, None)}
    plan = outer_merge_all(sides, ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(ValueError, match="more than one side"):
        outer_merge(sides[0], sides[0], ["k", "j"])


@pytest.mark.parametrize("key", ["a", None])
def test_repeated_keys_are_an_error(spark, key):
    left = spark.createDataFrame([(key, 1), (key, 2)], "k string, a long")
    right = spark.createDataFrame([("b", 1)], "k string, b long")
    for sides in ((left, right), (right, left)):
        with pytest.raises(Exception, match=f"outer_merge: more than one row for k={key or 'NULL'} on side {sides.index(left)}"):
            outer_merge(*sides, ["k"]).collect()
        with pytest.raises(Exception, match="more than one row"):
            outer_merge(*sides, ["k"]).select("k").collect()


def write(folder, **texts):
    folder = folder.removeprefix("file:")
    os.makedirs(folder)
    for name, text in texts.items():
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def test_price_index_files_with_different_headers(spark):
    folder = write(
        scratch_path(spark, "cpi"),
        a="year,period,periodName,value,footnotes\n2014,M06,June,237.5,\n2015,M06,June,238.1,\"a, b\"\n",
        b="\ufeffvalue,periodName,year\n240.9,June,2016\n\n,July,2016\nNA,August,2016\n",
        c="year,period,periodName,value,footnotes\n",
    )
    got = {(r.year, r.month): r.value for r in files.read_cpi(spark, folder, style="month_name").collect()}
    assert got == {(2014, 6): 237.5, (2015, 6): 238.1, (2016, 6): 240.9, (2016, 7): None, (2016, 8): None}


def test_price_index_header_errors(spark):
    with pytest.raises(ValueError, match="no column for 'value'"):
        files.read_cpi(spark, write(scratch_path(spark, "cpi"), a="year,periodName\n2014,June\n"), style="month_name")
    with pytest.raises(ValueError, match="more than one column for 'year'"):
        files.read_cpi(spark, write(scratch_path(spark, "cpi"), a="year,year,periodName,value\n2014,2014,June,1\n"), style="month_name")
    short = write(scratch_path(spark, "cpi"), a="year,periodName,value\n2014,June\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_cpi(spark, short, style="month_name").collect()
    assert files.read_cpi(spark, write(scratch_path(spark, "cpi"), a=""), style="month_name").collect() == []


def test_payroll_lines_equal_the_csv_reader(spark):
    rows = catalog._eligible(spark, SF0001).limit(300)
    path = scratch_path(spark, "payroll")
    published = {v: k for k, v in files.PAYROLL_SOURCE_NAMES.items()}
    odd = payroll(spark, [(2000, 'A, "B"', None, "", None, 1.5), (2000, "NA", "x", "É", 2.5, None)])
    rows.unionByName(odd).withColumnsRenamed(published).write.csv(path, header=True, nullValue="NA", escape='"')
    one, two = files.read_payroll(spark, path), files.payroll_from_lines(files.with_places(spark.read.text(path)))
    assert one.schema == two.schema and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_sorted_export(spark):
    path = scratch_path(spark, "export")
    names = spark.range(1_000_000).select(F.concat(F.lit("N"), F.hash("id").cast("string"), F.lit("-"), F.col("id").cast("string")).alias("Name"), F.col("id").alias("F"))
    write_sorted_parts(names, path, "Name", rows_per_part=150_000)
    manifest = sorted(read_manifest(spark, path).collect(), key=lambda r: r.file)
    assert len(manifest) >= 6 and sum(r.rows for r in manifest) == 1_000_000 and max(r.rows for r in manifest) < 400_000
    assert unsorted_parts(spark, path) == []
    back = spark.read.csv(path, header=True)
    assert back.count() == 1_000_000 and back.select("Name").distinct().count() == 1_000_000
    first = spark.read.csv(f"{path}/{manifest[0].file}", header=True)
    keys = [r.Name for r in first.limit(1000).collect()]
    assert keys == sorted(keys) and keys[0] == manifest[0].first_key


def test_readers_see_whole_reports(spark):
    out = scratch_path(spark, "published")
    suite = ReportSuite(Inputs(star.payroll(spark, SF0001), star.names(spark, SF0001), star.cpi(spark, SF0001)), STAR_V2020).prepare()
    reports = {"Overtime_Agency": lambda: suite.overtime("agency"), "baby_names": suite.weights}

    def read():
        return spark.read.csv(f"{published_reports(spark, out)}/Overtime_Agency.csv", header=True)

    with pytest.raises(FileNotFoundError):
        published_reports(spark, out)
    paths = write_reports(reports, out, STAR_V2020.city_label, publish=True)
    assert sorted(os.path.basename(p) for p in paths) == ["Overtime_Agency.csv", "baby_names.csv"]
    whole = read().count()
    held = read()  # a reader that goes on while the reports are replaced

    def fail():
        assert read().count() == whole  # during the rewrite the old reports stand
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        write_reports({**reports, "zz": fail}, out, STAR_V2020.city_label, parallelism=1, publish=True)
    assert versions.current(spark, out) == 0 and read().count() == whole
    write_reports(reports, out, STAR_V2020.city_label, publish=True)
    assert versions.current(spark, out) == 1 and read().count() == whole and held.count() == whole
    write_reports(reports, out, STAR_V2020.city_label, publish=True)
    assert versions.committed(spark, out) == [1, 2]


def test_lenient_nulls(spark):
    rows = payroll(spark, [(2020, "A", "t", "ANN", 100, 10), (2020, "A", "t", "BOB", None, None), (2020, "A", "t", "BOB", 50, 4), (2020, "B", "t", "ANN", None, None)])
    names = spark.createDataFrame([("NY", "F", 0, "Ann", 3), ("NY", "M", 0, "Ann", 1), ("NY", "M", 0, "Bob", 1)], "state string, sex string, year int, name string, count long")
    cpi = spark.createDataFrame([(2020, 6, 1.0)], "year int, month int, value double")
    strict, lenient = (ReportSuite(Inputs(rows, names, cpi), V2020.with_(years=(2020,), strict_nulls=x)) for x in (True, False))
    pay = lambda s: {k: (r["Average"], r["Male"], r["Female"]) for k, r in by(s.long("gender", "agency", False, restated=False), "key").items() if not r["is_citywide"]}
    overtime = lambda s: {k: (r["Average"], r["Total"]) for k, r in by(s.long("overtime", "agency", False, restated=False), "key").items() if not r["is_citywide"]}
    assert pay(strict) == {"A": (None, None, 100.0), "B": (None, None, None)}
    assert pay(lenient) == {"A": (75.0, 60.0, 100.0), "B": (None, None, None)}
    assert overtime(strict) == {"A": (None, None), "B": (None, None)}
    assert overtime(lenient) == {"A": (7.0, 14.0), "B": (None, 0.0)}

"""The streamed cube equals the batch cube after files arrive in two rounds."""

import pytest
from pyspark.sql import functions as F

from helpers import SF0001
from wagelens import STAR_V2020, STAR_V2022, Inputs, ReportSuite
from wagelens.operators.aggregates import CUBE_KEYS, CUBE_MEASURES, measure_cube
from wagelens.operators.filters import eligible
from wagelens.operators.names import name_weights
from wagelens.session import scratch_path
from wagelens.sources import star
from wagelens.sources import files, versions
from wagelens.sources.sinks import write_csv
from wagelens.streaming.cube_stream import add_epoch, read_cube, read_payroll_stream, start_cube_upkeep


def same_cubes(got, want):
    got, want = ({tuple(r[k] for k in CUBE_KEYS): r for r in cube.collect()} for cube in (got, want))
    assert got.keys() == want.keys()
    for k in want:
        for c in CUBE_MEASURES:
            assert got[k][c] == pytest.approx(want[k][c]), (k, c)


@pytest.mark.parametrize("p", [STAR_V2020, STAR_V2022, STAR_V2020.with_(max_broadcast_rows=0)], ids=["drop", "zero", "shuffle"])
def test_stream_cube_matches_batch(spark, p):
    payroll = star.payroll(spark, SF0001, p.years)
    weights = name_weights(star.names(spark, SF0001))
    landing = scratch_path(spark, "landing")
    cube_path = scratch_path(spark, "cube")
    ckpt = scratch_path(spark, "stream-ckpt")

    payroll.where(F.col("fiscal_year") <= 1997).write.parquet(f"{landing}/part=1")
    stream = read_payroll_stream(spark, f"{landing}/*")
    start_cube_upkeep(stream, weights, p, cube_path, ckpt).awaitTermination()
    first = read_cube(spark, cube_path)
    assert first.agg(F.max("fiscal_year")).first()[0] <= 1997

    payroll.where(F.col("fiscal_year") > 1997).write.parquet(f"{landing}/part=2")
    stream = read_payroll_stream(spark, f"{landing}/*")
    start_cube_upkeep(stream, weights, p, cube_path, ckpt).awaitTermination()
    same_cubes(read_cube(spark, cube_path), measure_cube(eligible(payroll, p.years), weights, p.unmatched))

    # Reports can be built from the streamed cube table.
    inputs = Inputs(payroll, star.names(spark, SF0001), star.cpi(spark, SF0001))
    report = ReportSuite(inputs, p, cube=read_cube(spark, cube_path)).overtime("agency")
    assert report.count() >= 1


def test_large_weights_meet_sums_only(spark):
    """Above the broadcast limit a batch is summed per name before anything is shuffled on names."""
    from wagelens.streaming.cube_stream import batch_cube

    p = STAR_V2020.with_(max_broadcast_rows=0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        payroll = spark.createDataFrame(star.payroll(spark, SF0001, p.years).limit(500).toPandas())
        plan = batch_cube(payroll, name_weights(star.names(spark, SF0001)), p)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # From the payroll up: a partial aggregate stands before the first exchange.
    below = plan[plan.index("SortMergeJoin"):]
    side = below[below.index("hashpartitioning(first_name"):]
    assert side.index("HashAggregate") < side.index("Scan ExistingRDD") and "Window" not in plan
    assert "partial_count" in side[: side.index("Scan ExistingRDD")]


def test_crash_between_epochs_leaves_a_whole_cube(spark, monkeypatch):
    p = STAR_V2020
    payroll = star.payroll(spark, SF0001, p.years)
    weights = name_weights(star.names(spark, SF0001))
    early, late = payroll.where("fiscal_year <= 1997"), payroll.where("fiscal_year > 1997")
    path = scratch_path(spark, "cube")
    add_epoch(early, 0, weights, p, path)
    before = measure_cube(eligible(early, p.years), weights, p.unmatched)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    # The new version is written, its marker is not.
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", crash)
        with pytest.raises(Crash):
            add_epoch(late, 1, weights, p, path)
    assert versions.current(spark, path) == 0
    same_cubes(read_cube(spark, path), before)
    # The epoch is repeated; then again, as after a crash before the stream took note of it.
    for _ in range(2):
        add_epoch(late, 1, weights, p, path)
    whole = measure_cube(eligible(payroll, p.years), weights, p.unmatched)
    same_cubes(read_cube(spark, path), whole)
    with pytest.raises(RuntimeError, match="don't belong together"):
        add_epoch(late, 3, weights, p, path)
    assert versions.committed(spark, path) == [0, 1]
    add_epoch(late.limit(0), 2, weights, p, path)
    assert versions.committed(spark, path) == [1, 2]
    same_cubes(read_cube(spark, path), whole)


def test_stream_fails_after_publishing_and_goes_on(spark):
    p = STAR_V2020
    payroll = star.payroll(spark, SF0001, p.years)
    weights = name_weights(star.names(spark, SF0001))
    landing, path, ckpt = (scratch_path(spark, n) for n in ("landing", "cube", "ckpt"))
    payroll.write.parquet(f"{landing}/part=1")

    def fail(batch, epoch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        start_cube_upkeep(read_payroll_stream(spark, f"{landing}/*"), weights, p, path, ckpt, on_batch=fail).awaitTermination()
    start_cube_upkeep(read_payroll_stream(spark, f"{landing}/*"), weights, p, path, ckpt).awaitTermination()
    same_cubes(read_cube(spark, path), measure_cube(eligible(payroll, p.years), weights, p.unmatched))


def test_csv_stream_reads_each_file_by_its_header(spark):
    p = STAR_V2020
    payroll = star.payroll(spark, SF0001, p.years)
    weights = name_weights(star.names(spark, SF0001))
    landing, path, ckpt = (scratch_path(spark, n) for n in ("landing", "cube", "ckpt"))
    published = {v: k for k, v in files.PAYROLL_SOURCE_NAMES.items()}
    rows = payroll.withColumnsRenamed(published).withColumn("Note", F.lit('a, "quoted" one'))
    write_csv(rows.where("`Fiscal Year` <= 1996"), f"{landing}/part=1")
    write_csv(rows.where("`Fiscal Year` > 1996").select(*reversed(rows.columns)), f"{landing}/part=2")
    start_cube_upkeep(read_payroll_stream(spark, f"{landing}/*", "csv", max_files_per_trigger=3), weights, p, path, ckpt).awaitTermination()
    same_cubes(read_cube(spark, path), measure_cube(eligible(payroll, p.years), weights, p.unmatched))

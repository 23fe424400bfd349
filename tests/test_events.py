"""Event-table semantics on a hand-made study, and interval boundaries."""

import datetime as dt

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from studyframe.operators import attach, events, grids, summaries
from studyframe.plans import study_events
from studyframe.sources import fixtures as fx
from studyframe.sources import study

D = dt.datetime


@pytest.fixture(scope="module")
def sheet(spark):
    def row(i, trt, mat, sample, start, end=None, vol=None, cal=2.0, crcl=8.0):
        return (i, trt, mat, sample, start, end, vol, 1.0, 1.0, cal, 1.0, crcl, 1.0)
    raw = [
        # first plasma value missing; starts on the 20th; capped GFR
        row(1423.0, "Caffeine", "Plasma", 1.0, D(2016, 7, 20, 8), cal=None),
        row(1423.0, "Caffeine", "Plasma", 2.0, D(2016, 7, 21, 1), cal=2.5),
        row(1423.0, "Caffeine", "Urine", 3.0, D(2016, 7, 21, 2), D(2016, 7, 21, 6), vol=0.5),
        row(1423.0, "Caffeine", "Plasma", 14.0, D(2016, 8, 21, 3)),
        # no GFR at all, one row without a start
        row(77.0, "Placebo", "Plasma", 1.0, None, crcl=None),
        row(77.0, "Placebo", "Plasma", 2.0, D(2016, 7, 22, 23), cal=3.0, crcl=None),
    ]
    df = spark.createDataFrame(raw, study.STUDY_SCHEMA)
    return df.withColumnRenamed("ID", "ID_ORIG")


def fixed(sheet):
    wrong = (F.col("ID_ORIG") == 1423) & (F.col("SAMPLE") == 14)
    return study_events.build_event_table(sheet, corrections=[(wrong, 1)])


def test_event_table_rows(sheet):
    table = fixed(sheet)
    assert table.count() == 6 + 2 * 8 + 1
    by = {(r.ID_ORIG, r.SAMPLE, r.evid): r for r in table.filter("MAT <> 'Dose'").collect()}
    late = by[(1423.0, 14.0, 0)]
    assert late.DATST == D(2016, 7, 21, 3) and late.time == 4.0  # month corrected
    assert by[(1423.0, 1.0, 0)].time == -15.0  # before 23:00 of the first day
    assert {r.ID for r in table.collect()} == {1, 2}
    assert by[(77.0, 2.0, 0)].ID == 1 and late.ID == 2


def test_baselines(sheet):
    by = {r.ID_ORIG: r for r in fixed(sheet).filter("MAT <> 'Dose'").collect()}
    assert by[1423.0].GFR_0 == 7.2 and by[1423.0].P_0 is None  # first value is missing
    assert by[77.0].GFR_0 is None and by[77.0].P_0 == 42.0  # the row without a start sorts last


def test_urine_end(sheet):
    ends = fixed(sheet).filter("cmt = 31 and evid = 1").collect()
    assert [(r.time, r.dTIME, r.CALAMT) for r in ends] == [(7.0, 4.0, 1.0)]


def test_dose_rows(sheet):
    doses = fixed(sheet).filter("MAT = 'Dose'").orderBy("ID", "time").collect()
    assert [d.time for d in doses[:8]] == events.DOSE_TIMES
    assert {(d.TRT, d.amt) for d in doses} == {("Caffeine", 200.0), ("Placebo", 0.0)}
    assert all(d.CAL is None and d.SAMPLE is None and d.TIMEEND is None for d in doses)
    assert {d.GFR_0 for d in doses if d.TRT == "Caffeine"} == {7.2}


def test_order_has_missing_last(sheet):
    table = fixed(sheet).select("ID", "time", "amt").collect()
    key = [(r.ID, r.time is None, r.time or 0, -r.amt) for r in table]
    assert key == sorted(key)


def test_sim_input(sheet):
    table = study_events.build_sim_input(fixed(sheet))
    assert table.count() == 6 - 1 + 16 + 1 + 2 * 97
    key = [(r.ID, r.time, -r.evid) for r in table.collect()]
    assert key == sorted(key)


def test_arm_codes(sheet):
    assert rows(study_events.arm_table(fixed(sheet))) == [(77.0, 0), (1423.0, 1)]
    back = events.label_arm(study_events.arm_table(fixed(sheet)))
    assert rows(back) == [(77.0, "Placebo"), (1423.0, "Caffeine")]


def test_fixture_row_count(spark):
    raw = fx.study(spark, SF_DIR)
    table = study_events.build_event_table(raw, ordered=False)
    subjects = raw.select("ID_ORIG").distinct().count()
    assert table.count() == raw.count() + 8 * subjects + raw.filter("DATEN is not null").count()


@pytest.fixture(scope="module")
def clocked(spark):
    raw = [(1, 0.5, 0, 1.0), (1, 1.0, 1, 2.0), (1, 3.0, 0, 5.0), (1, 9.0, 1, 8.0),
           (1, 9.5, 0, 9.0), (1, 20.0, 1, 11.0), (1, 30.0, 0, 12.0), (2, 1.0, 1, 1.0),
           (2, 2.0, 0, 2.0), *[(3, float(k), k % 2, 1.0 * k) for k in range(1, 11)]]
    return spark.createDataFrame(raw, "ID int, time double, start int, UCA double")


def window(df, inclusive):
    out = attach.collection_window(df, ["ID"], F.col("start") == 1, "time", "UCA", ["time"],
                                   inclusive)
    return rows(out.select("ID", "time", "DAY", "dTIME", "dUCA"))


def test_collection_window(clocked):
    later = [(1, 3.0, 1, 2.0, 3.0), (1, 9.5, 2, 0.5, 1.0), (1, 30.0, 3, 10.0, 1.0),
             (2, 2.0, 1, 1.0, 1.0), *[(3, 2.0 * k, k, 1.0, 1.0) for k in range(1, 6)]]
    at_start = [(1, 1.0, 1, 0.0, 0.0), (1, 9.0, 2, 0.0, 0.0), (1, 20.0, 3, 0.0, 0.0), (2, 1.0, 1, 0.0, 0.0),
                *[(3, 2.0 * k - 1, k, 0.0, 0.0) for k in range(1, 6)]]
    assert window(clocked, False) == later  # subjects with one start and with five, too
    assert window(clocked, True) == sorted(later + at_start)


def test_columns_of_unequal_tables(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d")], "k int, o int, x string")
    b = spark.createDataFrame([(1, 1, "p"), (3, 1, "q"), (None, 1, "r")], "k int, p int, y string")
    pick = lambda how: rows(attach.zip_columns(a, b, ["k"], ["o"], ["p"], how).select("k", "x", "y"), "k", "x")
    paired = [(None, "d", "r"), (1, "a", "p")]
    assert pick("drop") == paired
    assert pick("keep") == [*paired, (1, "b", None), (2, "c", None), (3, None, "q")]
    with pytest.raises(Exception, match="no partner"):
        pick("fail")


def test_pairs_need_both_sides(spark):
    raw = [(1, 1.0, 0, 2.0), (1, 3.0, 1, 7.0), (1, 5.0, 0, 1.0)]
    df = spark.createDataFrame(raw, "ID int, time double, evid int, UCA double")
    out = attach.paired_difference(df, ["ID"], "evid", ["time"], {"dUCA": "UCA", "dT": "time"})
    assert rows(out) == [(1, 1, 5.0, 2.0)]


def test_nearest_keeps_ties(spark):
    df = spark.createDataFrame([("a", 45.0), ("a", 55.0), ("a", 90.0)], "g string, e double")
    assert rows(summaries.nearest_to(df, ["g"], "e", 50.0)) == [("a", 45.0), ("a", 55.0)]
    assert rows(summaries.nearest_to(df, ["g"], "e", 50.0, True)) == [("a", 90.0)]


def test_box_stats_literal(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    r = summaries.box_stats(df, ["g"], "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (2, 3, 4, 1, 4, 1)


def test_scale_limits(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (1000.0,), (None,)], "v double")
    kept = summaries.apply_scale_limits(df, "v", 1, 100, log10=True)
    assert rows(kept) == [(0.0,), (1.0,)]


def test_rename_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ID int, V1 int, eta_12_x int")
    assert events.rename_pattern(df, "ETA", {"ETA12": "CENT_0"}).columns == ["ID", "ETA1", "CENT_0"]


def test_replication_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "ID long")
    assert rows(grids.replicate_subjects(df, 2, 3)) == [(i + 1, i // 3 + 1) for i in range(6)]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    with open(path, "w") as f:
        f.write("any,header,at,all,is,skipped,a,b,c,d,e,f,g\n"
                "1423,Caffeine,Plasma,14,2016-07-20 08:30:00,NR,NR,140,80,2.4,100,NR,1\n")
    df = study.read_study(spark, path)
    assert df.schema == study.STUDY_SCHEMA
    r = df.first()
    assert r.ID == 1423.0 and r.DATST == D(2016, 7, 20, 8, 30) and r.DATEN is None
    assert r.VOL is None and r.CRCL is None and r.CAL == 2.4
    pts = str(tmp_path / "points.csv")
    with open(pts, "w") as f:
        f.write("1.5,20\n3.0,55.5\n")
    assert rows(study.read_points(spark, pts)) == [(1.5, 20.0), (3.0, 55.5)]
    out = str(tmp_path / "result")
    sim = fx.simulated(spark, SF_DIR, 3)
    study.write_result(sim, out)
    back = study.read_result(spark, out)
    assert back.count() == sim.count()
    plan = back.filter("SIM = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(SIM" in plan
    files = back.inputFiles()
    read = lambda df: [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    one = read(back.filter("SIM = 2"))
    assert len(files) == 3 and len(one) == 1 and "SIM=2" in one[0]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2KB")
    try:
        study.write_result(sim, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = study.read_result(spark, out)
    assert back.count() == sim.count() and len(back.inputFiles()) > 6
    assert all("SIM=2" in f for f in read(back.filter("SIM = 2")))
    parquet = str(tmp_path / "sheet")
    df.write.parquet(parquet)
    assert rows(study.read_study(spark, parquet, "parquet")) == rows(df)


def test_collection_window_of_a_large_subject(spark, hot):
    """A hundred thousand starts and ties in time, in chunks; the plan has no join on a range."""
    n = 100_000
    df = spark.range(2 * n).select(F.lit(7).alias("ID"), (F.floor(F.col("id") / 2) * 0.5).alias("time"), (F.col("id") % 2).cast("int").alias("start"),
                                   F.col("id").cast("double").alias("UCA"), F.col("id").alias("REC"))
    spark.conf.set("spark.studyframe.hotGroupRows", "50000")
    out = attach.collection_window(df, ["ID"], F.col("start") == 1, "time", "UCA", ["time", "REC"], True)
    r = out.agg(F.count("*"), F.max("DAY"), F.sum(F.abs("dTIME")), F.sum("dUCA"), F.sum((F.col("DAY") == F.floor(F.col("REC") / 2) + 1).cast("int"))).first()
    assert tuple(r) == (2 * n, n, 0.0, -1.0 * n, 2 * n)


def test_collection_window_plan(clocked):
    out = attach.collection_window(clocked, ["ID"], F.col("start") == 1, "time", "UCA", ["time"], True)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_collection_window_in_chunks(clocked, spark):
    plain = window(clocked, True), window(clocked, False)
    spark.conf.set("spark.studyframe.hotGroupRows", "3")
    try:
        assert (window(clocked, True), window(clocked, False)) == plain
    finally:
        spark.conf.unset("spark.studyframe.hotGroupRows")

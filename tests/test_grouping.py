"""Split routes for huge groups give the rows of the plain routes."""

import random

import pytest
from conftest import close, rows
from pyspark.sql import functions as F

from studyframe.operators import attach, events, grouping, summaries, vpc
from studyframe.operators.grouping import join_on, ordinal, running_sums
from studyframe.operators.quantiles import exact_quantiles

PROBS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.731, "e": 1.0}


def type7(values, p):
    v = sorted(values)
    spot = (len(v) - 1) * p
    low = int(spot)
    high = min(low + 1, len(v) - 1)
    return v[low] + (spot - low) * (v[high] - v[low])


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    out = []
    for i in range(900):
        key = None if i % 9 == 0 else ("hot" if i % 3 else f"k{i % 20}")
        v = None if i % 31 == 0 else round(rng.gauss(0, 10), rng.choice([0, 3]))
        out.append((key, i, float(rng.randint(0, 60)), v))
    return spark.createDataFrame(out, "g string, id long, t double, v double"), out


def test_quantiles_plain(data):
    df, raw = data
    check_quantiles(exact_quantiles(df, ["g"], "v", PROBS), raw)


def test_quantiles_hot(data, hot):
    df, raw = data
    check_quantiles(exact_quantiles(df, ["g"], "v", PROBS), raw)


def check_quantiles(result, raw):
    got = {r["g"]: r for r in result.collect()}
    groups = {}
    for g, _, _, v in raw:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        kept = [v for v in values if v is not None]
        assert got[g]["n"] == len(kept)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(type7(kept, p), abs=1e-9)


def test_group_of_nulls_stays(spark, hot):
    df = spark.createDataFrame([("x", None)] * 30 + [("y", 1.0)], "g string, v double")
    assert rows(exact_quantiles(df, ["g"], "v", {"m": 0.5})) == [("x", None, 0), ("y", 1.0, 1)]


def plain_running(raw):
    state, out = {}, []
    for g, i, t, v in sorted(raw, key=lambda r: (r[2], r[1])):
        s, n = state.get(g, (None, 0))
        if v is not None:
            s = (s or 0) + v
        state[g] = (s, n + 1)
        out.append((i, s, n + 1))
    return sorted(out)


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_running_sums(data, mode, request):
    if mode == "hot":
        request.getfixturevalue("hot")
    df, raw = data
    out = ordinal(running_sums(df, ["g"], ["t", "id"], {"s": "v"}), ["g"], ["t", "id"], "n")
    want = plain_running(raw)
    for (i, s, n), (j, ws, wn) in zip(rows(out.select("id", "s", "n"), "id"), want):
        assert (i, n) == (j, wn)
        assert s == pytest.approx(ws) if ws is not None else s in (None, 0.0)


def test_rekey_hot(spark, hot):
    keys = [(float(k * 7 % 101),) for k in range(300)]
    out = events.rekey(spark.createDataFrame(keys, "k double"), "k").distinct()
    assert rows(out) == [(float(k), k + 1) for k in range(101)]


def test_pairs_hot(spark, hot):
    raw = [(1, float(i), e, float(i * (1 + e))) for i in range(60) for e in (0, 1)]
    df = spark.createDataFrame(raw, "ID long, time double, evid int, UCA double")
    out = attach.paired_difference(df, ["ID"], "evid", ["time"], {"d": "UCA", "dt": "time"})
    assert rows(out.select("pair", "d", "dt")) == [(i + 1, float(i), 0.0) for i in range(60)]


def test_box_stats_hot_equals_plain(spark, data):
    df, _ = data
    plain = rows(summaries.box_stats(df, ["g"], "v"))
    from studyframe.operators.grouping import HOT_ROWS_CONF
    spark.conf.set(HOT_ROWS_CONF, "20")
    try:
        close(rows(summaries.box_stats(df, ["g"], "v")), plain)
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_join_on_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, b int")
    assert rows(join_on(a, b, ["k"])) == [(None, 1, 5)]
    assert rows(join_on(a, b, ["k"], "left_anti")) == [("x", 2)]


def test_bin_codes(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.9, 2.0, 35.0, 36.0, None)], "t double")
    out = df.select("t", vpc.bin_code("t", [0, 2, 5, 35]).alias("b"))
    assert dict(out.collect()) == {-1.0: 0, 0.0: 1, 1.9: 1, 2.0: 2, 35.0: 4, 36.0: 4, None: None}
    closed = df.filter("t <= 35").select("t", vpc.bin_code("t", [0, 2, 5, 35], closed=True).alias("b"))
    assert dict(closed.collect()) == {-1.0: 0, 0.0: 1, 1.9: 1, 2.0: 2, 35.0: 3}


def test_bands_are_ordered(spark):
    from conftest import SF_DIR
    from studyframe.sources import fixtures as fx
    bands = vpc.percentile_bands(fx.simulated(spark, SF_DIR), "P", "time", "TRT", [0, 24, 48])
    for r in bands.collect():
        assert r.p05_lo <= r.p05_mid <= r.p05_hi and r.p95_lo <= r.p95_mid <= r.p95_hi
        assert r.n_sim == 20


def test_plan_has_no_cross_join_and_prunes(spark):
    from conftest import SF_DIR
    from studyframe.sources import fixtures as fx
    sim = fx.simulated(spark, SF_DIR)
    plan = vpc.vpc_replicate(sim, ["SIM", "TRT"], "P")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "props" not in scan and "event_type" not in scan


def test_first_per_is_limited_before_the_shuffle(spark):
    from conftest import SF_DIR
    from studyframe.operators.grouping import first_per
    from studyframe.sources import fixtures as fx
    out = first_per(fx.study(spark, SF_DIR), ["ID_ORIG"], [F.asc_nulls_last("DATST")])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_first_place_is_the_order_of_both_and_needs_no_sort(spark):
    far = 2 ** 63 - 1
    data = [(1, 5, 1, 10.0), (1, 4, far, 11.0), (1, 4, -far - 1, 12.0), (2, None, 7, 13.0), (2, 0, -far, 14.0), (2, None, None, None),
            (3, 1, None, 15.0), (3, 1, -far - 1, 16.0), (None, 9, 3, 17.0), (None, 9, 2, 18.0)]
    df = spark.createDataFrame(data, "g long, tick long, OBS long, P double")
    packed = grouping.attach_few(df, ["g"], first=F.min_by("P", grouping.first_place("tick", "OBS")))
    plain = grouping.attach_group(df, ["g"], first=F.min_by(F.struct(F.col("P").alias("v")), F.struct("tick", "OBS"))["v"])
    assert rows(packed) == rows(plain) and {r["g"]: r["first"] for r in packed.collect()} == {1: 12.0, 2: None, 3: 15.0, None: 18.0}
    plan = df.groupBy("g").agg(F.min_by("P", grouping.first_place("tick", "OBS")))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan

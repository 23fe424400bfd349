"""Random tables: repeatable, inside their bounds, with the right moments."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyframe.functions import models
from studyframe.operators import fitting, population


def ids(spark, n=4000):
    return spark.range(1, n + 1).withColumnRenamed("id", "ID")


def test_repartitioning_changes_nothing(spark):
    def drawn(df):
        out = population.draw_etas(df, "ID", models.INHALED)
        out = population.trunc_normal(out, "ID", "w", 70, 15, 60, 80)
        return rows(population.trunc_mvnormal(out, "ID", ["a", "b"], [1, 2], [1, 1],
                                              [[1, .5], [.5, 1]], [0, 0], [3, 3]), "ID")
    assert drawn(ids(spark, 300)) == drawn(ids(spark, 300).repartition(7, F.rand(1)))


def test_truncated_bounds_and_mean(spark):
    out = population.trunc_normal(ids(spark), "ID", "w", 0, 1, 1.0, 3.0)
    r = out.agg(F.min("w"), F.max("w"), F.avg("w"), F.count("w")).first()
    assert 1.0 <= r[0] and r[1] <= 3.0 and r[3] == 4000

    def pdf(z):
        return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    inside = (math.erf(3 / 2 ** .5) - math.erf(1 / 2 ** .5)) / 2
    assert r[2] == pytest.approx((pdf(1) - pdf(3)) / inside, abs=4 * 0.45 / 4000 ** .5)


def test_log_moments(spark):
    out = population.trunc_normal(ids(spark, 20000), "ID", "w", 90, 30, 0.0, 1e9, log=True)
    r = out.agg(F.avg("w"), F.stddev("w")).first()
    assert r[0] == pytest.approx(90, abs=4 * 30 / 20000 ** .5) and r[1] == pytest.approx(30, rel=.1)


def test_impossible_range_is_an_error(spark):
    with pytest.raises(ValueError, match="no draw inside the range"):
        population.trunc_normal(ids(spark, 3), "ID", "w", 0, 1, 50, 60)
    with pytest.raises(ValueError, match="no draw inside the range"):
        population.trunc_mvnormal(ids(spark, 3), "ID", ["a"], [0], [1], [[1]], [50], [60])


def test_rare_ranges(spark):
    r = population.trunc_normal(ids(spark, 500), "ID", "w", 0, 1, 8.0, 9.0).agg(F.min("w"), F.max("w"), F.count("w")).first()
    assert 8 <= r[0] < 8.01 and 8.4 < r[1] <= 9 and r[2] == 500
    out = population.trunc_mvnormal(ids(spark, 400), "ID", ["a", "b"], [0, 0], [1, 1], [[1, 0.5], [0.5, 1]], [1, 1], [5, 5])
    r = out.agg(F.min("a"), F.min("b"), F.count("a"), F.count_distinct("ID")).first()
    assert r[0] >= 1 and r[1] >= 1 and (r[2], r[3]) == (400, 400)


def test_each_uniform_of_a_draw_is_hashed_once(spark, monkeypatch):
    plans, cut = [], population.cut_lineage
    monkeypatch.setattr(population, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    out = population.trunc_mvnormal(ids(spark, 200).coalesce(1), "ID", ["a", "b"], [0, 0], [1, 1], [[1, 0.5], [0.5, 1]], [1, 1], [5, 5])
    assert out.count() == 200 and len(plans) > 1
    assert all(plan.count("md5(") == 2 for plan in plans)  # one for each coordinate
    # rows of a scan with few splits are dealt to all cores before the next tries
    assert all("Repartition" in plan for plan in plans[1:2])


def test_normal_quantile(spark):
    from statistics import NormalDist

    from studyframe.functions.draws import normal_quantile
    probs = [1e-300, 1e-30, 1e-12, 1e-5, 0.01, 0.075, 0.0750001, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in probs], "p double").select(normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-15) for r, p in zip(got, probs))


def test_correlation_needs_matching_shapes(spark):
    with pytest.raises(ValueError):
        population.trunc_mvnormal(ids(spark), "ID", ["a"], [1, 2], [1], [[1]], [0], [1])
    with pytest.raises(ValueError):
        population.cholesky([[1.0, 2.0], [2.0, 1.0]])


def test_hill_fit_recovers_the_curve(spark):
    pts = [("d", c, 100 * c ** 1.35 / (26.3 ** 1.35 + c ** 1.35)) for c in (1., 5., 10., 26.3, 60., 200.)]
    out = fitting.fit_hill(spark.createDataFrame(pts, "dataset string, Conc double, Eff double"),
                           ["dataset"]).first()
    assert out.ec50 == 26.3 and out.hill == pytest.approx(1.35) and out.n == 5

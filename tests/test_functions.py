"""Hand-computed values of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from studyframe.functions import clock, covariates, responses


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def test_ckdepi(spark):
    args = [F.lit(v) for v in (88.4, 50.0, 1, 0)]
    want = 141 * (1 / 0.9) ** -1.209 * 0.993 ** 50
    assert one(spark, covariates.ckdepi(*args)) == pytest.approx(want)
    female = [F.lit(v) for v in (0.5, 30.0, 0, 1)]
    want = 141 * (0.5 / 0.7) ** -0.329 * 0.993 ** 30 * 1.018 * 1.159
    assert one(spark, covariates.ckdepi(*female, mgdl=True)) == pytest.approx(want)
    missing = [F.lit(None).cast("double"), F.lit(30.0), F.lit(0), F.lit(1)]
    assert one(spark, covariates.ckdepi(*missing)) is None


def test_body_size(spark):
    assert one(spark, covariates.bmi(F.lit(80.0), F.lit(200.0))) == pytest.approx(20.0)
    assert one(spark, covariates.bmi(F.lit(80.0), F.lit(2.0), cm=False)) == pytest.approx(20.0)
    assert one(spark, covariates.bsa(F.lit(70.0), F.lit(170.0))) == pytest.approx(
        0.007184 * 170 ** 0.725 * 70 ** 0.425)


@pytest.mark.parametrize("x,want", [(123456.0, 123000.0), (0.00123456, 0.00123), (-9.876, -9.88),
                                    (0.0, 0.0), (99.96, 100.0), (5.0, 5.0)])
def test_signif(spark, x, want):
    assert one(spark, responses.signif(F.lit(x))) == pytest.approx(want, rel=1e-12)


def test_signif_null(spark):
    assert one(spark, responses.signif(F.lit(None).cast("double"))) is None


def test_emax_and_units(spark):
    assert one(spark, responses.sigmoid_emax(F.lit(30.0), 100, 30, 1.7)) == pytest.approx(50.0)
    assert one(spark, responses.emax_inhibition(F.lit(5.8257), 0.446)) == pytest.approx(0.777)
    assert one(spark, responses.um_to_mgl(F.lit(100.0))) == pytest.approx(19.419)
    assert one(spark, responses.ug_to_pmol(F.lit(20.0))) == pytest.approx(20e6 / 4117.8)


def test_amount_uses_plasma_volume(spark):
    assert one(spark, responses.conc_to_amount(F.lit(2.0), F.lit(None).cast("double"))) == 28.0
    assert one(spark, responses.conc_to_amount(F.lit(2.0), F.lit(0.5))) == 1.0


def test_corrections_are_null_at_zero(spark):
    zero = F.lit(0.0)
    assert one(spark, responses.prediction_correct(F.lit(1.0), F.lit(2.0), zero)) is None
    assert one(spark, responses.percent_of(F.lit(1.0), zero)) is None
    assert one(spark, responses.log_residual(zero, F.lit(1.0))) is None


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_minus_months(spark):
    assert one(spark, clock.minus_months(ntz("2016-07-20 08:30:00"), 1)) == dt.datetime(
        2016, 6, 20, 8, 30)
    assert one(spark, clock.minus_months(ntz("2016-03-31 08:30:00"), 1)) is None


def test_clock(spark):
    origin = clock.day_origin(ntz("2016-07-20 08:30:00"))
    assert one(spark, clock.hours_between(ntz("2016-07-20 08:30:00"), origin)) == -14.5
    assert one(spark, clock.hours_between(ntz("2016-07-21 01:00:00.5"), origin)) == pytest.approx(
        2 + 0.5 / 3600)


def test_clock_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # a clock change falls into this night
        gap = clock.hours_between(ntz("2024-03-10 12:00:00"), ntz("2024-03-09 23:00:00"))
        assert one(spark, gap) == 13.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tick_joins_floating_times(spark):
    assert one(spark, clock.tick(F.lit(0.1) + F.lit(0.2))) == one(spark, clock.tick(F.lit(0.3)))

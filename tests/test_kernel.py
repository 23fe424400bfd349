"""Closed-form responses against a small fixed-step integrator."""

import pytest
from pyspark.sql import functions as F

from studyframe.functions import models
from studyframe.operators import population
from studyframe.operators.superpose import dose_superposition, regimen_response


def derivative(model, p, y):
    gut, cent, peri = y["GUT"], y["CENT"], y["PERI"]
    if "CLCAPX" in p:
        ke, k12, k21 = (p["CLCAPX"] + p["CLCAO"]) / p["V1"], p["K12"], p["K21"]
        fed = {"PARA": (p["CLCAPX"] / p["V1"], p["CLPX"] / p["V2"])}
    else:
        ke, k12, k21 = p["CL"] / p["V1"], p["Q"] / p["V1"], p["Q"] / p["V2"]
        fed = {"PARA": (p["CL"] * p["FPX"], p["KPX"]), "THPH": (p["CL"] * p["FTP"], p["KTP"]),
               "THBR": (p["CL"] * p["FTB"], p["KTB"])}
    out = {"GUT": -p["KA"] * gut,
           "CENT": model.fraction * p["KA"] * gut - (k12 + ke) * cent + k21 * peri,
           "PERI": k12 * cent - k21 * peri}
    for name, (rate_in, rate_out) in fed.items():
        out[name] = rate_in * cent - rate_out * y[name]
    return out


def integrate(model, p, y, until, doses, step=0.002):
    """Runge-Kutta with the doses (time incl. lag, amount) added to the gut."""
    t, pending = 0.0, sorted(doses)
    while True:
        while pending and pending[0][0] <= t + 1e-9:
            y = {**y, "GUT": y["GUT"] + pending.pop(0)[1]}
        if t >= until - 1e-9:
            return y
        h = min([step, until - t] + [pending[0][0] - t for _ in pending[:1]])
        k1 = derivative(model, p, y)
        k2 = derivative(model, p, {c: y[c] + h / 2 * k1[c] for c in y})
        k3 = derivative(model, p, {c: y[c] + h / 2 * k2[c] for c in y})
        k4 = derivative(model, p, {c: y[c] + h * k3[c] for c in y})
        y = {c: y[c] + h / 6 * (k1[c] + 2 * k2[c] + 2 * k3[c] + k4[c]) for c in y}
        t += h


TIMES = [0.0, 0.1, 1.0, 3.0, 8.2, 20.0]
DOSES = [(0.0, 100.0), (2.0, 50.0), (8.0, 200.0)]


@pytest.mark.parametrize("name", ["ORAL_ABSTINENT", "GUM", "INHALED"])
@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_superposition(spark, name, mode, request):
    if mode == "hot":
        from studyframe.operators.grouping import HOT_ROWS_CONF
        spark.conf.set(HOT_ROWS_CONF, "3")
        request.addfinalizer(lambda: spark.conf.unset(HOT_ROWS_CONF))
    model = getattr(models, name)
    people = spark.createDataFrame([(1,), (2,)], "ID long").withColumns(
        {f"ETA{n}": F.lit(0.1 * (n % 3)) for n in range(1, 12)})
    params = population.initial_amounts(population.individual_params(people, model), model)
    p = params.filter("ID = 1").first().asDict()
    obs = spark.createDataFrame([(i, k, t) for i in (1, 2) for k, t in enumerate(TIMES)],
                                "ID long, REC long, time double")
    doses = spark.createDataFrame([(1, t, a) for t, a in DOSES], "ID long, time double, amt double")
    held = {c: f"{c}_0" for c in model.initial}
    out = dose_superposition(obs, doses, params, model, initial=held)
    got = {(r.ID, r.REC): r for r in out.collect()}
    assert len(got) == 2 * len(TIMES)  # the undosed subject keeps its baseline rows
    lag = p.get("TLAG", 0.0)
    start = {c: p[f"{c}_0"] for c in model.initial}
    for subject, given in ((1, [(t + lag, a) for t, a in DOSES]), (2, [])):
        for k, t in enumerate(TIMES):
            want = integrate(model, p, start, t, given)
            for c in model.compartments:
                assert got[(subject, k)][c] == pytest.approx(want[c], abs=2e-6, rel=1e-6)


def test_fixed_regimen_equals_superposition(spark):
    model = models.ORAL_HABITUAL
    people = spark.createDataFrame([(1,)], "ID long").withColumns(
        {f"ETA{n}": F.lit(0.05 * n) for n in range(1, 12)})
    params = population.initial_amounts(population.individual_params(people, model), model)
    obs = spark.createDataFrame([(1, k, t) for k, t in enumerate(TIMES)],
                                "ID long, REC long, time double")
    doses = spark.createDataFrame([(1, t, 100.0) for t in (0.0, 8.0)],
                                  "ID long, time double, amt double")
    held = {c: f"{c}_0" for c in model.initial}
    a = dose_superposition(obs, doses, params, model, initial=held).orderBy("REC").collect()
    b = regimen_response(obs.join(params, "ID"), model, [0, 8], 100.0, held).orderBy("REC").collect()
    for x, y in zip(a, b):
        for c in model.compartments:
            assert x[c] == pytest.approx(y[c], rel=1e-10, abs=1e-12)


def test_lag_boundary_and_long_gaps(spark):
    model = models.ORAL_ABSTINENT
    people = spark.createDataFrame([(1,)], "ID long").withColumns(
        {f"ETA{n}": F.lit(0.0) for n in range(1, 12)})
    params = population.individual_params(people, model)
    times = [0.14, 0.15, 0.16, 700.0, 5000.0, 5000.2]
    obs = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)],
                                "ID long, REC long, time double")
    doses = spark.createDataFrame([(1, 0.0, 100.0), (1, 4999.0, 100.0)],
                                  "ID long, time double, amt double")
    got = [r.GUT for r in dose_superposition(obs, doses, params, model).orderBy("REC").collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(100.0)
    assert 0 < got[2] < 100.0 and got[3] == pytest.approx(0.0, abs=1e-12)
    assert got[5] == pytest.approx(100.0 * 2.718281828459045 ** (-3.65 * 1.05), rel=1e-9)

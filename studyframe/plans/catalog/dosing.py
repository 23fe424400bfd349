"""Queries of dose superposition, random populations and regimen simulation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from studyframe.functions import draws, models
from studyframe.operators import population
from studyframe.operators.superpose import dose_superposition
from studyframe.plans.catalog.reference_sql import query
from studyframe.plans.catalog.scalars import _ORAL, eta_sql, fixed_etas
from studyframe.sources import fixtures as fx


def _superposed(spark, d, model, initial):
    rows = fx.regimen_events(spark, d).withColumn("time", F.col("tick") / 3600.0)
    people = fixed_etas(rows.select("ID").distinct(), 11)
    params = population.initial_amounts(population.individual_params(people, model), model)
    held = {c: f"{c}_0" for c in model.initial} if initial else None
    amounts = dose_superposition(rows.filter("evid = 0").select("ID", "REC", "time"),
                                 rows.filter("evid = 1").select("ID", "time", "amt"),
                                 params, model, initial=held)
    return amounts.join(params, "ID")


def superposed_oral(spark, d):
    out = _superposed(spark, d, models.ORAL_ABSTINENT, True)
    return out.select("ID", "REC", F.round(F.col("CENT") / F.col("V1"), 6).alias("IPRECA"),
                      F.round(F.col("PARA") / F.col("V2"), 6).alias("IPREPX"),
                      F.round("GUT", 6).alias("GUT"), F.round("PERI", 6).alias("PERI"))


def superposed_gum(spark, d):
    out = _superposed(spark, d, models.GUM, False)
    return out.select("ID", "REC", F.round(F.col("CENT") / F.col("V1"), 6).alias("IPRECA"),
                      F.round(F.col("PARA") / F.col("V2"), 6).alias("IPREPX"))


def superposed_inhaled(spark, d):
    out = _superposed(spark, d, models.INHALED, False)
    return out.select("ID", "REC", F.round(F.col("CENT") / F.col("V1"), 6).alias("IPRECA"),
                      *[F.round(F.col(c) / F.col("V1"), 6).alias(f"IPRE{k}")
                        for c, k in (("PARA", "PX"), ("THPH", "TP"), ("THBR", "TB"))])


def truncated_weights(spark, d):
    """Draws of a normal and of a log-normal column inside their bounds, by key."""
    ids = fx.subjects(spark, d).select("ID")
    drawn = population.trunc_normal(ids, "ID", "WT", *_WEIGHT)
    drawn = population.trunc_normal(drawn, "ID", "CLCR", *_CLEARANCE, log=True, seed=5)
    return _rounded(drawn, "ID", "WT", "CLCR")


def truncated_pairs(spark, d):
    """Correlated draws, redrawn while a coordinate is outside; the second range takes one row in about twenty."""
    ids = fx.subjects(spark, d).select("ID")
    drawn = population.trunc_mvnormal(ids, "ID", ["WT", "HT"], *_BODY)
    drawn = population.trunc_mvnormal(drawn, "ID", ["CL", "V"], *_RARE, log=True, seed=9)
    return _rounded(drawn, "ID", "WT", "HT", "CL", "V")


def _rounded(drawn, *names):
    keys = [n for n in names if n in ("ID", "OBS")]
    return drawn.select(*keys, *[F.round(n, 8).alias(n) for n in names if n not in keys])


def drawn_etas(spark, d):
    ids = fx.subjects(spark, d).select("ID")
    oral = population.draw_etas(ids, "ID", models.ORAL_ABSTINENT)
    return _rounded(oral, "ID", *[f"ETA{k}" for k in models.ORAL_ABSTINENT.omega])


def drawn_eta_blocks(spark, d):
    ids = fx.subjects(spark, d).select("ID")
    return _rounded(population.draw_etas(ids, "ID", models.INHALED), "ID", *[f"ETA{k}" for k in range(1, 7)])


def drawn_eps(spark, d):
    rows = fx.observed(spark, d).select("ID", "OBS")
    drawn = population.draw_eps(rows, ["ID", "OBS"], models.ORAL_ABSTINENT)
    return _rounded(drawn, "ID", "OBS", "EPS1", "EPS2")


# mean, sd, low, high; then the same with correlations
_WEIGHT, _CLEARANCE = (70, 15, 40, 90), (90, 40, 20, 300)
_BODY = [75, 170], [12, 8], [[1, 0.6], [0.6, 1]], [40, 140], [120, 200]
_RARE = [5, 30], [1.5, 6], [[1, 0.4], [0.4, 1]], [6.5, 20], [12, 32]


QUERIES = {
    "superposed_oral": superposed_oral, "superposed_gum": superposed_gum,
    "superposed_inhaled": superposed_inhaled,
    "truncated_weights": truncated_weights, "truncated_pairs": truncated_pairs,
    "drawn_etas": drawn_etas, "drawn_eta_blocks": drawn_eta_blocks, "drawn_eps": drawn_eps,
}

# --- plain SQL of the same responses: one row per (observation, earlier dose) ---


def _central(t: str, f: str = "1") -> str:
    return (f"{f} * (KA * (K21 - KA) / ((a - KA) * (b - KA)) * exp(-KA * {t}) "
            f"+ KA * (K21 - a) / ((KA - a) * (b - a)) * exp(-a * {t}) "
            f"+ KA * (K21 - b) / ((KA - b) * (a - b)) * exp(-b * {t}))")


def _metabolite(t: str, form: str, out: str, f: str = "1") -> str:
    return (f"{form} * {f} * (KA * (K21 - KA) / ((a - KA) * (b - KA)) / ({out} - KA) * (exp(-KA * {t}) - exp(-{out} * {t})) "
            f"+ KA * (K21 - a) / ((KA - a) * (b - a)) / ({out} - a) * (exp(-a * {t}) - exp(-{out} * {t})) "
            f"+ KA * (K21 - b) / ((KA - b) * (a - b)) / ({out} - b) * (exp(-b * {t}) - exp(-{out} * {t})))")


def _peripheral(t: str) -> str:
    return (f"K12 * KA * (exp(-KA * {t}) / ((a - KA) * (b - KA)) + exp(-a * {t}) / ((KA - a) * (b - a)) "
            f"+ exp(-b * {t}) / ((KA - b) * (a - b)))")


def _params(ka: float, source: str = "SELECT DISTINCT ID FROM fx_event", shift: str = "ID",
            table=_ORAL) -> str:
    cols = ", ".join(f"{ka if p == 'KA' else tv} * exp({eta_sql(n).replace('ID', shift)}) AS {p}"
                     for p, tv, n in table)
    return f"""
SELECT *, (s + sqrt(s * s - 4 * K21 * ke)) / 2 AS a, (s - sqrt(s * s - 4 * K21 * ke)) / 2 AS b, CLCAPX / V1 AS form, CLPX / V2 AS kp
FROM (SELECT *, K12 + K21 + ke AS s FROM (SELECT *, (CLCAPX + CLCAO) / V1 AS ke FROM (SELECT ID, {cols},
  {eta_sql(10)} AS ETA10, {eta_sql(11)} AS ETA11 FROM ({source}))))"""


def _pairs(columns: dict[str, str], lag: str) -> str:
    sums = ", ".join(f"coalesce(sum(d.amt * ({sql})), 0) AS {name}" for name, sql in columns.items())
    return f"""
SELECT o.ID, o.REC, {sums} FROM (SELECT * FROM fx_event WHERE evid = 0) o JOIN params p ON p.ID = o.ID
LEFT JOIN (SELECT * FROM fx_event WHERE evid = 1) d ON d.ID = o.ID AND o.tick / 3600.0 >= d.tick / 3600.0 + {lag}
GROUP BY o.ID, o.REC"""


_T = "(o.tick / 3600.0 - (d.tick / 3600.0 + TLAG))"
_T0 = "(o.tick / 3600.0 - d.tick / 3600.0)"
_Z = "(o.tick / 3600.0)"


def _initial(z: str, init: dict[str, float]) -> dict[str, str]:
    """Amounts left of those present at time zero."""
    c0 = f"{init['CENT']} * exp(ETA10)"
    p0 = f"{init['PARA']} * exp(ETA11)"
    from_cent = [("(K21 - a) / (b - a)", "a"), ("(K21 - b) / (a - b)", "b")]
    from_peri = [("K21 / (b - a)", "a"), ("K21 / (a - b)", "b")]

    def total(terms):
        return "(" + " + ".join(f"{c} * exp(-{r} * {z})" for c, r in terms) + ")"

    def formed(terms):
        return "(form * (" + " + ".join(
            f"{c} / (kp - {r}) * (exp(-{r} * {z}) - exp(-kp * {z}))" for c, r in terms) + "))"

    return {
        "GUT": f"{init['GUT']} * exp(-KA * {z})",
        "CENT": f"{init['GUT']} * ({_central(z)}) + {c0} * {total(from_cent)} + {init['PERI']} * {total(from_peri)}",
        "PERI": f"{init['GUT']} * ({_peripheral(z)}) + {c0} * K12 / (b - a) * (exp(-a * {z}) - exp(-b * {z})) "
                f"+ {init['PERI']} * ((b - K21) / (b - a) * exp(-a * {z}) + (a - K21) / (a - b) * exp(-b * {z}))",
        "PARA": f"{init['GUT']} * ({_metabolite(z, 'form', 'kp')}) + {c0} * {formed(from_cent)} "
                f"+ {init['PERI']} * {formed(from_peri)} + {p0} * exp(-kp * {z})"}


_I = _initial(_Z, models.ORAL_ABSTINENT.initial)
_INHALED_PARAMS = f"""
SELECT *, (s + sqrt(s * s - 4 * K21 * ke)) / 2 AS a, (s - sqrt(s * s - 4 * K21 * ke)) / 2 AS b
FROM (SELECT *, K12 + K21 + ke AS s FROM (SELECT *, CL / V1 AS ke, 0.6 * 9.74 / V1 AS K12, 9.74 / 214.0 AS K21 FROM (
  SELECT ID, 3.55 * exp({eta_sql(1)}) AS KA, 0.6 * 76.2 * exp({eta_sql(2)}) AS V1, 0.6 * 8.37 * exp({eta_sql(3)}) AS CL,
    0.0288 * exp({eta_sql(4)}) AS FPX, 0.00342 * exp({eta_sql(5)}) AS FTP, 0.00537 * exp({eta_sql(6)}) AS FTB
  FROM (SELECT DISTINCT ID FROM fx_event))))"""


def _uniform(seed: int, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)"


def _polynomial(row: tuple, r: str) -> str:
    out = f"{row[-1]!r}::DOUBLE"
    for c in reversed(row[:-1]):
        out = f"({out} * {r} + {c!r}::DOUBLE)"
    return out


def _quantile(p: str, source: str, out: str) -> str:
    """``source`` with a column ``out``: the normal quantile of its expression ``p``."""
    ratio = lambda table, r: f"{_polynomial(table[0], r)} / {_polynomial(table[1], r)}"
    return f"""
SELECT * EXCLUDE (_p, _q, _s), CASE WHEN abs(_q) <= 0.425::DOUBLE THEN _q * {ratio(draws.CENTRE, '(0.180625::DOUBLE - _q * _q)')}
  ELSE (CASE WHEN _q < 0 THEN -1 ELSE 1 END) * CASE WHEN _s <= 5 THEN {ratio(draws.MIDDLE, '(_s - 1.6::DOUBLE)')} ELSE {ratio(draws.FAR, '(_s - 5)')} END END AS {out}
FROM (SELECT *, _p - 0.5::DOUBLE AS _q, sqrt(-ln(least(_p, 1 - _p))) AS _s FROM (SELECT *, {p} AS _p FROM {source}))"""


def _normals(source: str, columns: dict[str, str]) -> str:
    """``source`` with a normal column for each uniform."""
    out = f"SELECT * FROM {source}"
    for name, u in columns.items():
        out = _quantile(u, f"({out})", name)
    return out


def _between(low: float, high: float, mu: float, sigma: float, u: str) -> str:
    a, b = (draws.normal_probability((v - mu) / sigma) for v in (low, high))
    return f"({a!r}::DOUBLE + {u} * ({b!r}::DOUBLE - {a!r}::DOUBLE))"


def _weights_sql() -> str:
    mean, sd, low, high = _CLEARANCE
    mu, sigma = population.log_moments(mean, sd)
    return f"""
SELECT ID, round({_WEIGHT[0]} + {_WEIGHT[1]} * z1, 8) AS WT, round(exp({mu!r}::DOUBLE + {sigma!r}::DOUBLE * z2), 8) AS CLCR
FROM ({_normals('(SELECT ID FROM fx_subject)', {'z1': _between(_WEIGHT[2], _WEIGHT[3], *_WEIGHT[:2], _uniform(1, 'ID')),
                                               'z2': _between(math.log(low), math.log(high), mu, sigma, _uniform(5, 'ID'))})})"""


def _redrawn(seed: int, mean, sd, corr, low, high, log: bool, names: list[str]) -> str:
    """Recursive tries of a pair: the next one follows while either coordinate is outside."""
    sigma = [population.log_moments(m, s)[1] for m, s in zip(mean, sd)] if log else sd
    factor = population.cholesky([[corr[i][j] * sigma[i] * sigma[j] for j in range(2)] for i in range(2)])
    sums = [f"{factor[0][0]!r}::DOUBLE * z0", f"({factor[1][0]!r}::DOUBLE * z0 + {factor[1][1]!r}::DOUBLE * z1)"]
    x = [f"{mean[i]} * exp({sums[i]})" if log else f"{mean[i]} + {sums[i]}" for i in range(2)]
    inside = " AND ".join(f"{names[i]} BETWEEN {low[i]} AND {high[i]}" for i in range(2))

    def tried(source: str) -> str:
        z = _normals(source, {f"z{j}": _uniform(seed, "ID", "attempt", str(j)) for j in range(2)})
        return f"SELECT ID, attempt, {names[0]}, {names[1]}, {inside} AS good FROM (SELECT ID, attempt, {x[0]} AS {names[0]}, {x[1]} AS {names[1]} FROM ({z}))"

    this = f"tries_{names[0]}"
    return f"{tried('(SELECT ID, 0 AS attempt FROM fx_subject)')} UNION ALL {tried(f'(SELECT ID, attempt + 1 AS attempt FROM {this} WHERE NOT good)')}"


def _etas_sql(model) -> str:
    numbers = sorted([*model.omega, *[n for block in model.omega_blocks for n in block[0]]])
    z = _normals("(SELECT ID FROM fx_subject)", {f"z{n}": _uniform(1, "ID", str(n)) for n in numbers})
    out = {n: f"{math.sqrt(v)!r}::DOUBLE * z{n}" for n, v in model.omega.items()}
    for ns, block in model.omega_blocks:
        factor = population.cholesky([list(r) for r in block])
        out |= {n: " + ".join(f"{factor[i][j]!r}::DOUBLE * z{ns[j]}" for j in range(i + 1)) for i, n in enumerate(ns)}
    return f"SELECT ID, {', '.join(f'round({out[n]}, 8) AS ETA{n}' for n in numbers)} FROM ({z})"


def _eps_sql() -> str:
    variances = list(models.ORAL_ABSTINENT.sigma.values())
    z = _normals("(SELECT ID, OBS FROM fx_obs)", {f"z{i}": _uniform(2, "ID", "OBS", str(i)) for i in (1, 2)})
    return f"SELECT ID, OBS, {', '.join(f'round({math.sqrt(v)!r}::DOUBLE * z{i}, 8) AS EPS{i}' for i, v in enumerate(variances, 1))} FROM ({z})"


ORACLES = {
    "superposed_oral": query(f"""
SELECT ID, REC, round((CENT + {_I['CENT']}) / V1, 6) AS IPRECA, round((PARA + {_I['PARA']}) / V2, 6) AS IPREPX,
  round(GUT + {_I['GUT']}, 6) AS GUT, round(PERI + {_I['PERI']}, 6) AS PERI
FROM pairs JOIN (SELECT ID, REC, tick FROM fx_event) o USING (ID, REC) JOIN params USING (ID)""", "fx_event",
                             params=_params(3.65), pairs=_pairs({
                                 "CENT": _central(_T), "PARA": _metabolite(_T, "form", "kp"),
                                 "GUT": f"exp(-KA * {_T})", "PERI": _peripheral(_T)}, "TLAG")),
    "superposed_gum": query("""
SELECT ID, REC, round(CENT / V1, 6) AS IPRECA, round(PARA / V2, 6) AS IPREPX FROM pairs JOIN params USING (ID)""", "fx_event",
                            params=_params(3.95), pairs=_pairs({
                                "CENT": _central(_T, "0.77"),
                                "PARA": _metabolite(_T, "form", "kp", "0.77")}, "TLAG")),
    "superposed_inhaled": query("""
SELECT ID, REC, round(CENT / V1, 6) AS IPRECA, round(PARA / V1, 6) AS IPREPX, round(THPH / V1, 6) AS IPRETP, round(THBR / V1, 6) AS IPRETB
FROM pairs JOIN params USING (ID)""", "fx_event", params=_INHALED_PARAMS, pairs=_pairs({
        "CENT": _central(_T0), "PARA": _metabolite(_T0, "CL * FPX", "0.308"),
        "THPH": _metabolite(_T0, "CL * FTP", "0.313"),
        "THBR": _metabolite(_T0, "CL * FTB", "0.117")}, "0")),
    "truncated_weights": query(_weights_sql(), "fx_subject"),
    "truncated_pairs": query("""
SELECT a.ID, round(WT, 8) AS WT, round(HT, 8) AS HT, round(CL, 8) AS CL, round(V, 8) AS V
FROM (SELECT * FROM tries_WT WHERE good) a JOIN (SELECT * FROM tries_CL WHERE good) b USING (ID)""", "fx_subject", recursive=True,
                             tries_WT=_redrawn(1, *_BODY, False, ["WT", "HT"]), tries_CL=_redrawn(9, *_RARE, True, ["CL", "V"])),
    "drawn_etas": query(_etas_sql(models.ORAL_ABSTINENT), "fx_subject"),
    "drawn_eta_blocks": query(_etas_sql(models.INHALED), "fx_subject"),
    "drawn_eps": query(_eps_sql(), "fx_obs"),
}

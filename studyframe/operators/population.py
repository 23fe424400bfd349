"""Random population tables: one narrow projection each, repeatable per key.

The random stream of any other tool is not reproduced; the distributions are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.functions.draws import normal, normal_probability, normal_quantile, uniform
from studyframe.functions.kernel import LinearModel
from studyframe.operators.grids import spread
from studyframe.session import cut_lineage

#: Draws tried in the first pass over the keys, and at most in a later one.
FIRST_ATTEMPTS, MOST_ATTEMPTS = 2, 256


def log_moments(mean: float, sd: float) -> tuple[float, float]:
    """Mean and sd of the log whose exponential has the given mean and sd."""
    return (math.log(mean ** 2 / math.sqrt(sd ** 2 + mean ** 2)),
            math.sqrt(math.log(sd ** 2 / mean ** 2 + 1)))


def cholesky(matrix: list[list[float]]) -> list[list[float]]:
    """Lower factor of a small covariance matrix, for use as column literals."""
    size = len(matrix)
    low = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i + 1):
            rest = matrix[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
            if i == j:
                if rest <= 0:
                    raise ValueError("covariance matrix is not positive definite")
                low[i][i] = math.sqrt(rest)
            else:
                low[i][j] = rest / low[j][j]
    return low


def trunc_normal(ids: DataFrame, key: str, out: str, mean: float, sd: float, low: float,
                 high: float, log: bool = False, seed: int = 1) -> DataFrame:
    """Normal (or moment-matched log-normal) draws inside [low, high], one uniform each.

    The uniform is laid over the probabilities between the bounds and inverted, which has the
    distribution of drawing again while outside. A range without any probability is an error.
    """
    low, high = min(low, high), max(low, high)
    mu, sigma = log_moments(mean, sd) if log else (mean, sd)
    edge = (lambda v: math.log(v) if v > 0 else -math.inf) if log else float
    a, b = ((edge(v) - mu) / sigma for v in (low, high))
    # above the mean the small probabilities are those of the mirrored range
    mirrored = a > 0
    first, last = (normal_probability(-b), normal_probability(-a)) if mirrored else (normal_probability(a), normal_probability(b))
    if not last > first:
        raise ValueError(f"{out}: no draw inside the range, it has no probability")
    z = normal_quantile(first + uniform(seed, F.col(key)) * (last - first))
    x = mu + sigma * (-z if mirrored else z)
    return ids.withColumn(out, F.least(F.greatest(F.exp(x) if log else x, F.lit(float(low))), F.lit(float(high))))


def trunc_mvnormal(ids: DataFrame, key: str, outs: list[str], mean: list[float],
                   sd: list[float], corr: list[list[float]], low: list[float],
                   high: list[float], log: bool = False, seed: int = 1) -> DataFrame:
    """Correlated draws; a row is redrawn if any coordinate is outside its range.

    With ``log`` a coordinate is ``mean * exp(N(0, cov))``: the mean acts as the median. Keys
    without an accepted draw go on to the next pass, a shrinking table in the shared folder, until
    none is left. A range without any probability in one coordinate is an error.
    """
    size = len(mean)
    if not len(sd) == len(low) == len(high) == len(outs) == size:
        raise ValueError("every coordinate needs a name, a mean, an sd and two bounds")
    if len(corr) != size or any(len(r) != size for r in corr):
        raise ValueError("the correlations need a row and a column for each coordinate")
    sigma = [log_moments(m, s)[1] for m, s in zip(mean, sd)] if log else sd
    factor = cholesky([[corr[i][j] * sigma[i] * sigma[j] for j in range(size)]
                       for i in range(size)])
    for i in range(size):
        centred = [math.log(max(v, 1e-300) / mean[i]) if log else v - mean[i] for v in (low[i], high[i])]
        a, b = centred if centred[0] <= 0 else (-centred[1], -centred[0])
        if not normal_probability(b / sigma[i]) > normal_probability(a / sigma[i]):
            raise ValueError(f"{outs[i]}: no draw inside the range, it has no probability")

    def moved(z: Column) -> Column:
        coords = []
        for i in range(size):
            x = sum((factor[i][j] * z[j] for j in range(i + 1)), start=F.lit(0.0))
            coords.append(mean[i] * F.exp(x) if log else mean[i] + x)
        return F.array(*coords)

    def accepted(d: Column) -> Column:
        ok = F.lit(True)
        for i in range(size):
            ok = ok & d[i].between(low[i], high[i])
        return ok

    def draw(found: Column, attempt: Column) -> Column:
        # each lambda binds its value, so every uniform is hashed once and nothing is drawn after the first success
        z = F.transform(F.array(*[uniform(seed, F.col(key), attempt, F.lit(j)) for j in range(size)]), normal_quantile)
        return F.coalesce(found, F.get(F.filter(F.transform(F.array(z), moved), accepted), F.lit(0)))

    done, todo, attempt, more = [], ids.drop(*outs), 0, FIRST_ATTEMPTS
    while True:
        tries = F.sequence(F.lit(attempt), F.lit(attempt + more - 1))
        tried = cut_lineage(todo.withColumn("_draw", F.aggregate(tries, F.lit(None).cast("array<double>"), draw)))
        done.append(tried.filter("_draw IS NOT NULL"))
        left = tried.filter("_draw IS NULL").drop("_draw")
        if left.isEmpty():
            break
        # the first pass may have come from one small file, whose rows can still need very many draws
        todo, attempt, more = spread(left), attempt + more, min(4 * more, MOST_ATTEMPTS)
    found = reduce(DataFrame.unionByName, done)
    return found.withColumns({name: F.col("_draw")[i] for i, name in enumerate(outs)}).drop("_draw")


def draw_etas(ids: DataFrame, key: str, model: LinearModel, seed: int = 1) -> DataFrame:
    """``ETAn`` columns: independent variances and correlated blocks of the model."""
    etas = {n: math.sqrt(v) * normal(seed, F.col(key), F.lit(n)) for n, v in model.omega.items()}
    for numbers, block in model.omega_blocks:
        factor = cholesky([list(r) for r in block])
        z = [normal(seed, F.col(key), F.lit(n)) for n in numbers]
        for i, n in enumerate(numbers):
            etas[n] = sum((factor[i][j] * z[j] for j in range(i + 1)), start=F.lit(0.0))
    return ids.withColumns({f"ETA{n}": etas[n] for n in sorted(etas)})


def draw_eps(rows: DataFrame, keys: list[str], model: LinearModel, seed: int = 2) -> DataFrame:
    """``EPSn`` columns per observation row."""
    parts = [F.col(k) for k in keys]
    return rows.withColumns({
        f"EPS{i}": math.sqrt(v) * normal(seed, *parts, F.lit(i))
        for i, v in enumerate(model.sigma.values(), start=1)})


def individual_params(population: DataFrame, model: LinearModel) -> DataFrame:
    """``typical * exp(ETA)`` per parameter, times bioavailability where it applies."""
    by_name = {p: n for n, p in model.etas.items()}
    params = {}
    for name, typical in model.typical.items():
        value = F.lit(typical * model.bioavailability.get(name, 1.0))
        params[name] = value * F.exp(F.col(f"ETA{by_name[name]}")) if name in by_name else value
    return population.withColumns(params)


def initial_amounts(population: DataFrame, model: LinearModel, empty: bool = False) -> DataFrame:
    """``<compartment>_0`` columns: the model's amounts (with their ETAs), or all zero."""
    by_name = {c: n for n, c in model.initial_etas.items()}
    amounts = {}
    for c, amount in model.initial.items():
        value = F.lit(0.0 if empty else amount)
        drawn = c in by_name and not empty
        amounts[f"{c}_0"] = value * F.exp(F.col(f"ETA{by_name[c]}")) if drawn else value
    return population.withColumns(amounts)

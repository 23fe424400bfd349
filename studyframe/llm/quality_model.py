"""Quality classifier: a sparse rule ensemble compiled to one Spark column.

Boosted trees are grown on the statistics of a bounded sample of labelled rows; each path from a root to a node is a conjunctive rule. A logistic model
with an L1 penalty weighs the rules, which leaves few, and those become conditional sums in Spark. Only the sample (SAMPLE_ROWS rows of ten numbers) comes to
the driver; scoring is a projection without a shuffle.

Cases: null and empty texts have all statistics 0 and get a score; repeated rows and tied ids each give a row; an empty table gives no rows; without labels or
with one class the score is the share of good rows (1.0 if unknown); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.llm import features
from studyframe.llm.work import id_remainder

NAMES = features.STATISTICS
#: Labelled rows the model is fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 64, 0.3
PENALTY = 1e-3
CUT = 0.3

Path = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """``bias`` plus the weight of each rule that holds, through the logistic function."""

    bias: float
    rules: tuple[tuple[Path, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for path, weight in self.rules:
            total = total + F.when(_column(path), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _column(path: Path) -> Column:
    out = F.lit(True)
    for k, above, value in path:
        out = out & (F.col(NAMES[k]) > value if above else F.col(NAMES[k]) <= value)
    return out


def _mask(path: Path, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, value in path:
        out &= x[:, k] > value if above else x[:, k] <= value
    return out


def _split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """Best (gain, statistic, bin) of a second-order split of ``rows``."""
    best = (1e-6, -1, -1)
    g0, h0 = grad[rows].sum(), hess[rows].sum()
    for k in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[rows, k], grad[rows], BINS + 1))[:-1]
        h = np.cumsum(np.bincount(bins[rows, k], hess[rows], BINS + 1))[:-1]
        gain = g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1)
        gain[(h < 1) | (h0 - h < 1)] = 0
        if (b := int(gain.argmax())) >= 0 and gain[b] > best[0]:
            best = (float(gain[b]), k, b)
    return best


def _paths(x: np.ndarray, y: np.ndarray) -> list[Path]:
    """Every root-to-node path of trees boosted on the logistic loss."""
    seen = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1), method="nearest")) for k in range(x.shape[1])]
    cuts = [(v[1:] + v[:-1]) / 2 for v in seen]
    bins = np.stack([np.searchsorted(cuts[k], x[:, k]) for k in range(x.shape[1])], 1)
    total, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        step, level = np.zeros(len(y)), [((), np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for path, rows in level:
                gain, k, b = _split(bins, grad, hess, rows) if depth < DEPTH else (0, -1, -1)
                if k < 0 or b >= len(cuts[k]):
                    step[rows] = -RATE * grad[rows].sum() / (hess[rows].sum() + 1)
                    continue
                left = bins[rows, k] <= b
                for above, part in ((False, rows[left]), (True, rows[~left])):
                    below.append(((*path, (k, above, float(cuts[k][b]))), part))
            found += [path for path, _ in below]
            level = below
        total = total + step
    return list(dict.fromkeys(found))


def _lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the L1 logistic loss; the bias isn't penalised."""
    a = np.hstack([np.ones((len(y), 1)), r])
    rate = 4.0 / np.linalg.eigvalsh(a.T @ a / len(y))[-1]
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(1500):
        p = 1 / (1 + np.exp(-(a @ z)))
        new = z - rate * (a.T @ (p - y) / len(y))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * PENALTY, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``rows`` labelled documents, taken by the hash of their id."""
    sample = features.labelled_sample(docs, labels, "quality", rows)
    known = (features.with_statistics(features.with_counts(sample)).select("doc_id", "label", *[F.col(n).cast("double") for n in NAMES])
             .toPandas().sort_values(["doc_id", *NAMES], kind="stable"))
    x, y = known[NAMES].to_numpy(float), known["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return RuleModel(20.0 if not len(y) or y.max() else -20.0, ())
    paths = _paths(x, y)
    bias, weights = _lasso(np.stack([_mask(p, x) for p in paths], 1).astype(float), y)
    return RuleModel(bias, tuple((p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6))


def apply(docs: DataFrame, model: RuleModel) -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted``."""
    full = features.with_statistics(features.with_counts(docs.select("doc_id", "text")))
    return (full.withColumn("score", model.score())
            .select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= CUT).cast("int").alias("predicted")))


def kept(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The documents predicted good, with the columns they came with.

    The row number keeps the filter above the projection: pushed below, it would hold each statistic once for every rule that names it.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    full = features.with_statistics(features.with_counts(docs.select(own.alias("_row"), F.col("text"))))
    scored = full.select("_row", model.score().alias("_score"), F.monotonically_increasing_id().alias("_nr"))
    return scored.filter((F.col("_score") >= CUT) & (F.col("_nr") >= 0)).select("_row.*")

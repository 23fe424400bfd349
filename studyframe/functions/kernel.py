"""Closed-form responses of the linear dose models, as sums of exponentials.

``with_rates`` reduces an individual-parameter row to the rate constants of a
two-compartment model with first-order input and any number of metabolites fed from the
central compartment. Every response is then a list of terms ``(coefficient, rate name)``
whose value at elapsed time t is ``sum(coefficient * exp(-rate * t))``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = tuple[Column, str]
ORIGINS = ("GUT", "CENT", "PERI")


@dataclass(frozen=True)
class LinearModel:
    """Expressions over individual-parameter columns, plus the published typical values.

    ``metabolites`` maps a compartment to (formation rate per central amount, elimination
    rate, volume). ``etas`` maps ETA number to parameter; ``outputs`` names the predicted
    concentrations.
    """

    typical: dict[str, float]
    etas: dict[int, str]
    omega: dict[int, float]
    initial: dict[str, float]
    eliminated: str
    k12: str
    k21: str
    metabolites: dict[str, tuple[str, str, str]]
    sigma: dict[str, float]
    lag: str = "0.0"
    fraction: float = 1.0
    bioavailability: dict[str, float] = field(default_factory=dict)
    initial_etas: dict[int, str] = field(default_factory=dict)
    omega_blocks: tuple[tuple[tuple[int, ...], tuple[tuple[float, ...], ...]], ...] = ()
    exponential_residual: bool = False
    lloq: float = 0.05

    @property
    def compartments(self) -> list[str]:
        return ["GUT", "CENT", "PERI", *self.metabolites]

    @property
    def rates(self) -> list[str]:
        return ["_ka", "_a", "_b", *[f"_out_{m}" for m in self.metabolites]]


def _apart(rate: Column, *others: str) -> Column:
    """Nudge a rate off those it nearly equals (the responses divide by differences)."""
    clash = F.lit(False)
    for other in others:
        clash = clash | (F.abs(rate - F.col(other)) < 1e-9 * F.col(other))
    return F.when(clash, rate * (1 + 4e-9)).otherwise(rate)


def with_rates(params: DataFrame, model: LinearModel) -> DataFrame:
    """Add ``_ka _k12 _k21 _a _b _lag`` and per-metabolite formation/elimination columns.

    Compute them per subject, below an aggregate or an explode: a filter on a response is
    then rewritten over plain rate columns and not over the whole derivation.
    """
    if "_a" in params.columns:
        return params
    out = params.withColumns({"_ke": F.expr(model.eliminated), "_k12": F.expr(model.k12),
                              "_k21": F.expr(model.k21), "_lag": F.expr(model.lag)})
    total = F.col("_k12") + F.col("_k21") + F.col("_ke")
    out = out.withColumns({
        "_a": (total + F.sqrt(total * total - 4 * F.col("_k21") * F.col("_ke"))) / 2})
    # product of the roots gives the slow one without cancellation
    out = out.withColumn("_b", F.col("_k21") * F.col("_ke") / F.col("_a"))
    out = out.withColumn("_ka", _apart(F.col("KA"), "_a", "_b"))
    for name, (formation, elimination, _) in model.metabolites.items():
        out = out.withColumns({
            f"_form_{name}": F.expr(formation),
            f"_out_{name}": _apart(F.expr(elimination), "_ka", "_a", "_b")})
    return out


def response(model: LinearModel, origin: str) -> dict[str, list[Term]]:
    """Terms of the amount in every compartment per unit placed in ``origin``."""
    ka, k12, k21, a, b = (F.col(c) for c in ("_ka", "_k12", "_k21", "_a", "_b"))
    if origin == "GUT":
        given = model.fraction * ka
        slots = [(given / ((a - ka) * (b - ka)), ka, "_ka"),
                 (given / ((ka - a) * (b - a)), a, "_a"),
                 (given / ((ka - b) * (a - b)), b, "_b")]
        central = [(w * (k21 - r), name) for w, r, name in slots]
        peripheral = [(w * k12, name) for w, _, name in slots]
        gut = [(F.lit(1.0), "_ka")]
    elif origin == "CENT":
        central = [((k21 - a) / (b - a), "_a"), ((k21 - b) / (a - b), "_b")]
        peripheral = [(k12 / (b - a), "_a"), (k12 / (a - b), "_b")]
        gut = []
    else:
        central = [(k21 / (b - a), "_a"), (k21 / (a - b), "_b")]
        peripheral = [((b - k21) / (b - a), "_a"), ((a - k21) / (a - b), "_b")]
        gut = []
    out = {"GUT": gut, "CENT": central, "PERI": peripheral}
    for name in model.metabolites:
        leaving = f"_out_{name}"
        fed = [(F.col(f"_form_{name}") * c / (F.col(leaving) - F.col(r)), r)
               for c, r in central]
        out[name] = [*fed, (-sum((c for c, _ in fed), start=F.lit(0.0)), leaving)]
    return out


def evaluate(terms: list[Term], elapsed: Column) -> Column:
    return sum((c * F.exp(-F.col(r) * elapsed) for c, r in terms), start=F.lit(0.0))


def coefficient(terms: list[Term], rate: str) -> Column:
    """The coefficient of one exponential in a response."""
    return sum((c for c, r in terms if r == rate), start=F.lit(0.0))


def from_initial(model: LinearModel, initial: dict[str, Column]) -> dict[str, list[Term]]:
    """Terms of every compartment given amounts present at time zero."""
    out: dict[str, list[Term]] = {c: [] for c in model.compartments}
    for origin, amount in initial.items():
        if origin in model.metabolites:
            out[origin].append((amount, f"_out_{origin}"))
            continue
        for compartment, terms in response(model, origin).items():
            out[compartment] += [(amount * c, r) for c, r in terms]
    return out

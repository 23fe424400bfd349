"""Quality rules: a decision list learned by sequential covering, emitted as one ordered Spark conditional.

Everything runs as DataFrame functions. A rule is a conjunction of thresholds on text statistics. Rules that reject are grown one condition at a time
on a growing set (information gain of the class "low quality"), then pruned on a separate set; the rows a rule covers leave before the next rule grows.
Each step is one aggregation of (statistic, bin) counts, so the driver sees at most statistics x bins rows, whatever the sample.

Cases: null or empty text has no words and fails the base; repeated rows and tied ids each give their own row; an empty table gives no rows; no labels,
or one class only, give an empty list, which keeps all that passes the base; other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.llm import features
from studyframe.llm.work import handed_off, id_remainder

NAMES = [*features.STATISTICS[1:], features.REPEAT]
#: Labelled rows the list is learned from, at most.
SAMPLE_ROWS = 20_000
BINS = 48
MAX_RULES = 16
MAX_CONDITIONS = 4
#: A rule must be this pure on the pruning rows, and cover so many low-quality growing rows.
MIN_PRECISION = 0.9
MIN_COVER = 5


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.value) if self.above else F.col(self.name) <= F.lit(self.value)


Rule = tuple[Condition, ...]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(holds(rule), F.lit(k)) if out is None else out.when(holds(rule), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < F.col(name)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Adds the condition of highest gain until no kept-class row is covered or no condition gains."""
    rule: Rule = ()
    for _ in range(MAX_CONDITIONS):
        counts = (rows.filter(holds(rule)).select("label", F.posexplode("bins").alias("stat", "bin")).groupBy("stat", "bin")
                  .agg(F.sum(1 - F.col("label")).alias("p"), F.sum("label").alias("n")).collect())
        by = {(r["stat"], r["bin"]): (r["p"], r["n"]) for r in counts}
        p0 = sum(v[0] for k, v in by.items() if k[0] == 0)
        n0 = sum(v[1] for k, v in by.items() if k[0] == 0)
        if not p0 or not n0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for s, name in enumerate(NAMES):
            p = n = 0
            for b, value in enumerate(cuts[name]):
                dp, dn = by.get((s, b), (0, 0))
                p, n = p + dp, n + dn
                for above, (a, c) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if a >= MIN_COVER and (g := _gain(a, c, p0, n0)) > best[0]:
                        best = (g, Condition(name, above, value))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The leading part of the rule with the best (p - n) / (p + n), and its precision, on the pruning rows."""
    if not rule:
        return rule, 0.0
    sums = rows.agg(*[F.sum(F.when(holds(rule[:k]), 1 - F.col("label")).otherwise(0)).alias(f"p{k}") for k in range(1, len(rule) + 1)],
                    *[F.sum(F.when(holds(rule[:k]), F.col("label")).otherwise(0)).alias(f"n{k}") for k in range(1, len(rule) + 1)]).first()
    worth = []
    for k in range(1, len(rule) + 1):
        p, n = sums[f"p{k}"] or 0, sums[f"n{k}"] or 0
        worth.append((((p - n) / (p + n) if p + n else -1.0), -k, p / (p + n) if p + n else 0.0))
    _, k, precision = max(worth)
    return rule[:-k], precision


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Decision list from at most ``rows`` labelled documents that pass the base; a third of them prunes what the rest grows."""
    sample = features.labelled_sample(docs, labels, "quality", rows)
    known = features.with_statistics(features.with_repeats(features.with_counts(sample)), repeats=True)
    known = handed_off(known.select("label", (id_remainder(F.col("doc_id"), 3) == 1).alias("prunes"), base_failed().alias("failed"), *NAMES),
                       "rule-sample").filter("not failed")
    edges = known.agg(*[F.percentile_approx(x, [(i + 1) / (BINS + 1) for i in range(BINS)], 1000).alias(x) for x in NAMES]).first()
    seen = {x: sorted(set(edges[x] or [])) for x in NAMES}
    cuts = {x: [(a + b) / 2 for a, b in zip(v, v[1:])] for x, v in seen.items()}
    rules: list[Rule] = []
    left = known = handed_off(known.withColumn("bins", F.array(*[_bin(x, cuts[x]) for x in NAMES])).coalesce(1), "rule-bins")
    while len(rules) < MAX_RULES and any(cuts.values()):
        rule, precision = _prune(left.filter("prunes"), _grow(left.filter("not prunes"), cuts))
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~holds(rule))
    return rules


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``rule`` (the first that rejects, 0: none) and ``kept``."""
    full = features.with_statistics(features.with_repeats(features.with_counts(docs.select("doc_id", "text"))), repeats=True)
    return (full.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"))

"""Score arithmetic as Column expressions; null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax_by(df: DataFrame, score: str, out: str, *by: str) -> DataFrame:
    """``df`` with (x - min) / (max - min) within each group, 1 where all are equal.

    The bounds are aggregated before they are joined, so a large group isn't brought into one task; null keys are a group."""
    bounds = df.groupBy(*by).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    names = {c: f"__{c}" for c in by}
    bounds = bounds.withColumnsRenamed(names)
    on = [df[c].eqNullSafe(bounds[names[c]]) for c in by]
    joined = df.join(bounds, on) if on else df.crossJoin(bounds)  # one row without groups
    return joined.withColumn(out, scaled(F.col(score), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi", *names.values())


def scaled(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo < 1e-10, 1.0).otherwise((c - lo) / (hi - lo))


def weighted(a: Column, b: Column, wa: float, wb: float) -> Column:
    return wa * a + wb * b


def multiplicative(a: Column, b: Column, alpha: float = 0.5) -> Column:
    return 0.3 * a * b + 0.7 * (alpha * a + (1 - alpha) * b)


def adaptive_weight(fact: Column, dense: Column, complexity: Column) -> Column:
    """The passages' share: more for weak facts, thin passages and simple queries; between 0.1 and 0.5."""
    x = 0.2 + 0.3 * (0.5 - fact) + 0.2 * (0.5 - dense) + 0.1 * (0.5 - complexity)
    return F.least(F.lit(0.5), F.greatest(F.lit(0.1), x))


def needs_fallback(facts: Column, mean: Column, coverage: Column) -> Column:
    """Whether dense retrieval alone answers: no facts, weak ones or too few of them in the graph."""
    return (facts == 0) | (mean < 0.4) | (coverage < 0.1)


def guarded(c: Column) -> Column:
    """0 for null, NaN and negative numbers."""
    return F.when(c.isNull() | F.isnan(c) | (c < 0), 0.0).otherwise(c)


def confidence(first: Column, second: Column) -> Column:
    """0.5 and half of the relative gap of the two best scores, between 0 and 1; 0.5 if there is no second."""
    x = 0.5 + 0.5 * (first - second) / (first + 1e-8)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), F.lit(0.5))


def fusion_weights(a: Column, b: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Weights of two lists from their confidences: each share times ``least``, 0.1 at least, made to sum to 1."""
    total = a + b
    wa, wb = (F.greatest(least * x / total, F.lit(0.1)) for x in (a, b))
    return tuple(F.when(total < 1e-8, 0.5).otherwise(x / (wa + wb)) for x in (wa, wb))


def from_distance(d: Column, metric: str) -> Column:
    """A score that grows with nearness: cosine 1 - d, l2 1 / (1 + d), inner product d itself."""
    return {"cosine": 1 - d, "l2": 1 / (1 + d), "ip": d}[metric]


def weighted_mean(v: Column, w: Column) -> Column:
    """Aggregate: sum of w * v over the sum of w; 0 where that is next to 0 or nothing is given."""
    both = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(both, w))
    return F.when(total > 1e-10, F.sum(F.when(both, v * w)) / total).otherwise(0.0)

"""Mixtures of two normal distributions over short lists of scores, one list for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to variances, steps at most, and the change of a mean that ends the fit.
SLACK, STEPS, SETTLED = 1e-6, 200, 1e-9


def mixtures(scored: DataFrame, group: str, score: str = "score") -> DataFrame:
    """(<group>, n, low, high, low_weight, threshold) of each group's scores.

    Expectation-maximisation for all groups at once: a group's scores are one array, as there are only as
    many as a search fetched, and the steps fold over it within built-in expressions. The parts start
    at the smallest and the largest score with the variance of all. threshold is the midpoint of the two means by
    their weights, which every step keeps at the mean of the scores; the plain midpoint, should it leave
    the means.
    """
    lists = scored.where(F.col(score).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_list(F.col(score).cast("double"))).alias("x"))
    sums = "named_struct('n', 0D, 's', 0D, 'q', 0D)"
    lists = lists.selectExpr(
        f"`{group}`", "x", "cast(size(x) as double) n", "aggregate(x, 0D, (s, v) -> s + v) total", "aggregate(x, 0D, (s, v) -> s + v * v) squares"
    )
    # log odds of the upper part
    odds = "ln(1 - p.w) - 0.5 * ln(p.v2) - (v - p.m2) * (v - p.m2) / (2 * p.v2) - ln(p.w) + 0.5 * ln(p.v1) + (v - p.m1) * (v - p.m1) / (2 * p.v1)"
    share = f"1 / (1 + exp({odds}))"
    folded = f"aggregate(transform(x, v -> named_struct('v', v, 'r', {share})), {sums}, (t, y) -> named_struct('n', t.n + y.r, 's', t.s + y.r * y.v, 'q', t.q + y.r * y.v * y.v))"
    low, high = "greatest(t.n, 1e-12D)", "greatest(n - t.n, 1e-12D)"
    m1, m2 = f"t.s / {low}", f"(total - t.s) / {high}"
    after = (
        f"named_struct('w', least(greatest(t.n / n, 1e-12D), 1 - 1e-12D), 'm1', {m1}, 'v1', greatest(t.q / {low} - pow({m1}, 2), 0D) + {SLACK!r}D, "
        f"'m2', {m2}, 'v2', greatest((squares - t.q) / {high} - pow({m2}, 2), 0D) + {SLACK!r}D, "
        f"'still', greatest(abs({m1} - p.m1), abs({m2} - p.m2)) >= {SETTLED!r}D)"
    )
    spread = f"greatest(squares / n - pow(total / n, 2), 0D) + {SLACK!r}D"
    start = f"named_struct('w', 0.5D, 'm1', x[0], 'v1', {spread}, 'm2', x[size(x) - 1], 'v2', {spread}, 'still', true)"
    fitted = lists.selectExpr("*", f"aggregate(sequence(1, {STEPS}), {start}, (p, i) -> if(p.still, transform(array({folded}), t -> {after})[0], p)) f")
    middle = "f.w * f.m1 + (1 - f.w) * f.m2"
    ends = "least(f.m1, f.m2) low", "greatest(f.m1, f.m2) high"
    fitted = fitted.selectExpr(f"`{group}`", "cast(n as long) n", *ends, "if(f.m1 <= f.m2, f.w, 1 - f.w) low_weight", f"{middle} middle")
    return fitted.selectExpr(
        f"`{group}`", "n", "low", "high", "low_weight", "if(middle between low - 1e-12D and high + 1e-12D, middle, (low + high) / 2) threshold"
    )

"""Expressions on success potentials: k successes of N rollouts, drops, and answers at k samples."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rollouts at a position, least drop, and the one-sided 5 % quantile of the test.
ROLLOUTS, LEAST_DROP, Z = 64, 0.1, 1.645
#: Binary entropy at these probabilities bounds the low-entropy class (the first is the default).
ENTROPY_AT = (0.99, 0.95, 0.90)


def binary_entropy(p: float) -> float:
    """Entropy in nats of a coin with probability p."""
    return -(p * math.log(p) + (1 - p) * math.log(1 - p))


LOW_ENTROPY = binary_entropy(ENTROPY_AT[0])


def binary_entropy_col(p: Column) -> Column:
    q = 1 - p
    return -(p * F.log(p) + q * F.log(q))


def score_to_k(score: Column, n: int = ROLLOUTS) -> Column:
    """Successes of n rollouts: half-even rounding, clamped to 0..n; -1 for null."""
    k = F.bround(score * n).cast("int")
    return F.when(score.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(n), k)))


def is_cliff(k_prev: Column, k_now: Column, n: int = ROLLOUTS, least_drop: float = LEAST_DROP, z: float = Z) -> Column:
    """Whether the drop from k_prev to k_now of n is larger than least_drop by z standard errors (unpooled, strictly)."""
    p, q = k_prev / F.lit(float(n)), k_now / F.lit(float(n))
    drop = p - q
    bound = F.lit(least_drop) + F.lit(z) * F.sqrt(p * (1 - p) / n + q * (1 - q) / n)
    valid = (k_prev > 0) & (k_now >= 0) & (k_prev <= n) & (k_now <= n)
    return F.coalesce(valid & (drop > least_drop) & (drop > bound), F.lit(False))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k): 0 without successes, 1 where fewer than k failures exist."""
    kept = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - c - i) / F.greatest(n - i, F.lit(1)))
    return F.when(c <= 0, 0.0).when((c >= n) | (n - c < k), 1.0).otherwise(1 - kept)


def taxonomy(entropy: Column, is_greedy: Column, bound: float = LOW_ENTROPY) -> Column:
    """deterministic, uncertain or sampled_off; low entropy without greedy is other."""
    low = entropy <= bound
    return F.when(low & is_greedy, "deterministic").when(~low & is_greedy, "uncertain").when(~low & ~is_greedy, "sampled_off").otherwise("other")


def cell_label(entropy: Column, is_greedy: Column, bound: float = LOW_ENTROPY) -> Column:
    side = F.when(entropy <= bound, F.lit("low-H")).otherwise(F.lit("high-H"))
    return F.concat(side, F.lit(" + "), F.when(is_greedy, F.lit("greedy")).otherwise(F.lit("non-greedy")))


def recovery_rate(greedy: Column, at: Column, before: Column) -> Column:
    """Share of a drop that the greedy token wins back; 0 where there is no drop."""
    drop = before - at
    return F.when(drop > 0, (greedy - at) / drop).otherwise(F.lit(0.0))


def region(position: Column, total: Column) -> Column:
    """Third of the path."""
    share = position / total
    return F.when(share < F.lit(1.0) / 3, "early").when(share < F.lit(2.0) / 3, "middle").otherwise("late")

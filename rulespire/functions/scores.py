"""Split scores as Column expressions over class counts.

``tp``/``tn`` are the positives/negatives of a node, ``ip``/``ineg`` those on the
true side of a rule. Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _plogp(part: Column, total: Column) -> Column:
    share = part / total
    return F.when(part > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def entropy(pos: Column, neg: Column) -> Column:
    """Binary entropy in bits; 0 for an empty or pure set."""
    total = pos + neg
    mixed = _plogp(pos, total) + _plogp(neg, total)
    return F.when((pos > 0) & (neg > 0), mixed).otherwise(F.lit(0.0))


def information_gain(tp: Column, tn: Column, ip: Column, ineg: Column) -> Column:
    """Entropy drop of a two-way split; -1 when a side is empty, never below 0."""
    total, inside = tp + tn, ip + ineg
    outside = total - inside
    drop = (
        entropy(tp, tn)
        - inside / total * entropy(ip, ineg)
        - outside / total * entropy(tp - ip, tn - ineg)
    )
    return F.when((inside <= 0) | (outside <= 0), F.lit(-1.0)).otherwise(F.greatest(drop, F.lit(0.0)))


def gain_ratio(tp: Column, tn: Column, ip: Column, ineg: Column) -> Column:
    """Gain over split information; -1 without gain, plain gain for a tiny denominator."""
    gain = information_gain(tp, tn, ip, ineg)
    info = entropy(ip + ineg, tp + tn - ip - ineg)
    return (
        F.when(gain <= 0, F.lit(-1.0))
        .when(info <= 1e-10, gain)
        .otherwise(gain / info)
    )


def gain_left(gain: Column, arity: Column | int, n: Column) -> Column:
    """Gain less a BIC term with (arity + 1) degrees of freedom."""
    arity = arity if isinstance(arity, Column) else F.lit(arity)
    return gain - (arity + 1.0) * F.log(F.greatest(n.cast("double"), F.lit(2.0))) / (2.0 * n)


def penalized_gain(gain: Column, arity: Column | int, n: Column) -> Column:
    """What ``gain_left`` leaves; -1 when nothing is left."""
    left = gain_left(gain, arity, n)
    return F.when((gain <= 0) | (n <= 0) | (left <= 0), F.lit(-1.0)).otherwise(left)


def gini(pos: Column, neg: Column) -> Column:
    """Weighted Gini impurity of a segment (count times impurity)."""
    total = pos + neg
    return F.when(total > 0, 2.0 * pos * neg / total).otherwise(F.lit(0.0))


def laplace_proba(pos: Column, n: Column, alpha: float = 1.0) -> Column:
    """Smoothed share of positives."""
    return (pos + F.lit(alpha)) / (n + F.lit(2 * alpha))


def clipped(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    """Loss of one row; average it for the log-loss of a table."""
    q = clipped(p, eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def sigmoid(z: Column, limit: float = 500.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-limit)), F.lit(limit))))


def log_odds(p: Column, eps: float = 1e-7) -> Column:
    q = clipped(p, eps)
    return F.log(q / (1.0 - q))


def digamma(n: Column) -> Column:
    """Digamma function of a number of 1 and more: six steps of its recurrence, then the asymptotic series (1e-10)."""
    x = n + F.lit(6.0)
    steps = sum((1.0 / (n + F.lit(float(i))) for i in range(1, 6)), 1.0 / n)
    series = 1.0 / 12.0 - (1.0 / 120.0 - (1.0 / 252.0 - 1.0 / (240.0 * x * x)) / (x * x)) / (x * x)
    return F.log(x) - 1.0 / (2.0 * x) - series / (x * x) - steps

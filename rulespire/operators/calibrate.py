"""Probability calibration and reliability.

Tree scores take few distinct values, so fits work on (probability, label) counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rulespire.functions.scores import log_odds, sigmoid
from rulespire.operators.scan import prefix_sums, splitters
from rulespire.session import ship_package


def platt_fit(df: DataFrame, p: str, y: str, steps: int = 50, tol: float = 1e-10) -> tuple[float, float]:
    """(a, b) minimizing the log-loss of sigmoid(a * logit(p) + b) by damped Newton steps.

    Every step is one aggregation of gradient and Hessian.
    """
    x = log_odds(F.col(p))
    points = df.groupBy(x.alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    a, b = 1.0, 0.0
    try:
        for _ in range(steps):
            s = sigmoid(F.lit(a) * F.col("x") + F.lit(b), 30.0)
            r = F.col("w") * (s - F.col("y"))
            h = F.col("w") * F.greatest(s * (1 - s), F.lit(1e-9))
            g = points.agg(
                F.sum(r * F.col("x")).alias("ga"), F.sum(r).alias("gb"), F.sum(h * F.col("x") * F.col("x")).alias("haa"),
                F.sum(h * F.col("x")).alias("hab"), F.sum(h).alias("hbb")).first()
            haa, hbb, hab = g["haa"] + 1e-9, g["hbb"] + 1e-9, g["hab"]
            det = haa * hbb - hab * hab
            if abs(det) < 1e-12:
                break
            da, db = (hbb * g["ga"] - hab * g["gb"]) / det, (haa * g["gb"] - hab * g["ga"]) / det
            size = max(1.0, abs(da) / 5, abs(db) / 5)  # keep steps short far from the optimum
            a, b = a - da / size, b - db / size
            if abs(da) + abs(db) < tol:
                break
    finally:
        points.unpersist()
    return a, b


def platt_apply(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * log_odds(p) + F.lit(b), 30.0)


#: Digits of the probabilities that a monotone fit tells apart: at most a million groups, whatever the rows.
MONOTONE_DIGITS = 6


def _pool(batches):
    """Pool adjacent violators over (lo, hi, n, pos) in order: neighbours whose rates don't rise become one block."""
    lo, hi, n, pos = [], [], [], []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "n", "pos"))):
            for held, v in zip((lo, hi, n, pos), row):
                held.append(v)
            while len(n) > 1 and pos[-2] * n[-1] >= pos[-1] * n[-2]:
                n[-2:], pos[-2:] = [n[-2] + n[-1]], [pos[-2] + pos[-1]]
                hi[-2:] = [hi[-1]]
                lo.pop()
    yield pa.RecordBatch.from_arrays([pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(n, pa.int64()), pa.array(pos, pa.int64())], ["lo", "hi", "n", "pos"])


def monotone_fit(df: DataFrame, p: str, y: str) -> DataFrame:
    """Least-squares rising step function of p: (lo, hi, n, rate) of its blocks.

    Equal probabilities are added up; violators are pooled inside ranges of p and then between the ranges' blocks,
    which gives the same blocks as one sorted pass.
    """
    ship_package(df.sparkSession)
    points = df.groupBy(F.round(F.col(p).cast("double"), MONOTONE_DIGITS).alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    points = points.select("lo", F.col("lo").alias("hi"), "n", "pos")
    schema = "lo double, hi double, n long, pos long"
    ranges = points.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool, schema)
    whole = ranges.repartition(1).sortWithinPartitions("lo").mapInArrow(_pool, schema)
    return whole.select("lo", "hi", "n", (F.col("pos") / F.col("n")).alias("rate"))


def binned_fit(df: DataFrame, p: str, y: str, max_bins: int = 20) -> DataFrame:
    """Equal-count bins by ascending p: (bin, n, mean_p, rate); no rows below two bins.

    Rows with equal p are interchangeable except for their label; within a probability
    value labels are laid out negatives first. Positions come from running sums over
    distinct (p, label), so a value holding most rows is still one row here. A group
    that crosses a bin border is shared out by arithmetic.
    """
    pts = df.groupBy(F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")).withColumn("k", F.lit(0))
    cum = prefix_sums(pts, ["k"], "p", ["n"])
    total = F.col("tot_n")
    bins = F.least(F.lit(max_bins), F.floor(total / 10)).cast("int")
    size = F.floor(total / bins)
    parts = cum.withColumn("bins", bins).filter("bins >= 2").withColumn("size", size)
    # split a value into its negatives and then its positives, with start positions
    start = F.col("cum_n") - F.col("n")
    neg = F.col("n") - F.col("pos")
    parts = parts.select("p", "bins", "size", F.explode(F.array(
        F.struct(F.lit(0).alias("y"), start.alias("s"), (start + neg).alias("e")),
        F.struct(F.lit(1).alias("y"), (start + neg).alias("s"), F.col("cum_n").alias("e")))).alias("g"))
    parts = parts.filter("g.e > g.s")
    bin_of = lambda pos: F.least(F.floor(pos / F.col("size")), F.col("bins") - 1)
    parts = parts.withColumn("bin", F.explode(F.sequence(bin_of(F.col("g.s")), bin_of(F.col("g.e") - 1))))
    lo = F.greatest(F.col("g.s"), F.col("bin") * F.col("size"))
    hi = F.when(F.col("bin") == F.col("bins") - 1, F.col("g.e")).otherwise(F.least(F.col("g.e"), (F.col("bin") + 1) * F.col("size")))
    parts = parts.withColumn("m", hi - lo)
    return parts.groupBy("bin").agg(
        F.sum("m").alias("n"), (F.sum(F.col("p") * F.col("m")) / F.sum("m")).alias("mean_p"),
        (F.sum(F.col("g.y") * F.col("m")) / F.sum("m")).alias("rate"))


def binned_apply(p: Column, knots: Column) -> Column:
    """Linear interpolation over knots array<struct<x,y>> sorted by x; ends are clamped."""
    below = F.filter(knots, lambda k: k.x <= p)
    above = F.filter(knots, lambda k: k.x > p)
    a, b = F.element_at(below, -1), F.get(above, F.lit(0))
    inner = a.y + (b.y - a.y) * (p - a.x) / (b.x - a.x)
    return F.when(F.size(below) == 0, b.y).when(F.size(above) == 0, a.y).otherwise(inner)


def reliability(df: DataFrame, p: str, y: str, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean probability, positive rate and gap per uniform bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibration_error(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean gap over the non-empty bins."""
    return curve.groupBy(*keys).agg(F.avg("gap").alias("ece"))

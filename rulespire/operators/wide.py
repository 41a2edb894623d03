"""Exact best rule over a column of any number of values and one of few.

Values of the wide column are dealt to ordered buckets. Counts of all buckets before give every bucket its start, so that it
is searched alone: an array of its values by the codes of the short column, added up along both, holds the counts of
every quadrant of every pair of midpoints. Buckets grow in number, not in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from rulespire.operators.dense import entropy_of
from rulespire.operators.histograms import class_counts
from rulespire.operators.profile import unpivot
from rulespire.operators.scan import VALUE_BUCKETS, _with_value_bucket, splitters
from rulespire.operators.search import best_per
from rulespire.session import cut_lineage, ship_package

#: Cells of a bucket's array, about, and the most values of a short column.
CELLS, SHORT = 1 << 20, 1024
_BEST = "feature string, region string, t_wide double, t_short double, ip double, ineg double, gain double"


def exact_wide_pairs(df: DataFrame, wide: str, shorts: list[str], regions: list[str], min_leaf: int, y: str = "y") -> DataFrame:
    """(feature, region, t_wide, t_short, ip, ineg, gain): the best cut of ``wide`` with one of ``shorts`` as one row, or none.

    The first letter of a region is the side of ``wide``, L below its cut. Ties go to the earlier name, region and lower cuts.
    Rows with a null or NaN value in either column are not counted.
    """
    long = unpivot(df.withColumn("__w", F.col(wide).cast("double") + F.lit(0.0)), shorts, ["__w", y]).withColumn("value", F.col("value") + F.lit(0.0))
    seen = F.col("__w").isNotNull() & F.col("value").isNotNull() & ~F.isnan("__w") & ~F.isnan("value")
    cells = cut_lineage(class_counts(long.filter(seen), ["feature", "__w", "value"], y))
    sizes = cells.groupBy("feature").agg(F.approx_count_distinct("value").alias("codes"), F.approx_count_distinct("__w").alias("n")).collect()
    if too_many := [r["feature"] for r in sizes if r["codes"] > 1.2 * SHORT]:  # the count is an estimate
        raise ValueError(f"not short: {too_many}")
    totals: dict[str, pd.DataFrame] = {}
    for r in cells.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():  # one row per short value
        totals.setdefault(r["feature"], []).append((r["value"], r["pos"], r["neg"]))
    totals = {f: np.array(sorted(t)) for f, t in totals.items()}
    buckets = max([VALUE_BUCKETS, *[r["n"] * r["codes"] // CELLS for r in sizes]])
    placed = _with_value_bucket(cells, ["feature"], "__w", splitters(cells, ["feature"], "__w", buckets))
    starts, after = _starts(placed)
    none = F.lit(None).cast("double")
    rows = placed.select("feature", "__b", "__w", "value", "pos", "neg").unionByName(starts.select("feature", "__b", none.alias("__w"), "value", "pos", "neg"))
    # the first value of the next bucket ends the last cut of this one
    rows = rows.unionByName(after.select("feature", "__b", F.col("after").alias("__w"), none.alias("value"), none.alias("pos"), none.alias("neg")))
    ship_package(df.sparkSession)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["feature"].iloc[0]
        return pd.DataFrame(_best_in_bucket(f, pdf, totals[f], regions, min_leaf), columns=[c.split(" ")[0] for c in _BEST.split(", ")])

    found = rows.groupBy("feature", "__b").applyInPandas(search, _BEST).withColumns({"k": F.lit(0), "score": F.col("gain")})
    return best_per(found, ["k"], ["feature", "region", "t_wide", "t_short"], digits=9).select(*[c.split(" ")[0] for c in _BEST.split(", ")])


def _starts(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts before every bucket per short value, and the first wide value after every bucket; tables of buckets, not of values."""
    per = cut_lineage(placed.groupBy("feature", "__b", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("__w").alias("first")))
    order = W.partitionBy("feature", "value").orderBy("__b")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    last = per.groupBy("feature").agg(F.max("__b").alias("last"))
    run = per.join(last, "feature").select("feature", "value", "__b", "last", F.lead("__b").over(order).alias("next"), F.sum("pos").over(upto).alias("pos"), F.sum("neg").over(upto).alias("neg"))
    until = F.coalesce("next", "last")
    starts = run.filter(F.col("__b") < until).select("feature", "value", F.explode(F.sequence(F.col("__b") + 1, until)).alias("__b"), "pos", "neg")
    firsts = per.groupBy("feature", "__b").agg(F.min("first").alias("first"))
    # a bucket that starts hold but no value lies in would find no cut: only buckets with values are searched
    after = firsts.select("feature", "__b", F.lead("first").over(W.partitionBy("feature").orderBy("__b")).alias("after"))
    return starts.join(firsts.select("feature", "__b"), ["feature", "__b"], "left_semi"), after


def _best_in_bucket(f: str, pdf: pd.DataFrame, totals: np.ndarray, regions: list[str], min_leaf: int) -> list[tuple]:
    values, w, v = totals[:, 0], pdf["__w"].to_numpy(float), pdf["value"].to_numpy(float)
    start, end = np.isnan(w) & ~np.isnan(v), np.isnan(v)
    here = ~start & ~end
    code = np.searchsorted(values, v)
    own, at = np.unique(w[here], return_inverse=True)
    stop = np.append(own[1:], w[end])
    own_cut = stop == stop
    if len(values) < 2 or not own_cut.any():
        return []
    low, both, columns = {}, {}, {}
    for c, k in (("pos", 1), ("neg", 2)):
        n, x = np.zeros((len(own), len(values))), pdf[c].to_numpy(float)
        np.add.at(n, (at, code[here]), x[here])
        before = np.zeros(len(values))
        np.add.at(before, code[start], x[start])
        run = np.cumsum(np.cumsum(n, axis=0) + before, axis=1)[own_cut]
        both[c], low[c], columns[c] = run[:, :-1], run[:, -1:], np.cumsum(totals[:, k])[:-1]
    tp, tn = totals[:, 1].sum(), totals[:, 2].sum()
    inside = {
        "LL": lambda c, t: both[c], "LH": lambda c, t: low[c] - both[c], "HL": lambda c, t: columns[c] - both[c],
        "HH": lambda c, t: t - low[c] - columns[c] + both[c], "X": lambda c, t: low[c] + columns[c] - 2 * both[c]}
    best: list[tuple] = []
    own, stop = own[own_cut], stop[own_cut]
    for region in sorted(regions):
        ip, ineg = inside[region]("pos", tp), inside[region]("neg", tn)
        m, n = ip + ineg, tp + tn
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = entropy_of(np.array(tp), np.array(tn)) - m / n * entropy_of(ip, ineg) - (n - m) / n * entropy_of(tp - ip, tn - ineg)
        gain = np.where((m >= min_leaf) & (n - m >= min_leaf), gain, 0.0)
        i, j = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
        if gain[i, j] > 0 and (not best or round(gain[i, j], 9) > round(best[0][6], 9)):
            best = [(f, region, (own[i] + stop[i]) / 2, (values[j] + values[j + 1]) / 2, float(ip[i, j]), float(ineg[i, j]), float(gain[i, j]))]
    return best

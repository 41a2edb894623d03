"""Exact pairs with a column of many values, against every pair of midpoints."""

from itertools import product

import numpy as np
import pandas as pd
import pytest

from rulespire.operators.dense import entropy_of
from rulespire.operators.wide import exact_wide_pairs

REGIONS = ["HH", "HL", "LH", "LL", "X"]


def by_pairs(pdf, wide, shorts, regions, min_leaf):
    """(feature, region, cuts, counts, gain) of the best pair, one by one."""
    best = None
    for f, region in product(sorted(shorts), sorted(regions)):
        own = pdf[[wide, f, "y"]].dropna()
        w, v, y = own[wide].to_numpy(), own[f].to_numpy(), own["y"].to_numpy()
        mids = lambda a: (np.unique(a)[1:] + np.unique(a)[:-1]) / 2
        for cw, cv in product(mids(w), mids(v)):
            a, b = w >= cw, v >= cv
            inside = a != b if region == "X" else (a == (region[0] == "H")) & (b == (region[1] == "H"))
            tp, tn, ip, ineg = y.sum(), (1 - y).sum(), y[inside].sum(), (1 - y)[inside].sum()
            m, n = ip + ineg, len(y)
            if m < min_leaf or n - m < min_leaf:
                continue
            gain = float(entropy_of(np.array(tp), np.array(tn)) - m / n * entropy_of(np.array(ip), np.array(ineg)) - (n - m) / n * entropy_of(np.array(tp - ip), np.array(tn - ineg)))
            if round(gain, 9) > (round(best[-1], 9) if best else 0.0):
                best = (f, region, cw, cv, float(ip), float(ineg), gain)
    return best


@pytest.mark.parametrize("seed,regions,parts", [(1, REGIONS[:4], 1), (2, ["X"], 7), (3, ["HL", "LH"], 13)])
def test_equals_every_pair(spark, seed, regions, parts):
    rng = np.random.default_rng(seed)
    n = 400
    pdf = pd.DataFrame({"w": np.where(np.arange(n) % 3 == 0, 8.0, rng.integers(0, 900, n) / 8), "a": rng.integers(0, 6, n) + 0.0, "b": rng.integers(0, 3, n) + 0.0, "one": 1.0})
    pdf["y"] = (((pdf["w"] > 50) != (pdf["a"] >= 4)) ^ (rng.random(n) < 0.1)).astype(int)
    pdf.loc[rng.random(n) < 0.05, "w"] = np.nan
    pdf.loc[rng.random(n) < 0.05, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(parts)
    got = [tuple(r) for r in exact_wide_pairs(df, "w", ["a", "b", "one"], regions, 5).collect()]
    want = by_pairs(pdf, "w", ["a", "b", "one"], regions, 5)
    assert len(got) == 1 and got[0][:2] == want[:2] and got[0][2:] == pytest.approx(want[2:])


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1)] * 9 + [(1.0, 2.0, 0)] * 9, "w double, a double, y int")
    assert exact_wide_pairs(df, "w", ["a"], REGIONS, 2).count() == 0
    assert exact_wide_pairs(df.limit(0), "w", ["a"], REGIONS, 2).count() == 0

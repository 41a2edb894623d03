"""Information from neighbours against all distances, and its use in a fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulespire.config import FitConfig
from rulespire.functions.rules import CONJUI
from rulespire.functions.scores import digamma
from rulespire.operators.neighbours import feature_information, neighbour_information
from rulespire.plans.encode import encode
from rulespire.plans.grow import Grower, fit_tree, root_scores

GAMMA = 0.5772156649015329


def psi(n):
    return -GAMMA + sum(1.0 / i for i in range(1, int(n)))


def by_distances(x, y, k=3):
    """The estimate from the matrix of all distances."""
    ok = np.isfinite(x) & np.isin(y, [c for c in (0, 1) if (y[np.isfinite(x)] == c).sum() > 1])
    x, y = x[ok], y[ok]
    if not len(x):
        return 0.0
    total = 0.0
    for i in range(len(x)):
        far = np.abs(x - x[i])
        own = np.sort(np.delete(far, i)[np.delete(y, i) == y[i]])
        n_c = len(own) + 1
        kk = min(k, n_c - 1)
        r = own[kk - 1]
        used, m = (((far < r) & (y == y[i])).sum(), (far < r).sum()) if r > 0 else (((far == 0) & (y == y[i])).sum(), (far == 0).sum())
        total += psi(used) - psi(m) - psi(n_c)
    return max(psi(len(x)) + total / len(x), 0.0)


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("d")).collect()
    assert max(abs(r["d"] - psi(r["id"])) for r in got) < 1e-9


@pytest.mark.parametrize("parts", [1, 13])
def test_equals_all_distances(spark, parts):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 2, n)
    columns = {
        "wide": rng.integers(0, 1 << 20, n) / 8 + 40000 * y,  # eighths: sums and differences are exact
        "few": rng.integers(0, 5, n) + 0.0,
        "two": (y ^ (rng.random(n) < 0.1)).astype(float),
        "hot": np.where(np.arange(n) % 3 == 0, 7.5, rng.integers(0, 4000, n) / 8),
        "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 100, n) / 4 * (1 + y)),
        "ends": np.where(rng.random(n) < 0.1, np.inf, rng.integers(-9, 9, n)),
        "none": np.full(n, np.nan),
        "same": np.zeros(n),
    }
    frame = spark.createDataFrame(pd.DataFrame({"y": y, **columns})).repartition(parts)
    got = {r["feature"]: r["feature_score"] for r in feature_information(frame, "y", [*columns]).collect()}
    assert got == pytest.approx({f: by_distances(x, y) for f, x in columns.items()}, abs=1e-8)
    assert got["two"] > 0.2 and got["wide"] > 0.05 and got["same"] == got["none"] == 0.0


def test_small_classes_and_nulls(spark):
    rows = [("a", 1.0, 0), ("a", 2.0, 0), ("a", 3.0, 0), ("a", 9.0, 1), ("b", 1.0, 1), ("b", 2.0, 0), ("c", None, 1), ("d", 1.0, 0), ("d", 2.0, 0), ("d", 5.0, 1), ("d", 8.0, 1), ("d", 6.0, None)]
    df = spark.createDataFrame(rows, "k string, value double, y int")
    got = {r["k"]: r["feature_score"] for r in neighbour_information(df, ["k"]).collect()}
    want = by_distances(np.array([1.0, 2.0, 5.0, 8.0]), np.array([0, 0, 1, 1]))
    assert got == pytest.approx({"a": 0.0, "b": 0.0, "c": 0.0, "d": want}, abs=1e-9)
    assert neighbour_information(df.limit(0), ["k"]).count() == 0


def test_scores_of_a_fit(spark):
    """The root ranks its features by neighbours: a column whose bins hide its label still comes first."""
    rng = np.random.default_rng(1)
    n = 2000
    y = rng.integers(0, 2, n)
    stripes = rng.integers(0, 40, n) * 2.0 + y + rng.random(n) * 0.5
    frame = pd.DataFrame({"y": y, "weak": y * 0.3 + rng.random(n), "stripes": stripes, "noise": rng.random(n)})
    df = spark.createDataFrame(frame)
    score = {r["feature"]: r["feature_score"] for r in feature_information(df, "y", ["weak", "stripes", "noise"]).collect()}
    assert max(score, key=score.get) == "stripes"
    for root, first in (("bins", 0), ("neighbours", 1)):
        cfg = FitConfig(family=CONJUI, max_depth=1, n_bins=16, top_k=1, root_score=root)
        enc = encode(df, "y", ["weak", "stripes", "noise"], exact=True, cache=False)
        grower = Grower(enc, cfg, root_scores=root_scores(df, "y", enc.features, cfg))
        grower._search = lambda todo: [seen.append(o.ranked) for o in todo]
        seen = []
        grower.run()
        assert seen == [[first]]
    assert fit_tree(df, "y", enc.features, cfg).nodes[(0, 1)].rule is not None

"""Ranks, running sums, quantiles and splits on skewed data, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulespire.functions.hashing import unit_hash
from rulespire.operators import sampling as S
from rulespire.operators.binning import clean_edges, local_cuts
from rulespire.operators.calibrate import binned_apply, binned_fit, platt_fit
from rulespire.operators.scan import exact_quantiles, prefix_sums, rank_by_hash


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(5)
    n = 3000
    k = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 20, n))
    v = np.where(np.arange(n) % 3 == 0, 7.5, np.round(rng.lognormal(0, 3, n), 3))
    pdf = pd.DataFrame({"id": np.arange(n), "k": k, "v": v, "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def test_rank_by_hash(skewed):
    pdf, df = skewed
    out = rank_by_hash(df.withColumn("u", unit_hash(1, "t", F.col("id"))), ["k"], "u", ["id"], total="n").toPandas()
    want = out.sort_values(["u", "id"]).groupby("k").cumcount() + 1
    assert (out["rank"] == want.reindex(out.index)).all()
    assert (out["n"] == out.groupby("k")["id"].transform("count")).all()


def test_prefix_sums_and_next(skewed):
    pdf, df = skewed
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    out = prefix_sums(counts, ["k"], "v", ["c"]).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    assert (out["cum_c"] == out.groupby("k")["c"].cumsum()).all()
    nxt = out.groupby("k")["v"].shift(-1)
    assert ((out["next_v"] == nxt) | (out["next_v"].isna() & nxt.isna())).all()


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    out = exact_quantiles(df, ["k"], "v", probs).toPandas()
    for (k, i), g in out.groupby(["k", "idx"]):
        assert g["quantile"].iloc[0] == pytest.approx(np.percentile(pdf[pdf.k == k].v, 100 * probs[i]), rel=1e-12)
    assert len(out) == len(probs) * pdf.k.nunique()


def test_split_sizes_exact_and_partition_independent(skewed):
    pdf, df = skewed
    a = S.stratified_split(df, ["k"], "id", 0.2, 3, runs=2).toPandas()
    b = S.stratified_split(df.repartition(1), ["k"], "id", 0.2, 3, runs=2).toPandas()
    key = ["run", "id"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))
    assert len(a) == 2 * len(pdf)
    for (_, k), g in a.groupby(["run", "k"]):
        assert g.is_test.sum() == int(0.2 * len(g) + 0.5)


def test_guarded_split_keeps_both_sides(skewed):
    pdf, df = skewed
    lone = df.unionByName(df.limit(1).withColumn("k", F.lit(999).cast("long")))
    for _, g in S.guarded_split(lone, ["k"], "id", 0.25, 3).toPandas().groupby("k"):
        assert g.is_test.sum() == 0 if len(g) == 1 else 1 <= g.is_test.sum() <= len(g) - 1


def test_folds_differ_by_one(skewed):
    sizes = S.k_folds(skewed[1], "id", 7, 1).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == len(skewed[0])


def test_local_cuts_follow_percentiles(skewed, spark):
    pdf, df = skewed
    hist = df.groupBy(F.col("v").alias("value"), F.lit("f").alias("f")).agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    cuts = local_cuts(hist, ["f"], 16).toPandas().sort_values("threshold")
    v = pdf.v.to_numpy()
    want = np.unique(np.percentile(v, 100 * np.arange(1, 16) / 16))
    want = sorted({(v < t).sum(): t for t in reversed(want) if (v < t).sum()}.values())
    assert np.allclose(cuts.threshold, want)
    for r in cuts.itertuples():
        assert r.cum_pos + r.cum_neg == (v < r.threshold).sum()


def test_binned_calibration_matches_sorted_bins(skewed):
    pdf, df = skewed
    p = (pdf.v.rank(method="dense") / 3000).round(6)
    got = binned_fit(df.withColumn("p", F.col("v") / 100000), "p", "y").toPandas().sort_values("bin")
    o = pdf.assign(p=pdf.v / 100000).sort_values(["p", "y"]).reset_index(drop=True)
    b = np.minimum(np.arange(len(o)) // (len(o) // 20), 19)
    want = o.groupby(b).agg(p=("p", "mean"), y=("y", "mean"))
    assert np.allclose(got.mean_p, want.p) and np.allclose(got.rate, want.y)


def test_binned_apply_is_linear_interpolation(spark):
    xs, ys = [0.1, 0.4, 0.9], [0.2, 0.1, 0.7]
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(xs, ys)])
    pdf = spark.range(101).select((F.col("id") / 100).alias("p")).withColumn("c", binned_apply(F.col("p"), knots)).toPandas()
    assert np.allclose(pdf.c, np.interp(pdf.p, xs, ys))


def test_platt_recovers_known_parameters(spark):
    df = spark.range(40000).withColumn("p", 0.02 + 0.96 * unit_hash(1, "p", F.col("id")))
    z = 1.7 * F.log(F.col("p") / (1 - F.col("p"))) - 0.4
    df = df.withColumn("y", (unit_hash(1, "y", F.col("id")) < 1 / (1 + F.exp(-z))).cast("int")).withColumn("p", F.round("p", 3))
    a, b = platt_fit(df, "p", "y")
    assert a == pytest.approx(1.7, abs=0.1) and b == pytest.approx(-0.4, abs=0.1)


def test_clean_edges(spark):
    df = spark.createDataFrame([([3.0, 3.0],), ([1.0, 5.0, 1.0],), ([4.0, 1.0, 2.0],)], "e array<double>")
    got = [r[0] for r in df.select(clean_edges(F.col("e"))).collect()]
    assert got == [[3.0 - 1e-10, 3.0, 3.0 + 1e-10], [1.0, 3.0, 5.0], [1.0, 2.0, 4.0]]


def test_wide_table(spark):
    """As many columns as the widest shipped task: validated, profiled and summarized."""
    from rulespire.operators import profile as P

    width = 1276
    names = [f"x{i}" for i in range(width)]
    rows = [(k, k % 2, [float((k * 7 + i) % 2) for i in range(width)]) for k in range(178)]
    df = spark.createDataFrame(rows, "rk long, y int, x array<double>").select("rk", "y", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    assert P.require_valid(df, "y", names) == 178
    r = P.task_profile(df.withColumn("task", F.lit("w")), "y", names, ["task"]).first()
    assert (r["n_samples"], r["n_features"], r["is_binary"], r["n_original"]) == (178, width, True, width)


def test_runs_of_a_grid_are_the_stratified_splits(spark):
    from rulespire.plans.grid import _split_runs

    df = spark.range(3000).select(F.col("id").cast("string").alias("rk"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    split, masks = _split_runs(df, "y", "rk", 0.2, 10, 42)
    rows = split.select("rk", F.posexplode(F.array(*masks)).alias("run", "train"))
    want = S.stratified_split(df, ["y"], "rk", 0.2, 42, 10).select("rk", "run", (1 - F.col("is_test").cast("int")).alias("train"))
    assert rows.exceptAll(want).count() == 0 and rows.count() == want.count()

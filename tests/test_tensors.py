"""Exact node-local cuts and dense counts of fits, against SQL on the raw values."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rulespire.config import FitConfig
from rulespire.functions.rules import CONJUI, HORN, Literal, Rule
from rulespire.plans import grow
from rulespire.plans import tensors as T
from rulespire.plans.encode import encode
from rulespire.plans.grow import Grower, OpenNode, fit_tree
from rulespire.plans.model import Node

BINS = 16


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 150_000
    a = rng.permutation(n) / 7.0  # every value once
    b = np.where(rng.random(n) < 0.4, 1.25, np.round(rng.lognormal(size=n), 5))  # a hot value and a long tail
    d = rng.integers(0, 6000, n).astype(float)
    e = rng.integers(0, 9, n).astype(float)
    y = ((a > 9000.3) & (b < 1.7) | (d < 25)) ^ (rng.random(n) < 0.05)
    return pd.DataFrame({"a": a, "b": b, "d": d, "e": e, "y": y.astype(int)})


def sql_cuts(pdf, where, f):
    """(threshold, positives below, negatives below) by SQL: midpoints of few values, quantiles else."""
    con = duckdb.connect()
    con.register("t", pdf)
    k = con.sql(f"SELECT count(DISTINCT {f}) FROM t WHERE {where}").fetchall()[0][0]
    if k <= BINS:
        cuts = f"SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS c FROM (SELECT DISTINCT {f} AS v FROM t WHERE {where}) QUALIFY c IS NOT NULL"
    else:
        cuts = f"SELECT DISTINCT unnest(quantile_cont({f}, {[i / BINS for i in range(1, BINS)]})) AS c FROM t WHERE {where}"
    rows = con.sql(f"SELECT c, count(*) FILTER (y = 1), count(*) FILTER (y = 0) FROM ({cuts}) JOIN t ON {f} < c WHERE {where} GROUP BY c ORDER BY c").fetchall()
    least = {}
    for c, p, n in rows:
        least.setdefault((p, n), c)
    return [(c, p, n) for (p, n), c in least.items()]


NODES = {2: "a >= 9000 AND d < 2500.5", 3: "NOT (a >= 9000 AND d < 2500.5)", 6: "NOT (a >= 9000 AND d < 2500.5) AND d < 12", 7: "NOT (a >= 9000 AND d < 2500.5) AND d >= 12"}


@pytest.mark.parametrize("partitions,values,few", [(1, 1 << 20, 1 << 18), (50, 1 << 20, 1 << 18), (7, 40, 0)])
def test_cuts_equal_sql(spark, frame, monkeypatch, partitions, values, few):
    monkeypatch.setattr(T, "VALUES", values)
    monkeypatch.setattr(grow, "FEW_CUTS", few)
    features = ["a", "b", "d", "e"]
    enc = encode(spark.createDataFrame(frame).repartition(partitions), "y", features, exact=True)
    assert enc.raw == ["a", "b", "d"]
    g = Grower(enc, FitConfig(n_bins=BINS))
    g.blocks = T.pack(enc.df, enc.raw, None)
    g.code_rules = {(0, 1): Rule.of("and", CONJUI, Literal(0, "GE", 9000.0), Literal(2, "LT", 2500.5)), (0, 3): Rule.of("or", HORN, Literal(2, "LT", 12.0))}
    todo = [OpenNode(Node(0, k, 0, 0, 0.5)) for k in (2, 6, 7)]
    got = g._all_cuts(todo)
    got = (got if isinstance(got, pd.DataFrame) else got.toPandas()).sort_values("threshold")
    for slot, o in enumerate(todo):
        for f, name in enumerate(features):
            mine = got[(got.slot == slot) & (got.f == f)].drop_duplicates(["cum_pos", "cum_neg"])
            want = sql_cuts(frame, NODES[o.node.node_id], name)
            assert [(p, n) for _, p, n in want] == list(zip(mine.cum_pos, mine.cum_neg)), (slot, name)
            assert np.allclose([c for c, *_ in want], mine.threshold, rtol=1e-12)
    g._release()
    g.blocks.unpersist()
    enc.df.unpersist()


def test_split_of_many_values_equals_sql(spark, frame):
    """The root of a single-test tree, searched in SQL over the same cuts."""
    con = duckdb.connect()
    con.register("t", frame)
    cuts = " UNION ALL ".join(f"SELECT {k} AS f, c, p, n FROM (VALUES {', '.join(map(str, sql_cuts(frame, 'true', name)))}) v(c, p, n)" for k, name in enumerate("abd"))
    h = lambda p, n: f"CASE WHEN {p} > 0 AND {n} > 0 THEN -{p} / ({p} + {n}) * log2({p} / ({p} + {n})) - {n} / ({p} + {n}) * log2({n} / ({p} + {n})) ELSE 0 END"
    best = con.sql(f"""WITH w AS (SELECT sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS tn FROM t), c AS ({cuts})
      SELECT f, c, p, n, ({h('tp', 'tn')}) - (p + n) / (tp + tn) * ({h('p', 'n')}) - (tp + tn - p - n) / (tp + tn) * ({h('(tp - p)', '(tn - n)')}) AS gain
      FROM c, w ORDER BY gain DESC LIMIT 1""").fetchall()[0]
    m = fit_tree(spark.createDataFrame(frame), "y", ["a", "b", "d"], FitConfig(family=CONJUI, max_depth=1, max_arity=1, n_bins=BINS))
    root, below = m.nodes[(0, 1)].rule, m.nodes[(0, 2)]
    (lit,) = root.literals
    assert (lit.feature, lit.threshold) == (best[0], pytest.approx(float(best[1]), rel=1e-12))
    inside = (below.n_pos, below.n_neg) if lit.op == "LT" else (m.nodes[(0, 3)].n_pos, m.nodes[(0, 3)].n_neg)
    assert inside == best[2:4]


def test_fits_in_lots_are_the_same(spark, frame, monkeypatch):
    df = spark.createDataFrame(frame.iloc[:20_000])
    cfg = FitConfig(max_depth=3, n_bins=BINS, allow_affine=True)
    one = fit_tree(df, "y", ["a", "b", "d", "e"], cfg)
    monkeypatch.setattr(grow, "CELLS", 1)
    again = fit_tree(df, "y", ["a", "b", "d", "e"], cfg)
    assert {k: (n.rule, n.n_pos, n.n_neg) for k, n in one.nodes.items()} == {k: (n.rule, n.n_pos, n.n_neg) for k, n in again.nodes.items()}
    assert len(one.nodes) > 3


def test_routed_counts(spark, frame):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(frame)
    m = fit_tree(df, "y", ["a", "b", "d", "e"], FitConfig(max_depth=3, n_bins=BINS, search_3d=False))
    routed = df.withColumn("leaf", m.leaf_column()).groupBy("leaf").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["leaf"]: (r["p"], r["n"]) for r in routed} == {n.node_id: (n.n_pos, n.n) for n in m.leaves()}


def test_boosting_cuts_any_value(spark, frame):
    """Stumps equal a plain search of all values, round by round, without draws."""
    from rulespire.plans.boost import fit_boosting
    from pyspark.sql import functions as F

    pdf = frame.iloc[:30_000].copy()
    pdf["a"] += np.where(pdf.y == 1, 300.0, 0.0)
    df = spark.createDataFrame(pdf).withColumn("k", F.monotonically_increasing_id().cast("string"))
    m = fit_boosting(df, "y", ["a", "b", "e"], "k", n_rounds=4, learning_rate=0.4, subsample=1.0, colsample=1.0, validation=0.0, refresh=2)
    p0 = pdf.y.mean()
    score, rate = np.full(len(pdf), np.log(p0 / (1 - p0))), 0.4
    for s in m.stumps:
        r = (pdf.y - 1 / (1 + np.exp(-score))) / 1.1
        best = []
        for k, f in enumerate(["a", "b", "e"]):
            g = pd.DataFrame({"x": pdf[f], "r": r}).groupby("x").r.agg(["sum", "count"])
            ls, ln = g["sum"].cumsum().to_numpy()[:-1], g["count"].cumsum().to_numpy()[:-1]
            ts, tn = g["sum"].sum(), g["count"].sum()
            gain = np.where((ln >= 10) & (tn - ln >= 10), ls**2 / ln + (ts - ls) ** 2 / (tn - ln) - ts**2 / tn, -1)
            j = int(np.argmax(np.round(gain, 9)))
            best.append((-round(gain[j], 9), k, (g.index[j] + g.index[j + 1]) / 2, ls[j] / ln[j], (ts - ls[j]) / (tn - ln[j])))
        _, k, t, left, right = min(best)
        assert (s.feature, s.threshold) == (k, pytest.approx(t)) and (s.left, s.right) == (pytest.approx(left), pytest.approx(right))
        score = score + rate * np.where(pdf[["a", "b", "e"][k]] <= t, left, right)
        rate *= 0.995


def test_path_bounds_of_a_fit(spark, frame):
    """The intervals of growth are those of the node table; an empty one switches its feature off."""
    from rulespire.plans.model import path_bounds

    enc = encode(spark.createDataFrame(frame.iloc[:20_000]), "y", ["a", "b", "d", "e"], exact=True)
    g, seen = Grower(enc, FitConfig(family=CONJUI, max_depth=4, n_bins=BINS, min_samples_leaf=50)), {}
    cuts = g._cuts

    def watch(todo):
        cuts(todo)
        for o in todo:
            seen[o.node.node_id] = dict(o.bounds)
            assert not o.off() & set(o.cuts)

    g._cuts = watch
    m = g.run()
    inf = float("inf")
    want = {}
    for r in path_bounds(m.frame(spark)).collect():
        want.setdefault(r["node_id"], {})[r["feature"]] = (-inf if r["lo"] is None else r["lo"], inf if r["hi"] is None else r["hi"])
    assert {k: b for k, b in seen.items() if b} == {k: b for k, b in want.items() if k in seen} and any(seen.values())
    o = OpenNode(Node(0, 1, 0, 0, 0.5), bounds={0: (3.0, 2.0), 1: (0.0, 1.0)})
    assert o.off() == {0}


@pytest.mark.parametrize("binning", ["quantile", "width", "density", "supervised"])
def test_fixed_edges(spark, frame, binning):
    """Cuts lie on the chosen edges and count the rows below them."""
    pdf = frame.iloc[:20_000]
    cfg = FitConfig(n_bins=BINS, binning=binning, max_depth=2, family=CONJUI)
    df = spark.createDataFrame(pdf)
    edges = grow.fixed_edges(df, "y", ["a", "d", "e"], cfg)
    m = fit_tree(df, "y", ["a", "d", "e"], cfg)
    assert all(l.threshold in edges[l.feature] for n in m.splits() for l in n.rule.literals) and m.splits()
    for n in m.leaves():
        rows = np.ones(len(pdf), bool)
        for k in range(n.node_id.bit_length() - 1, 0, -1):
            rule, taken = m.nodes[(0, n.node_id >> k)].rule, (n.node_id >> (k - 1)) % 2 == 0
            hit = np.logical_and.reduce([(pdf[["a", "d", "e"][l.feature]] >= l.threshold) == (l.op == "GE") for l in rule.literals])
            rows &= hit == taken
        assert (n.n, n.n_pos) == (rows.sum(), pdf.y[rows].sum())


def test_pruning_hold_out_in_a_fit(spark, frame):
    from pyspark.sql import functions as F

    pdf = frame.iloc[:6000].assign(y=np.random.default_rng(1).integers(0, 2, 6000))
    df = spark.createDataFrame(pdf).withColumn("k", F.monotonically_increasing_id().cast("string"))
    cfg = FitConfig(max_depth=3, n_bins=BINS, search_3d=False, min_gain=1e-9)
    full = fit_tree(df, "y", ["a", "b", "e"], cfg, row_key="k")
    pruned = fit_tree(df, "y", ["a", "b", "e"], FitConfig(max_depth=3, n_bins=BINS, search_3d=False, min_gain=1e-9, prune_holdout=0.2), row_key="k")
    assert pruned.nodes[(0, 1)].n == 4800 and full.nodes[(0, 1)].n == 6000
    assert len(pruned.nodes) <= len(full.nodes)
    few = fit_tree(df.limit(400), "y", ["a", "b", "e"], FitConfig(max_depth=1, prune_holdout=0.2), row_key="k")
    assert few.nodes[(0, 1)].n == 400

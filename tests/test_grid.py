"""Fits of several methods from one packing of the rows."""

from dataclasses import replace
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulespire.config import FitConfig
from rulespire.functions.rules import AFFINE, ANTIHORN, BEST, CONJUI, HORN, SQUARE2CNF
from rulespire.operators.sampling import k_rows, k_rows_of
from rulespire.plans import grid, tensors as T

CFG = FitConfig(max_depth=3, n_bins=16)
FEATURES = ["a", "p", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"rk": [f"k{i}" for i in range(n)], "a": rng.integers(0, 9, n).astype(float), "p": rng.random(n) * 1e4, "e": rng.integers(0, 40, n).astype(float)})
    pdf["y"] = (((pdf.a >= 5) ^ (pdf.p < 3000)) ^ (rng.random(n) < 0.1)).astype(int)
    df = spark.createDataFrame(pdf)
    return df.withColumns({f"m{run}": (F.abs(F.xxhash64("rk", F.lit(run))) % 3 > 0).cast("int") for run in range(2)})


@pytest.mark.parametrize("missing", [False, True])
def test_joint_fits_equal_single_ones(spark, rows, missing):
    """Trees and accuracies of all methods together are those of each method alone, with missing values too."""
    df = rows.withColumn("a", F.when(F.xxhash64("rk") % 9 != 0, F.col("a"))) if missing else rows
    df = df.persist()
    masks = ["m0", "m1"]
    cfgs = [replace(CFG, family=HORN, search_2d=False, search_3d=False), *[replace(CFG, family=f) for f in (ANTIHORN, SQUARE2CNF, AFFINE, BEST)]]
    with grid.packed_runs(df, "y", FEATURES, masks, 256) as packed:
        joint = grid.fit_methods(packed, cfgs, 2)
        cells = [(t, t % 2, grid.whole_tree(joint.model, t)) for t in range(2 * len(cfgs))]
        found = grid.method_accuracies(packed, joint, cells)
    for k, cfg in enumerate(cfgs):
        alone = grid.fit_runs(df, "y", FEATURES, masks, replace(cfg, max_codes=256))
        want = grid.run_accuracies(df, "y", alone, masks)
        for run in range(2):
            mine, other = (grid.whole_tree(m, t) for m, t in ((joint.model, 2 * k + run), (alone, run)))
            assert {n: (v.rule, v.n_pos, v.n_neg, v.stop_reason, v.requested) for n, v in mine.items()} == {n: (v.rule, v.n_pos, v.n_neg, v.stop_reason, v.requested) for n, v in other.items()}
            assert found[2 * k + run] == pytest.approx(want[run], abs=1e-12)
    df.unpersist()


def _counted(monkeypatch, name):
    calls, was = [], getattr(grid, name)
    monkeypatch.setattr(grid, name, lambda *a, **b: calls.append(name) or was(*a, **b))
    return calls


def test_family_choice_reads_rows_once(spark, rows, monkeypatch):
    """one encoding serves all families (one each before)."""
    calls = _counted(monkeypatch, "encode")
    got = grid.choose_family(rows, "y", FEATURES, "rk", [HORN, CONJUI, AFFINE], k=2, cfg=CFG).collect()
    assert len(calls) == 1 and {r["family"] for r in got} == {HORN, CONJUI, AFFINE}


def test_grid_reads_rows_once(spark, rows, monkeypatch):
    """one encoding serves all methods of a grid (one each before); a broken method fails alone."""
    calls = _counted(monkeypatch, "encode")
    methods = {"Horn": ("main", replace(CFG, family=HORN)), "Affine": ("auxiliary", replace(CFG, family=AFFINE))}
    one = grid.run_grid(spark, {"t": rows}, {"t": FEATURES}, methods, [1, 2], 2, 20).collect()
    assert len(calls) == 1 and len(one) == 2 + 8 and not any(r["error"] for r in one)
    fits = grid.fit_methods

    def broken(packed, cfgs, runs):
        if any(c.family == AFFINE for c in cfgs):
            raise ValueError("broken")
        return fits(packed, cfgs, runs)

    monkeypatch.setattr(grid, "fit_methods", broken)
    two = grid.run_grid(spark, {"t": rows}, {"t": FEATURES}, methods, [1, 2], 2, 20).collect()
    plain = lambda rs, m: [r[:11] for r in rs if r["method"] == m]
    assert plain(two, "Horn") == plain(one, "Horn") and {r["error"] for r in two if r["method"] == "Affine"} == {"broken"}


@pytest.mark.parametrize("n_rows", [1, 3000, 10_000_000])
def test_rows_of_sides_equal_k_rows(spark, rows, n_rows):
    """The bound on the draws is raised until every side has its rows."""
    sides = [F.col("m0") == 0, F.col("m1") == 0, F.col("e") == 3, F.col("e") < 0]
    got = k_rows_of(rows, "rk", 30, 42, sides, n_rows)
    for side, mine in zip(sides, got):
        assert [r[0] for r in mine] == [r["rk"] for r in k_rows(rows.filter(side), "rk", 30, 42).collect()]


@pytest.mark.parametrize("weighted,held,bundled", [(False, 1 << 16, 1 << 21), (True, 100, 1 << 21), (False, 100, 0)])
def test_bundles_of_tuples(monkeypatch, weighted, held, bundled):
    """Counts of tuples from bundles of features are those of each tuple."""
    monkeypatch.setattr(T, "HELD", held)
    monkeypatch.setattr(T, "BUNDLED", bundled)
    rng = np.random.default_rng(5)
    sizes, n = [5, 12, 7, 3], 500
    wide = np.sort(rng.random(11))
    grids = {(T.PAIRS, 0): T.Grid([0, 1, 2, 3], [np.arange(5), wide, np.arange(7), np.arange(3)], sizes, list(combinations(range(4), 2))),
             (T.TRIPLES, 0): T.Grid([0, 1, 2, 3], [np.arange(5), wide[1::2], np.arange(7), np.arange(3)], [5, 6, 7, 3], list(combinations(range(4), 3)))}
    tuples, acc, want = T.Tuples(grids, {1: 0}, frozenset([1])), {}, {}
    for _ in range(3):
        x, pos, w = rng.random((1, n)), rng.random(n) < 0.4, rng.integers(1, 4, n).astype(float) if weighted else None
        c = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.int16)
        tuples(acc, T.Block(n, pos, None, c, x, None), 0, slice(None), w)
        for (kind, slot), g in grids.items():
            bins = T.bins_of(g, T.Block(n, pos, None, c, x, None), slice(None), {1: 0}, frozenset([1]))
            for t in g.tuples:
                counts = want.setdefault((kind, slot, *t, *[-1] * (3 - len(t))), np.zeros([g.sizes[k] for k in t] + [2]))
                np.add.at(counts, (*[bins[k] for k in t], pos.astype(int)), 1.0 if w is None else w)
    tuples.finish(acc)
    assert acc.keys() == want.keys()
    for key, counts in want.items():
        assert (acc[key][0].reshape(counts.shape) == counts).all()

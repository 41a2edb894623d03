"""Boosted regression stumps on residuals.

Rows are packed into column blocks once. A round is one pass: every task adds the stumps found so far to its
blocks' scores, sums residuals per (feature, code) into arrays and adds up the losses; the arrays are merged by
feature and only the best cut of every feature comes back. Every ``refresh`` rounds the running score is written into
the blocks, in the shared checkpoint folder.

A feature with more values than codes is cut exactly: the reduction is a convex function of the sum and the number
of rows on the left, so its values at the corners of what a cell can add bound every cut inside the cell. Cells whose bound
beats the best cut at a border are searched value by value in a second pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.hashing import unit_hash
from rulespire.functions.scores import sigmoid
from rulespire.operators.scan import prefix_sums
from rulespire.plans import tensors as T
from rulespire.plans.encode import encode
from rulespire.session import cut_lineage, ship_package


@dataclass
class Stump:
    feature: int
    threshold: float  # left when x <= threshold
    code: int  # left when code <= code; -1 for features with more values than codes
    left: float
    right: float
    weight: float
    reduction: float

    def value(self, x: Column) -> Column:
        return F.when(x <= self.threshold, F.lit(self.weight * self.left)).otherwise(F.lit(self.weight * self.right))

    def of_block(self, b: T.Block, raw: dict[int, int]) -> np.ndarray:
        left = b.c[self.feature] <= self.code if self.code >= 0 else b.x[raw[self.feature]] <= self.threshold
        return np.where(left, self.weight * self.left, self.weight * self.right)


@dataclass
class BoostModel:
    features: list[str]
    init: float
    stumps: list[Stump] = field(default_factory=list)
    best_iteration: int = 0
    train_losses: list[float] = field(default_factory=list)
    val_losses: list[float] = field(default_factory=list)

    def score_column(self, use_best: bool = True) -> Column:
        total = F.lit(self.init)
        used = self.stumps[: self.best_iteration + 1] if use_best else self.stumps
        for s in used:
            total = total + s.value(F.col(self.features[s.feature]))
        return total

    def proba_column(self, use_best: bool = True) -> Column:
        return sigmoid(self.score_column(use_best))

    def importance(self) -> dict[str, float]:
        per = {f: 0.0 for f in self.features}
        for s in self.stumps:
            per[self.features[s.feature]] += s.reduction
        total = sum(per.values())
        return {f: v / total if total > 0 else v for f, v in per.items()}

    def frame(self, spark) -> DataFrame:
        rows = [(i, s.feature, s.threshold, s.left, s.right, s.weight, s.reduction) for i, s in enumerate(self.stumps)]
        return spark.createDataFrame(rows, "iter int, feature int, threshold double, left_value double, right_value double, weight double, reduction double")


def stump_scan(counts: DataFrame, keys: list[str], order: str, min_leaf: int) -> DataFrame:
    """Between-group sum of squares of every cut of (keys, order, r, n) counts per value.

    Running sums are taken in ordered buckets, so a feature may have any number of values.
    """
    c = prefix_sums(counts, keys, order, ["n", "r"]).withColumnRenamed(f"next_{order}", "nxt")
    ls, ln, ts, tn = (F.col(k) for k in ("cum_r", "cum_n", "tot_r", "tot_n"))
    rs, rn, mean = ts - ls, tn - ln, ts / tn
    red = ln * F.pow(ls / ln - mean, 2) + rn * F.pow(rs / rn - mean, 2)
    return c.filter(F.col("nxt").isNotNull() & (ln >= min_leaf) & (rn >= min_leaf)).withColumns(
        {"reduction": red, "left_value": ls / ln, "right_value": rs / rn})


@dataclass
class Rounds:
    """What tasks need to know of a round. Rows of Block.x: raw features, the row's draw, the score once it is kept."""

    init: float
    stumps: list[Stump]  # not yet in the kept score
    raw: dict[int, int]
    kept: bool
    l2: float
    subsample: float
    number: int

    def score(self, b: T.Block) -> np.ndarray:
        out = b.x[len(self.raw) + 1] if self.kept else np.full(b.n, self.init)
        for s in self.stumps:
            out = out + s.of_block(b, self.raw)
        return out

    def residuals(self, b: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Residuals, losses, rows of the training part, and those of them that the round uses."""
        p = 1 / (1 + np.exp(-self.score(b)))
        q = np.clip(p, 1e-15, 1 - 1e-15)
        train = np.ones(b.n, bool) if b.w is None else b.w > 0
        used = train if self.subsample >= 1 else train & (_draws(b.x[len(self.raw)], self.number) < self.subsample)
        return (b.pos - p) / (1 + self.l2), -np.where(b.pos, np.log(q), np.log1p(-q)), train, used


def _draws(u: np.ndarray, number: int) -> np.ndarray:
    """Uniform draws of a round from the rows' own draws."""
    x = np.ascontiguousarray(u).view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


class Residuals:
    """Adds [code, (rows, residuals, positive ones, negative ones)] of the round's columns, and the losses under key -1."""

    def __init__(self, rounds: Rounds, columns: list[int], codes: list[int], wide: frozenset[int]):
        self.rounds, self.columns, self.codes, self.wide = rounds, columns, codes, wide

    def __call__(self, acc: dict, b: T.Block, slot: int, rows, w) -> None:
        r, loss, train, used = self.rounds.residuals(b)
        losses = np.array([train.sum(), loss[train].sum(), (~train).sum(), loss[~train].sum()])
        acc.setdefault((-1,), [np.zeros(4)])[0] += losses
        r = r[used]
        for f in self.columns:
            place, k = b.c[f][used].astype(np.int64), self.codes[f]
            if (f,) not in acc:
                acc[(f,)] = [np.zeros(4 * k)] + ([np.full(4 * k, np.inf), np.full(4 * k, -np.inf)] if f in self.wide else [])
            arrays = acc[(f,)]
            sums = arrays[0].reshape(k, 4)
            for column, weights in enumerate((None, r, np.maximum(r, 0), np.minimum(r, 0))):
                sums[:, column] += np.bincount(place, weights, k)
            if f in self.wide:
                x = b.x[self.rounds.raw[f]][used]
                np.minimum.at(arrays[1], place * 4, x)
                np.maximum.at(arrays[2], place * 4, x)


_CUT = "f int, kind int, cell int, threshold double, code int, ls double, ln double, ts double, tn double, reduction double, lo double, hi double"
_LOSS, _BORDER, _INSIDE = range(3)


def _reduction(ls, ln, ts, tn):
    """Between-group sum of squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = ls * ls / ln + (ts - ls) ** 2 / (tn - ln) - ts * ts / tn
    return np.where((ln > 0) & (ln < tn), out, 0.0)


def _best_borders(values: list[list[float] | None], min_leaf: int):
    """Best cut of a feature at a border of its codes, and the cells that may hold a better one."""

    def finish(key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
        (f,) = key
        if f < 0:
            return [(f, _LOSS, -1, None, -1, *map(float, arrays[0]), 0.0, None, None)]
        sums = arrays[0].reshape(-1, 4)
        at = np.flatnonzero(sums[:, 0])
        n, r, up, down = sums[at].T
        ln, ls = np.cumsum(n), np.cumsum(r)
        tn, ts = float(ln[-1]), float(ls[-1])
        ok = (ln >= min_leaf) & (tn - ln >= min_leaf)
        gains = np.where(ok, _reduction(ls, ln, ts, tn), -1.0)
        k, out, best = int(np.argmax(np.round(gains, 9))), [], 0.0
        if values[f] is None:
            lo, hi = arrays[1].reshape(-1, 4)[at, 0], arrays[2].reshape(-1, 4)[at, 0]
        else:
            lo = hi = np.array(values[f])[at]
        if ok[k]:
            best = float(gains[k])
            out.append((f, _BORDER, -1, float((hi[k] + lo[k + 1]) / 2), -1 if values[f] is None else int(at[k]), float(ls[k]), float(ln[k]), ts, tn, best, None, None))
        # corners of (sum, rows) inside a cell; a side of fewer than min_leaf rows is no cut
        low, high = np.maximum(ln - n, min_leaf), np.minimum(ln, tn - min_leaf)
        bound = np.max([_reduction(s, m, ts, tn) for s in (ls - r + down, ls - r + up) for m in (low, high)], axis=0)
        for j in np.flatnonzero((lo < hi) & (low <= high) & (bound > best)):
            out.append((f, _INSIDE, int(at[j]), None, -1, float(ls[j] - r[j]), float(ln[j] - n[j]), ts, tn, float(bound[j]), float(lo[j]), float(hi[j])))
        return out

    return finish


def _best_inside(blocks: DataFrame, rounds: Rounds, cells: list[dict], min_leaf: int) -> list:
    """Best cuts of all cells, value by value."""

    features = sorted({c["f"] for c in cells})
    # cell -> its number, by feature
    number = {f: {c["cell"]: k for k, c in enumerate(cells) if c["f"] == f} for f in features}

    def values(batches):
        for b in T._blocks(batches):
            r, _, _, used = rounds.residuals(b)
            for f in features:
                table = np.full(max(int(b.c[f].max()), *number[f]) + 1, -1, np.int32)
                table[list(number[f])] = list(number[f].values())
                cell = table[b.c[f]]
                rows = np.flatnonzero(used & (cell >= 0))
                if not len(rows):
                    continue
                x, k = b.x[rounds.raw[f]][rows], cell[rows]
                order = np.lexsort((x, k))
                x, k, rows = x[order], k[order], rows[order]
                starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (k[1:] != k[:-1])]))
                n = np.diff(np.append(starts, len(x))).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(k[starts]), pa.array(x[starts]), pa.array(np.add.reduceat(r[rows], starts)), pa.array(n)], ["k", "x", "r", "n"])

    schema = "k int, x double, r double, n double"
    counts = blocks.mapInArrow(values, schema).groupBy("k", "x").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))

    def best(batches):
        # values by cell, in order: running sums are carried on, so a cell may have any number of them
        now = before = found = None
        for batch in batches:
            cell, xs, rs, ns = (batch.column(c).to_numpy() for c in ("k", "x", "r", "n"))
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
            for a, z in zip(edges, [*edges[1:], len(cell)]):
                k = int(cell[a])
                if k != now:
                    if found:
                        yield row(now, found)
                    now, found, before = k, None, np.nan
                    ls, ln = cells[k]["ls"], cells[k]["ln"]
                ts, tn = cells[k]["ts"], cells[k]["tn"]
                below = np.concatenate([[before], xs[a : z - 1]])
                s, n = ls + np.cumsum(rs[a:z]) - rs[a:z], ln + np.cumsum(ns[a:z]) - ns[a:z]
                ok = ~np.isnan(below) & (n >= min_leaf) & (tn - n >= min_leaf)
                gains = np.round(np.where(ok, _reduction(s, n, ts, tn), -1.0), 9)
                j = int(np.argmax(gains))
                if ok[j] and (found is None or gains[j] > found[0]):
                    found = gains[j], (below[j] + xs[a + j]) / 2, s[j], n[j]
                ls, ln, before = ls + rs[a:z].sum(), ln + ns[a:z].sum(), xs[z - 1]
        if found:
            yield row(now, found)

    def row(k, found):
        gain, t, ls, ln = found
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([float(v)]) for v in (gain, t, ls, ln)]], ["k", "reduction", "threshold", "ls", "ln"])

    ship_package(blocks.sparkSession)
    ordered = counts.repartition("k").sortWithinPartitions("k", "x")
    got = ordered.mapInArrow(best, "k int, reduction double, threshold double, ls double, ln double").collect()
    return [cells[r["k"]] | r.asDict() for r in got]


def fit_boosting(df: DataFrame, label: str, features: list[str], row_key: str, n_rounds: int = 200, learning_rate: float = 0.05,
                 subsample: float = 0.8, colsample: float = 0.8, min_leaf: int = 10, early_stop: int = 20,
                 validation: float = 0.15, min_rounds: int = 10, l2: float = 0.1, decay: float = 0.995, seed: int = 42,
                 max_codes: int = 1024, refresh: int = 20) -> BoostModel:
    spark = df.sparkSession
    enc = encode(df, label, features, max_codes, collapse=False, row_key=row_key, exact=True, cache=False)
    d = len(features)
    draw = F.lit(1.0) + unit_hash(seed, "row", F.col(row_key))
    base = enc.df.withColumns({"w": F.when(unit_hash(seed, "bval", F.col(row_key)) < validation, 0.0).otherwise(1.0), "__u": draw})
    pos = base.filter("w > 0").agg(F.avg("y").alias("p")).first()["p"]
    p0 = min(max(pos, 1e-7), 1 - 1e-7)
    model = BoostModel(list(features), math.log(p0 / (1 - p0)))
    raw = {features.index(f): k for k, f in enumerate(enc.raw)}
    wide = frozenset(f for f, v in enumerate(enc.values) if v is None)
    codes = [enc.codes(f) for f in range(d)]
    blocks, router = T.pack(base, [*enc.raw, "__u"], None), T.Router({}, {(0, 1): 0})
    cached = [blocks]
    finish, ops = _best_borders(enc.values, min_leaf), ("sum", "min", "max") if wide else ("sum",)
    best, waited, best_round, rate, kept = float("inf"), 0, None, learning_rate, 0
    n_cols = max(1, int(d * colsample))
    try:
        for i in range(n_rounds + 1):
            rounds = Rounds(model.init, model.stumps[kept:], raw, kept > 0, l2, subsample, i)
            columns = _column_draw(spark, d, n_cols, seed, i) if i < n_rounds else []
            found = T.merged(T.count(blocks, router, Residuals(rounds, columns, codes, wide), 1), 1, finish, _CUT, ops).collect()
            if i > 0:
                # rows and losses of the training part, then of the validation part
                n_train, train_loss, n_val, val_loss = next((r["ls"], r["ln"], r["ts"], r["tn"]) for r in found if r["kind"] == _LOSS)
                model.train_losses.append(train_loss / n_train)
                if n_val:
                    v = val_loss / n_val
                    model.val_losses.append(v)
                    if v < best - 1e-5:
                        best, waited, best_round = v, 0, i - 1
                    else:
                        waited += 1
                    if waited >= early_stop and i - 1 >= min_rounds:
                        break
            if i == n_rounds:
                break
            cuts = [r.asDict() for r in found if r["kind"] == _BORDER]
            top = max((r["reduction"] for r in cuts), default=0.0)
            open_cells = [r.asDict() for r in found if r["kind"] == _INSIDE and r["reduction"] > top]
            if open_cells:
                cuts += _best_inside(blocks, rounds, open_cells, min_leaf)
            if not cuts:
                break
            r = min(cuts, key=lambda r: (-round(r["reduction"], 9), r["f"], r["threshold"]))
            left, right = r["ls"] / r["ln"], (r["ts"] - r["ls"]) / (r["tn"] - r["ln"])
            model.stumps.append(Stump(r["f"], float(r["threshold"]), r["code"], left, right, rate, r["reduction"]))
            rate *= decay
            if len(model.stumps) - kept >= refresh:
                blocks = _keep_scores(blocks, Rounds(model.init, model.stumps[kept:], raw, kept > 0, l2, subsample, i))
                kept = len(model.stumps)
    finally:
        for held in cached:
            held.unpersist()
    last = len(model.stumps) - 1
    model.best_iteration = last if best_round is None else min(max(min_rounds - 1, best_round), last)
    return model


def _keep_scores(blocks: DataFrame, rounds: Rounds) -> DataFrame:
    """The blocks with the running score as the last row of x, written to the shared folder."""
    at = len(rounds.raw) + 1

    def run(batches):
        for batch in batches:
            for k, b in enumerate(T._blocks([batch])):
                x = np.concatenate([b.x[:at], rounds.score(b)[None]])
                yield batch.slice(k, 1).set_column(batch.schema.get_field_index("x"), "x", pa.array([x.tobytes()], pa.binary()))

    ship_package(blocks.sparkSession)
    return cut_lineage(blocks.mapInArrow(run, blocks.schema))


def _column_draw(spark, d: int, size: int, seed: int, round_no: int) -> list[int]:
    """Columns of a round: the smallest draws (d numbers, no data)."""
    if size >= d:
        return list(range(d))
    import hashlib

    draw = lambda f: hashlib.md5(f"{seed}-col-{round_no}-{f}".encode()).hexdigest()[:8]
    return sorted(sorted(range(d), key=draw)[:size])

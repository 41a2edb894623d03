"""Best region per tuple on dense count tensors.

``best_regions`` has the same scores as ``search.region_counts`` + ``score_counts`` +
``best_per``, which list every cut (``all_regions``). Spark counts the cells and shuffles
them by tuple; one tuple has at most bins^arity cells (64^2 or 32^3), so its prefix sums
are three numpy passes instead of three sorted windows over an exploded grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespire.operators.search import regions_of
from rulespire.session import ship_package


def entropy_of(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = p + n
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = p / total, n / total
        h = -(a * np.log2(a)) - (b * np.log2(b))
    return np.where((p > 0) & (n > 0), h, 0.0)


def _sides(prefix: np.ndarray, region: str) -> np.ndarray:
    """Counts of one octant for all cut combinations; the grid's axes are the last ones."""
    out = 0.0
    highs = [i for i, s in enumerate(region) if s == "H"]
    for flips in product((False, True), repeat=len(highs)):
        below = {i for i, s in enumerate(region) if s == "L"} | {i for i, f in zip(highs, flips) if f}
        cut = tuple(slice(0, -1) if i in below else slice(-1, None) for i in range(len(region)))
        out = out + (-1 if sum(flips) % 2 else 1) * prefix[(..., *cut)]
    return out


def region_scores(grids: list[np.ndarray], regions: list[str], min_leaf: int, arity: int | None = None) -> Iterator[tuple]:
    """(region, score, gain, ip, ineg) for all cut combinations of dense (pos, neg) counts; invalid ones score -1."""
    prefix = []
    for grid in grids:
        for axis in range(grid.ndim):
            grid = np.cumsum(grid, axis=axis)
        prefix.append(grid)
    tp, tn = float(prefix[0].flat[-1]), float(prefix[1].flat[-1])
    n, axes = tp + tn, prefix[0].ndim
    parent = float(entropy_of(np.array(tp), np.array(tn)))
    penalty = ((arity or axes) + 1.0) * np.log(max(n, 2.0)) / (2.0 * n)
    full = tuple(s - 1 for s in prefix[0].shape)
    for region in regions:
        names = [r for r in regions_of(axes) if r != "X" and r.count("H") % 2] if region == "X" else [region]
        ip = np.broadcast_to(sum(_sides(prefix[0], r) for r in names), full)
        ineg = np.broadcast_to(sum(_sides(prefix[1], r) for r in names), full)
        inside = ip + ineg
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = parent - inside / n * entropy_of(ip, ineg) - (n - inside) / n * entropy_of(tp - ip, tn - ineg)
        score = np.where((inside >= min_leaf) & (n - inside >= min_leaf) & (inside > 0) & (inside < n), np.maximum(gain, 0.0) - penalty, -1.0)
        yield region, score, gain, ip, ineg


def best_cuts(grids: list[np.ndarray], regions: list[str], min_leaf: int) -> list[tuple]:
    """(region, axes..., score, gain, ip, ineg) of the best cuts of one tuple."""
    if min(grids[0].shape) < 2:
        return []
    out = []
    for region, score, gain, ip, ineg in region_scores(grids, regions, min_leaf):
        best = int(np.argmax(np.round(score, 12)))  # first maximum = smallest cuts
        if score.flat[best] > 0:
            where = np.unravel_index(best, score.shape)
            out.append((region, *(int(w) for w in where), float(score.flat[best]), float(gain.flat[best]), float(ip.flat[best]), float(ineg.flat[best])))
    return out


def region_kernel(cells: pd.DataFrame, axes: list[str], regions: list[str], min_leaf: int) -> list[tuple]:
    """``best_cuts`` of one tuple's cells."""
    at = tuple(cells[a].to_numpy() for a in axes)
    grids = [np.zeros(tuple(int(i.max()) + 1 for i in at)) for _ in range(2)]
    for grid, side in zip(grids, ("pos", "neg")):
        np.add.at(grid, at, cells[side].to_numpy())
    return best_cuts(grids, regions, min_leaf)


def best_regions(cells: DataFrame, keys: list[str], axes: list[str], regions: list[str], min_leaf: int) -> DataFrame:
    """Best cuts of every (tuple, region): keys, region, axes, score, gain, ip, ineg."""
    key_types = [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*key_types, "region string", *[f"{a} int" for a in axes], "score double, gain double, ip double, ineg double"])
    columns = [*keys, "region", *axes, "score", "gain", "ip", "ineg"]

    def per_tuple(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in region_kernel(pdf, axes, regions, min_leaf)], columns=columns)

    ship_package(cells.sparkSession)
    return cells.groupBy(*keys).applyInPandas(per_tuple, schema)


#: Cells of the grids that a task holds at once.
CELLS = 1 << 17


def cut_counts(tuples: pa.RecordBatch, axes: list[str], regions: list[str], step: int) -> Iterator[pa.RecordBatch]:
    """All cuts and regions of the tuples of a batch, whose last column lists each one's cells (axes, pos, neg)."""
    lists = tuples.column(tuples.num_columns - 1)
    n, cells = np.diff(lists.offsets.to_numpy()), lists.flatten()
    at = [cells.field(a).to_numpy(zero_copy_only=False) for a in axes]
    sides = [cells.field(s).to_numpy(zero_copy_only=False) for s in ("pos", "neg")]
    start = np.concatenate([[0], np.cumsum(n)])
    sizes = np.array([np.maximum.reduceat(a, start[:-1]) + 1 for a in at])  # no list is empty
    full = tuple(int(s) for s in sizes.max(axis=1))
    lot = max(1, CELLS // int(np.prod(full)))
    for k in range(0, len(n), lot):
        own, part = slice(start[k], start[min(k + lot, len(n))]), sizes[:, k : k + lot]
        m = part.shape[1]
        spot = np.repeat(np.arange(m), n[k : k + lot])
        for a, size in zip(at, full):
            spot = spot * size + a[own]
        grids = [np.bincount(spot, s[own], m * int(np.prod(full))).reshape(m, *full) for s in sides]
        for axis in range(len(axes)):
            grids = [np.cumsum(g, axis=axis + 1) for g in grids]
        valid = np.ones((m, *(s - 1 for s in full)), bool)
        for axis, size in enumerate(full):
            cut = np.arange(size - 1)
            ok = (cut < part[axis][:, None] - 1) & ((cut + 1) % step == 0)
            valid &= ok.reshape(m, *(size - 1 if i == axis else 1 for i in range(len(axes))))
        which, *cuts = np.nonzero(valid)
        if not len(which):
            continue
        totals = [g.reshape(m, -1)[which, -1] for g in grids]
        keys = pa.Table.from_batches([tuples]).drop_columns(tuples.schema.names[-1:]).take(pa.array(which + k)).combine_chunks()
        head = [c.chunk(0) for c in keys.columns] + [pa.array(c.astype(np.int32)) for c in cuts] + [pa.array(t) for t in totals]
        for region in regions:
            names = [r for r in regions_of(len(axes)) if r != "X" and r.count("H") % 2] if region == "X" else [region]
            inside = [pa.array(np.broadcast_to(sum(_sides(g, r) for r in names), valid.shape)[valid]) for g in grids]
            yield pa.RecordBatch.from_arrays([*head, pa.array([region]).take(pa.array(np.zeros(len(which), np.int32))), *inside],
                                             names=[*tuples.schema.names[:-1], *axes, "tp", "tn", "region", "ip", "ineg"])


def all_regions(cells: DataFrame, keys: list[str], axes: list[str], regions: list[str], step: int = 1) -> DataFrame:
    """Counts inside every region at every cut: keys, axes, tp, tn, region, ip, ineg.

    The cells of a tuple, at most its bins^arity, are one row. Cells without a bin are left out.
    """
    binned = cells.dropna(subset=axes)
    cell = F.struct(*[F.col(a).cast("int").alias(a) for a in axes], *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in ("pos", "neg")])
    tuples = binned.groupBy(*keys).agg(F.collect_list(cell).alias("__cells")).filter(F.size("__cells") > 0)
    schema = ", ".join([*(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys), *(f"{a} int" for a in axes),
                        "tp double, tn double, region string, ip double, ineg double"])

    def per_batch(batches):
        for batch in batches:
            if batch.num_rows:
                yield from cut_counts(batch, axes, regions, step)

    ship_package(cells.sparkSession)
    return tuples.mapInArrow(per_batch, schema)

"""Dense counts of the open nodes of all trees.

Rows are packed once into column blocks and cached. A pass routes every block through the splits found so far with
numpy, adds its rows into arrays per (node, feature) or (node, tuple of features) and, at the end of its partition,
emits the arrays; Spark groups them by key and they are added up one after the other. So a row is never spread over
features or tuples, and what is shuffled is partitions x arrays, whatever the number of rows.

Cuts are exact for columns with any number of values. A column with more values than codes is counted by cells of
codes, with the least and greatest value of each. A quantile that falls into a cell of several values is a *pick*: the
next pass counts the values inside this cell alone (or, in a cell of more than ``VALUES`` rows, 1 024 cells
of equal width inside it) and adds the counts of all cells below as an offset.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from rulespire.functions.rules import Rule
from rulespire.session import ship_package

#: Rows of a block.
BLOCK = 1 << 16
#: Rows of a cell whose values are counted one by one; cells that a larger one is cut into.
VALUES, FINER = 1 << 20, 1024


@dataclass
class Block:
    """Some rows by column."""

    n: int
    pos: np.ndarray  # y == 1
    w: np.ndarray | None  # None: all ones
    c: np.ndarray  # codes [feature, row]
    x: np.ndarray  # raw values [kept feature, row]
    ws: np.ndarray | None  # weights [tree, row]
    m: np.ndarray | None = None  # missing values [feature, row]; None: there are none


def codes_of(columns: list[pa.Array], cuts: list[list[float]]) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """Codes [feature, row] (number of cuts at or below a value; 0 for a missing one), what is missing, and the values."""
    x = [col.to_numpy(zero_copy_only=False) for col in columns]
    c = np.zeros((len(x), len(x[0])), np.int16)
    m = np.zeros(c.shape, bool) if any(col.null_count for col in columns) else None
    for k, (col, v, cut) in enumerate(zip(columns, x, cuts)):
        if not len(cut):
            continue
        c[k] = np.searchsorted(cut, v, "right")
        bad = np.isnan(v)
        if bad.sum() > col.null_count:
            raise ValueError("a feature has NaN values")
        if col.null_count:
            c[k][bad], m[k] = 0, bad
    return c, m, x


def _pack(batches, raw: list, weights: str | None, cuts: list[list[float]] | None = None):
    def out(held):
        n = sum(len(h[0]) for h in held)
        missing = [h[5] for h in held]
        if any(m is not None for m in missing):
            missing = [np.zeros(h[2].shape, bool) if h[5] is None else h[5] for h in held]
        held = [(*h[:5], m) for h, m in zip(held, missing)]
        y, w, c, x, ws, m = (np.concatenate(p, axis=-1) if p[0] is not None else None for p in zip(*held))
        one = lambda a: pa.array([None if a is None else np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), one(y), one(None if (w == 1).all() else w), one(c), one(x), one(ws), one(m)], ["n", "y", "w", "c", "x", "ws", "m"])

    held, size = [], 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        matrix = lambda k, kind: b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T.astype(kind)
        if cuts is None:
            x = [b.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(raw))]
            c, codes = matrix("c", np.int16), b.column("c").flatten()
            m = codes.is_null().to_numpy(zero_copy_only=False).reshape(n, -1).T if codes.null_count else None
        else:
            c, m, x = codes_of([b.column(f"x{k}") for k in range(len(cuts))], cuts)
            x = [x[f] for f in raw]
        held.append((b.column("y").to_numpy() == 1, b.column("w").to_numpy(), c, np.stack(x) if x else np.empty((0, n)), matrix("ws", np.uint8) if weights else None, m))
        size += n
        if size >= BLOCK:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def pack(df: DataFrame, raw: list[str], weights: str | None) -> DataFrame:
    """Blocks of (y, w, c, ``raw`` columns, ``weights`` array), cached."""
    cols = ["y", "w", "c", *[F.col(f).alias(f"x{k}") for k, f in enumerate(raw)], *([F.col(weights).alias("ws")] if weights else [])]
    ship_package(df.sparkSession)
    packed = df.select(*cols).mapInArrow(lambda b: _pack(b, raw, weights), "n int, y binary, w binary, c binary, x binary, ws binary, m binary")
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def pack_values(df: DataFrame, features: list[str], cuts: list[list[float]], raw: list[str], weights: str | None) -> DataFrame:
    """Blocks of (y, w, ``features``, ``weights`` array), cached; values get their codes in Arrow batches."""
    cols = ["y", "w", *[F.col(f).alias(f"x{k}") for k, f in enumerate(features)], *([F.col(weights).alias("ws")] if weights else [])]
    ship_package(df.sparkSession)
    kept, borders = [features.index(f) for f in raw], [np.array(c, float) for c in cuts]
    packed = df.select(*cols).mapInArrow(lambda b: _pack(b, kept, weights, borders), "n int, y binary, w binary, c binary, x binary, ws binary, m binary")
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(batches) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            n = b.column("n")[k].as_py()
            get = lambda name, kind: None if not b.column(name)[k].is_valid else np.frombuffer(b.column(name)[k].as_buffer(), kind)
            shaped = lambda a: a if a is None else a.reshape(-1, n)
            x = get("x", np.float64)
            yield Block(n, get("y", np.bool_), get("w", np.float64), shaped(get("c", np.int16)), x.reshape(-1, n) if x is not None and len(x) else np.empty((0, n)), shaped(get("ws", np.uint8)), shaped(get("m", np.bool_)))


@dataclass
class Router:
    """Splits of all trees (thresholds are codes, or values for features in ``raw``) and the open nodes' slots."""

    rules: dict[tuple[int, int], Rule]
    slots: dict[tuple[int, int], int]
    raw: dict[int, int] = field(default_factory=dict)  # feature -> row of Block.x
    wide: frozenset[int] = frozenset()
    masks: list[int] | None = None  # tree -> row of Block.ws; None: its own

    def __post_init__(self):
        self.above = {(t, n >> k) for t, n in self.slots for k in range(n.bit_length())}

    def literal(self, b: Block, l, rows) -> np.ndarray:
        if l.feature2 is not None:
            left, right = b.x[self.raw[l.feature]][rows], b.x[self.raw[l.feature2]][rows]
            return {"LE": left <= right, "GT": left > right, "GE": left >= right, "LT": left < right}[l.op]
        column = b.x[self.raw[l.feature]] if l.feature in self.wide else b.c[l.feature]
        above = column[rows] >= l.threshold
        return above if l.op == "GE" else ~above

    def truth(self, b: Block, rule: Rule, rows) -> np.ndarray:
        clauses = [[self.literal(b, l, rows) for l in clause] for clause in rule.clauses]
        if rule.combine == "cnf":
            return np.logical_and.reduce([np.logical_or.reduce(c) for c in clauses])
        return {"or": np.logical_or, "and": np.logical_and, "xor": np.logical_xor}[rule.combine].reduce(clauses[0])

    def open_rows(self, b: Block) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray | None]]:
        """(slot, rows, their weights) of every open node that has rows in the block."""
        starts: dict[int, tuple] = {}
        for tree in sorted({t for t, _ in self.slots}):
            w = b.w
            start: np.ndarray | slice = slice(None)
            if b.ws is not None:
                mask = tree if self.masks is None else self.masks[tree]
                if mask not in starts:
                    ws = b.ws[mask]
                    # rows that weigh 1 each are counted without weights
                    w = (None if ws.max() <= 1 else ws.astype(float)) if b.w is None else b.w * ws
                    starts[mask] = np.flatnonzero(ws), w
                start, w = starts[mask]
            todo = [(1, start)]
            while todo:
                node, rows = todo.pop()
                if (tree, node) in self.slots:
                    if isinstance(rows, slice) or len(rows):
                        yield self.slots[(tree, node)], rows, None if w is None else w[rows]
                elif (tree, node) in self.above:
                    truth = self.truth(b, self.rules[(tree, node)], rows)
                    pick = np.flatnonzero if isinstance(rows, slice) else lambda t, r=rows: r[t]
                    todo += [(2 * node, pick(truth)), (2 * node + 1, pick(~truth))]


def count(blocks: DataFrame, router: Router, add: Callable, keys: int) -> DataFrame:
    """k0 .. k(keys-1), at, v0, v1, v2: what ``add(acc, block, slot, rows, weights)`` has put into ``acc`` per partition.

    ``acc`` maps keys to lists of arrays. Arrays that are mostly zeros are sent as places and values.
    """

    def run(batches):
        acc: dict[tuple, list[np.ndarray]] = {}
        for b in _blocks(batches):
            for slot, rows, w in router.open_rows(b):
                add(acc, b, slot, rows, w)
        if hasattr(add, "finish"):
            add.finish(acc)
        for key, arrays in acc.items():
            at = None
            if len(arrays[0]) > 64:
                some = np.flatnonzero(arrays[0])
                if len(some) * 3 < 2 * len(arrays[0]):
                    at, arrays = some.astype(np.int32), [a[some] if len(a) == len(arrays[0]) else a for a in arrays]
            size = len(acc[key][0])
            cells = [None if at is None else at.tobytes(), *[a.tobytes() for a in arrays], *[None] * (3 - len(arrays))]
            yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([size], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], [*[f"k{i}" for i in range(keys)], "size", "at", "v0", "v1", "v2"])

    schema = ", ".join([*[f"k{i} int" for i in range(keys)], "size int, at binary, v0 binary, v1 binary, v2 binary"])
    ship_package(blocks.sparkSession)
    return blocks.mapInArrow(run, schema)


#: How the arrays of a key are merged, and what stands where nothing was counted.
_MERGE = {"sum": (np.add, 0.0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}


def merged(parts: DataFrame, keys: int, finish: Callable, schema: str, ops: tuple[str, ...] = ("sum",)) -> DataFrame:
    """Rows of ``finish(key, arrays)`` for every key; a key's arrays are added up as they come."""
    names = [f"k{i}" for i in range(keys)]
    kinds = pa.schema([pa.field(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "doubles": pa.list_(pa.float64())}[k]) for n, k in (p.split() for p in schema.split(", "))])

    def run(batches):
        key, arrays, out = None, None, []

        def table():
            nonlocal out
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out), kinds)]
            out = []
            return pa.RecordBatch.from_arrays(cols, schema=kinds)

        for b in batches:
            cols = [b.column(n).to_pylist() for n in names]
            for k, now in enumerate(zip(*cols)):
                size = b.column("size")[k].as_py()
                if now != key:
                    if key is not None:
                        out += finish(key, arrays)
                    key, arrays = now, [np.full(size, _MERGE[op][1]) for op in ops]
                at = b.column("at")[k]
                at = np.frombuffer(at.as_buffer(), np.int32) if at.is_valid else slice(None)
                for a, op, v in zip(arrays, ops, ("v0", "v1", "v2")):
                    some = b.column(v)[k]
                    if some.is_valid:
                        a[at] = _MERGE[op][0](a[at], np.frombuffer(some.as_buffer(), np.float64))
            if len(out) > 5000:
                yield table()
        if key is not None:
            out += finish(key, arrays)
        if out:
            yield table()

    spark_schema = schema.replace(" doubles", " array<double>")
    return parts.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, spark_schema)


class Scorer(Router):
    """Truths of rules for rows to be scored: as in ``walk``, a missing value fails every test."""

    def literal(self, b: Block, l, rows) -> np.ndarray:
        true = super().literal(b, l, rows)
        if l.op == "LT" and l.feature2 is None:
            if l.feature in self.wide:
                true &= ~np.isnan(b.x[self.raw[l.feature]][rows])
            elif b.m is not None:
                true &= ~b.m[l.feature][rows]
        return true

    def reached(self, b: Block, tree: int, depth: int) -> dict[int, np.ndarray]:
        """Rows of the block at every node of a tree down to a depth."""
        out, todo = {}, [(1, np.ones(b.n, bool))]
        while todo:
            node, here = todo.pop()
            out[node] = here
            if (tree, node) in self.rules and node.bit_length() <= depth:
                truth = self.truth(b, self.rules[(tree, node)], slice(None))
                todo += [(2 * node, here & truth), (2 * node + 1, here & ~truth)]
        return out


def hits(blocks: DataFrame, scorer: Scorer, cells: list[tuple[int, int, list[int]]]) -> list[tuple[float | None, float | None]]:
    """(train, test) accuracy of every cell (tree, mask, positive leaves) from one pass; the rows that a mask weighs train it."""
    by_tree: dict[int, list[int]] = {}
    for k, (tree, _, _) in enumerate(cells):
        by_tree.setdefault(tree, []).append(k)
    deepest = {t: max((n.bit_length() - 1 for k in ks for n in cells[k][2]), default=0) for t, ks in by_tree.items()}

    def run(batches):
        found = np.zeros((len(cells), 4))
        for b in _blocks(batches):
            trains = b.ws.astype(bool)
            size = trains.sum(axis=1)
            for tree, ks in by_tree.items():
                reached = scorer.reached(b, tree, deepest[tree])
                for k in ks:
                    _, mask, positive = cells[k]
                    said = np.zeros(b.n, bool)
                    for node in positive:
                        said |= reached[node]
                    hit = said == b.pos
                    inside = np.count_nonzero(hit & trains[mask])
                    found[k] += inside, size[mask], np.count_nonzero(hit) - inside, b.n - size[mask]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), *[pa.array(v) for v in found.T]], ["cell", "a", "b", "c", "d"])

    ship_package(blocks.sparkSession)
    got = blocks.mapInArrow(run, "cell int, a double, b double, c double, d double").groupBy("cell").sum("a", "b", "c", "d").collect()  # cells
    share = lambda hit, n: hit / n if n else None
    by = {r[0]: (share(r[1], r[2]), share(r[3], r[4])) for r in got}
    return [by.get(k, (None, None)) for k in range(len(cells))]


def totals(blocks: DataFrame, n_trees: int) -> list[tuple[float, float]]:
    """(positive, negative) weight of every tree's rows."""

    def add(acc, b: Block, slot: int, rows, w) -> None:
        pos = b.pos[rows]
        acc.setdefault((slot,), [np.zeros(2)])[0] += np.bincount(pos, w, 2)

    router = Router({}, {(t, 1): t for t in range(n_trees)})
    rows = merged(count(blocks, router, add, 1), 1, lambda key, arrays: [(*key, float(arrays[0][1]), float(arrays[0][0]))], "t int, pos double, neg double").collect()
    by = {r["t"]: (r["pos"], r["neg"]) for r in rows}
    return [by.get(t, (0.0, 0.0)) for t in range(n_trees)]


# --- histograms and cuts of single features -------------------------------------------------


@dataclass
class Histogram:
    """Adds counts per code [code, (neg, pos)]; for wide features the least and greatest value too."""

    codes: list[int]
    wide: frozenset[int]
    raw: dict[int, int]
    features: list[list[int]]  # by slot

    def __call__(self, acc: dict, b: Block, slot: int, rows, w) -> None:
        pos = b.pos[rows]
        for f in self.features[slot]:
            c = b.c[f][rows].astype(np.int64)
            key = (slot, f)
            if key not in acc:
                k = self.codes[f]
                # places of the first array tell which cells are sent: pos + neg, then pos, least, greatest
                acc[key] = [np.zeros(2 * k)] + ([np.full(2 * k, np.inf), np.full(2 * k, -np.inf)] if f in self.wide else [])
            arrays = acc[key]
            place = c * 2 + pos
            arrays[0] += np.bincount(place, w, 2 * self.codes[f])
            if f in self.wide:
                x = b.x[self.raw[f]][rows]
                np.minimum.at(arrays[1], place, x)
                np.maximum.at(arrays[2], place, x)


CUTS = "slot int, f int, kind int, threshold double, cut_code int, cum_pos double, cum_neg double, tot_pos double, tot_neg double, lo double, hi double, off_pos double, off_neg double, rows double, nxt double, spots doubles"
CUT, PICK, FEW = range(3)


def edge(s: float, v: float, nxt: float | None, first: float, last: float) -> tuple[float, bool]:
    """Threshold of the quantile position s on value v, which rows ``first`` to ``last`` have; whether it is above v."""
    if nxt is not None and math.floor(s) == last - 1 and s > math.floor(s):
        t = v + (s - math.floor(s)) * (nxt - v)
        return (t if t > v else nxt), True
    return v, False


def spots_of(n: float, n_bins: int) -> np.ndarray:
    return np.arange(1, n_bins) * (n - 1) / n_bins


class Cutter:
    """Cuts of one (slot, feature) from its merged histogram; picks where a cell holds several values."""

    def __init__(self, values: list[list[float] | None], n_bins: int):
        self.values, self.n_bins = values, n_bins

    def __call__(self, key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
        slot, f = key
        neg, pos = arrays[0][0::2], arrays[0][1::2]
        at = np.flatnonzero((neg > 0) | (pos > 0))
        pos, neg = pos[at], neg[at]
        tot = float(pos.sum()), float(neg.sum())
        if self.values[f] is None:
            lo, hi = np.minimum(arrays[1][0::2], arrays[1][1::2])[at], np.maximum(arrays[2][0::2], arrays[2][1::2])[at]
        else:
            lo = hi = np.array(self.values[f])[at]
        out = self.spread(slot, f, at, lo, hi, pos, neg, (0.0, 0.0), None, tot)
        if len(at) <= self.n_bins:
            if (lo == hi).all():
                return self.midpoints(slot, f, at, lo, pos, neg, tot)
            # perhaps few values after all
            out.append((slot, f, FEW, None, -1, 0.0, 0.0, *tot, float(lo[0]), float(hi[-1]), 0.0, 0.0, float(sum(tot)), None, None))
        return out

    def code(self, f: int, code: int) -> int:
        return -1 if self.values[f] is None else int(code)

    def midpoints(self, slot, f, at, v, pos, neg, tot) -> list[tuple]:
        cp, cn = np.cumsum(pos), np.cumsum(neg)
        return [(slot, f, CUT, float((v[k] + v[k + 1]) / 2), self.code(f, at[k] + 1), float(cp[k]), float(cn[k]), *tot, *[None] * 6, None) for k in range(len(v) - 1)]

    def spread(self, slot, f, at, lo, hi, pos, neg, off, nxt, tot, spots=None) -> list[tuple]:
        """Cuts at the quantile positions that fall on single values; picks for the other cells."""
        cp, cn = off[0] + np.cumsum(pos), off[1] + np.cumsum(neg)
        last = cp + cn
        spots = spots_of(sum(tot), self.n_bins) if spots is None else np.array(spots)
        cell = np.minimum(np.searchsorted(last, np.floor(spots), side="right"), len(last) - 1)
        out, picks = [], {}
        for s, k in zip(spots.tolist(), cell.tolist()):
            after = float(lo[k + 1]) if k + 1 < len(lo) else nxt
            if lo[k] != hi[k]:
                picks.setdefault(k, []).append(s)
                continue
            first = last[k] - pos[k] - neg[k]
            t, above = edge(s, float(lo[k]), after, first, last[k])
            p, n = (cp[k], cn[k]) if above else (cp[k] - pos[k], cn[k] - neg[k])
            if p + n > 0:
                out.append((slot, f, CUT, t, self.code(f, at[k] + above), float(p), float(n), *tot, *[None] * 6, None))
        for k, some in picks.items():
            after = float(lo[k + 1]) if k + 1 < len(lo) else nxt
            out.append((slot, f, PICK, None, -1, 0.0, 0.0, *tot, float(lo[k]), float(hi[k]), float(cp[k] - pos[k]), float(cn[k] - neg[k]), float(pos[k] + neg[k]), after, some))
        return out


class Fixed:
    """Adds counts per bin of fixed edges [bin, (neg, pos)]; ``cuts`` turns them into cuts at the edges."""

    def __init__(self, edges: list[np.ndarray], values: list[list[float] | None], raw: dict[int, int], features: list[list[int]]):
        self.edges, self.values, self.raw, self.features = edges, values, raw, features
        # code -> bin of features with a code per value
        self.tables = [None if v is None else np.searchsorted(e, v, "right") for e, v in zip(edges, values)]

    def __call__(self, acc: dict, b: Block, slot: int, rows, w) -> None:
        pos = b.pos[rows]
        for f in self.features[slot]:
            bins = np.searchsorted(self.edges[f], b.x[self.raw[f]][rows], "right") if self.tables[f] is None else self.tables[f][b.c[f][rows]]
            size = 2 * (len(self.edges[f]) + 1)
            acc.setdefault((slot, f), [np.zeros(size)])[0] += np.bincount(bins * 2 + pos, w, size)

    def cuts(self, key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
        slot, f = key
        neg, pos = arrays[0].reshape(-1, 2).T
        cp, cn, tot = np.cumsum(pos), np.cumsum(neg), (float(pos.sum()), float(neg.sum()))
        out = []
        for k, t in enumerate(self.edges[f].tolist()):
            if 0 < cp[k] + cn[k] < sum(tot):
                code = -1 if self.values[f] is None else int(np.searchsorted(self.values[f], t, "left"))
                out.append((slot, f, CUT, t, code, float(cp[k]), float(cn[k]), *tot, *[None] * 6, None))
        return out


def finer(pick: dict, v: np.ndarray) -> np.ndarray:
    """Number of the cell of equal width inside a pick."""
    return np.minimum(np.floor((v - pick["lo"]) / (pick["hi"] - pick["lo"]) * FINER), FINER - 1)


class Inside:
    """Adds counts of the values (or finer cells) inside picked cells: rows of (pick, cell, lo, hi, pos, neg)."""

    def __init__(self, picks: list, raw: dict[int, int], n_bins: int, cuts: list[list[float]]):
        self.by_slot: dict[int, dict[int, list]] = {}  # slot -> feature -> numbered picks
        # (slot, feature) -> codes of the cells that hold a pick; a feature of perhaps few values is read whole
        self.codes: dict[tuple[int, int], np.ndarray | None] = {}
        for k, p in enumerate(picks):
            key = p["slot"], p["f"]
            self.by_slot.setdefault(p["slot"], {}).setdefault(p["f"], []).append((k, p))
            codes = self.codes.setdefault(key, np.zeros(len(cuts[p["f"]]) + 1, bool))
            if p["kind"] != PICK or math.isnan(p["lo"] + p["hi"]):
                self.codes[key] = None
            elif codes is not None:
                codes[np.searchsorted(cuts[p["f"]], p["lo"], "right") : np.searchsorted(cuts[p["f"]], p["hi"], "right") + 1] = True
        self.raw, self.n_bins = raw, n_bins

    def __call__(self, b: Block, slot: int, rows, w) -> Iterator[tuple[np.ndarray, ...]]:
        for f, picks in self.by_slot.get(slot, {}).items():
            codes = self.codes[(slot, f)]
            near, weights = rows, w
            if codes is not None:
                inside = codes[b.c[f][rows]]
                near = np.flatnonzero(inside) if isinstance(rows, slice) else rows[inside]
                weights = None if w is None else w[inside]
            x = b.x[self.raw[f]][near]
            order = np.argsort(x, kind="stable")
            x, pos = x[order], b.pos[near][order]
            weights = np.ones(len(x)) if weights is None else weights[order]
            if codes is not None:
                yield from self._of_cells(picks, x, pos, weights)
                continue
            for k, p in picks:
                a, z = np.searchsorted(x, p["lo"], "left"), np.searchsorted(x, p["hi"], "right")
                if a < z:
                    yield from self._of_cells([(k, p)], x[a:z], pos[a:z], weights[a:z], p["kind"] == FEW)

    def _of_cells(self, picks: list, x: np.ndarray, pos: np.ndarray, weights: np.ndarray, few: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Counts of ascending values inside cells that do not overlap."""
        if not few and len(picks) > 1:
            picks = sorted(picks, key=lambda e: e[1]["lo"])
            lo, hi = (np.array([p[side] for _, p in picks]) for side in ("lo", "hi"))
            at = np.searchsorted(lo, x, "right") - 1
            ok = (at >= 0) & (x <= hi[at])
            at, x, pos, weights = at[ok], x[ok], pos[ok], weights[ok]
        else:
            at = np.zeros(len(x), np.int64)
            if not few and not math.isnan(picks[0][1]["lo"] + picks[0][1]["hi"]):
                ok = (x >= picks[0][1]["lo"]) & (x <= picks[0][1]["hi"])
                at, x, pos, weights = at[ok], x[ok], pos[ok], weights[ok]
        if not len(x):
            return
        cell = x.copy()
        for i, (_, p) in enumerate(picks):
            if p["kind"] == PICK and p["rows"] > VALUES:
                mine = at == i
                cell[mine] = finer(p, x[mine])
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])]))
        if few:
            # no more than tell whether there are few
            end = starts[self.n_bins + 1] if len(starts) > self.n_bins + 1 else len(x)
            starts, x, pos, weights = starts[: self.n_bins + 1], x[:end], pos[:end], weights[:end]
        ends = np.append(starts[1:], len(x)) - 1
        number = np.array([k for k, _ in picks], np.int32)
        yield number[at[starts]], x[starts], x[ends], np.add.reduceat(weights * pos, starts), np.add.reduceat(weights * ~pos, starts)


def inside_counts(blocks: DataFrame, router: Router, inside: Inside, wider: list) -> DataFrame:
    """pick, lo, hi, pos, neg: counts of the values inside the picked cells, or of finer cells of large ones."""

    def run(batches):
        for b in _blocks(batches):
            found = [part for slot, rows, w in router.open_rows(b) for part in inside(b, slot, rows, w)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["pick", "lo", "hi", "pos", "neg"])

    ship_package(blocks.sparkSession)
    got = blocks.mapInArrow(run, "pick int, lo double, hi double, pos double, neg double")
    if not wider:
        return got
    # many blocks add to the same finer cells: add them up before the shuffle
    table = F.broadcast(blocks.sparkSession.createDataFrame([(k, p["lo"], p["hi"]) for k, p in wider], "pick int, a double, z double"))  # picks of large cells
    number = F.least(F.floor((F.col("lo") - F.col("a")) / (F.col("z") - F.col("a")) * FINER), F.lit(FINER - 1)).cast("double")
    got = got.join(table, "pick", "left").withColumn("cell", F.when(F.col("a").isNull(), F.col("lo")).otherwise(number))
    return got.groupBy("pick", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).drop("cell")


def resolve(counts: DataFrame, picks: list, cutter: Cutter) -> DataFrame:
    """Cuts inside the picked cells; new picks where a finer cell still holds several values."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "doubles": pa.list_(pa.float64())}
    fields = pa.schema([pa.field(n, kinds[k]) for n, k in (p.split() for p in CUTS.split(", "))])

    def finish(k: int, lo, hi, pos, neg) -> list[tuple]:
        p = picks[k]
        cell = finer(p, lo) if p["kind"] == PICK and p["rows"] > VALUES else lo
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lo, hi, pos, neg = lo[starts], np.maximum.reduceat(hi, starts), np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        at, tot = np.zeros(len(lo), np.int64), (p["tot_pos"], p["tot_neg"])
        if p["kind"] == FEW:
            if len(lo) > cutter.n_bins:
                return []
            # marks the feature: its cuts are the midpoints
            return [(r[0], r[1], FEW, *r[3:]) for r in cutter.midpoints(p["slot"], p["f"], at, lo, pos, neg, tot)]
        return cutter.spread(p["slot"], p["f"], at, lo, hi, pos, neg, (p["off_pos"], p["off_neg"]), p["nxt"], tot, p["spots"])

    def run(batches):
        held: list = []
        now = None
        for b in batches:
            pick = b.column("pick").to_numpy()
            values = [b.column(n).to_numpy() for n in ("lo", "hi", "pos", "neg")]
            edges = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]])) if len(pick) else []
            for a, z in zip(edges, [*edges[1:], len(pick)]):
                if pick[a] != now and held:
                    yield from table(finish(now, *map(np.concatenate, zip(*held))))
                    held = []
                now = int(pick[a])
                held.append([v[a:z] for v in values])
        if held:
            yield from table(finish(now, *map(np.concatenate, zip(*held))))

    def table(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return counts.repartition("pick").sortWithinPartitions("pick", "lo").mapInArrow(run, CUTS.replace(" doubles", " array<double>"))


# --- pairs and triples --------------------------------------------------------------------------


#: What a tuple's counts are for.
PAIRS, TRIPLES, EXTRA, CLAUSES = range(4)


@dataclass
class Grid:
    """Bins of a node's features: a table code -> bin, or the thresholds of a wide feature."""

    features: list[int]
    tables: list[np.ndarray]
    sizes: list[int]
    tuples: list[tuple[int, ...]]  # places in ``features``


def bins_of(grid: Grid, b: Block, rows, raw: dict[int, int], wide: frozenset[int]) -> list[np.ndarray]:
    return [
        np.searchsorted(t, b.x[raw[f]][rows], "right") if f in wide else t[b.c[f][rows]].astype(np.int64)
        for f, t in zip(grid.features, grid.tables)
    ]


#: Cells of a bundle of tuples, and of all bundles of a pass; tuples up to which bundles are looked for.
BUNDLE, BUNDLED, FEW_TUPLES = 1 << 15, 1 << 21, 64
#: Rows of a node that are held back to be counted together, and of all nodes.
HELD, ALL_HELD = 1 << 16, 1 << 19


def bundles_of(sizes: list[int], tuples: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets of axes of at most ``BUNDLE`` cells; every tuple lies inside one, whose counts hold the tuple's as sums."""
    cells = lambda axes: math.prod(sizes[a] for a in axes)
    left, out = sorted({tuple(sorted(t)) for t in tuples}, key=lambda t: (-cells(t), t)), []
    few = len(left) <= FEW_TUPLES
    while left:
        now, best = set(left[0]), (1, 0)
        while best and few:
            best = None
            covered = sum(now.issuperset(t) for t in left)
            for extra in sorted({a for t in left for a in t} - now):
                more = now | {extra}
                if cells(more) <= BUNDLE:
                    gain = sum(more.issuperset(t) for t in left) - covered, -cells(more), extra
                    if gain[0] > 0 and (best is None or gain > best):
                        best = gain
            if best:
                now.add(best[2])
        out.append(tuple(sorted(now)))
        left = [t for t in left if not now.issuperset(t)]
    return out


@dataclass
class Axes:
    """Distinct ways to bin the features of a node, and the tuples and bundles of them."""

    features: list[int] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    finer: list[tuple[int, np.ndarray] | None] = field(default_factory=list)  # an earlier axis whose bins tell those of this one
    tuples: list[tuple[tuple, tuple[int, ...]]] = field(default_factory=list)  # (key, axes)
    bundles: list[tuple[int, ...]] = field(default_factory=list)

    def axis(self, f: int, table: np.ndarray, size: int, wide: bool) -> int:
        finer = None
        for k, (g, t) in enumerate(zip(self.features, self.tables)):
            if g == f and np.array_equal(t, table):
                return k
            if g == f and wide and self.finer[k] is None and np.isin(table, t).all():
                finer = k, np.concatenate([[0], np.searchsorted(table, t, "right")])
        self.features.append(f)
        self.tables.append(table)
        self.sizes.append(size)
        self.finer.append(finer)
        return len(self.sizes) - 1


class Tuples:
    """Adds joint counts [bin, bin(, bin), (neg, pos)] of every tuple; keys (kind, slot, i, j, k).

    Tuples of features with few bins are counted by the joint bins of a bundle of features and summed at the end. Rows of
    small nodes are held back until there are enough of them.
    """

    def __init__(self, grids: dict[tuple[int, int], Grid], raw: dict[int, int], wide: frozenset[int]):
        self.raw, self.wide = raw, wide
        self.axes: dict[int, Axes] = {}
        bundled = 0
        for (kind, slot), grid in sorted(grids.items()):
            axes = self.axes.setdefault(slot, Axes())
            places = [axes.axis(f, t, n, f in wide) for f, t, n in zip(grid.features, grid.tables, grid.sizes)]
            axes.tuples += [((kind, slot, *t, *[-1] * (3 - len(t))), tuple(places[k] for k in t)) for t in grid.tuples]
        for axes in self.axes.values():
            alone = [t for _, t in axes.tuples]
            axes.bundles = bundles_of(axes.sizes, alone)
            bundled += sum(math.prod(axes.sizes[a] for a in t) for t in axes.bundles)
            if bundled > BUNDLED:
                axes.bundles = list(dict.fromkeys(tuple(sorted(t)) for t in alone))

    def __call__(self, acc: dict, b: Block, slot: int, rows, w) -> None:
        axes = self.axes.get(slot)
        if axes is None:
            return
        bins: list[np.ndarray] = []
        for f, table, finer in zip(axes.features, axes.tables, axes.finer):
            if finer is not None:
                bins.append(finer[1][bins[finer[0]]])
            else:
                bins.append(np.searchsorted(table, b.x[self.raw[f]][rows], "right") if f in self.wide else table[b.c[f][rows]])
        held = acc.setdefault((), {})
        of = held.setdefault(slot, [])
        of.append(([v.astype(np.int32) for v in bins], b.pos[rows], w))
        if sum(len(p) for _, p, _ in of) >= HELD:
            self._add(acc, slot)
        elif sum(len(p) for parts in held.values() for _, p, _ in parts) >= ALL_HELD:
            for s in list(held):
                self._add(acc, s)

    def _add(self, acc: dict, slot: int) -> None:
        parts, axes = acc[()].pop(slot), self.axes[slot]
        bins = [np.concatenate(v).astype(np.int64) for v in zip(*[p[0] for p in parts])]
        pos = np.concatenate([p[1] for p in parts])
        w = None if all(p[2] is None for p in parts) else np.concatenate([np.ones(len(p[1])) if p[2] is None else p[2] for p in parts])
        for bundle in axes.bundles:
            place, size = bins[bundle[0]], axes.sizes[bundle[0]]
            for k in bundle[1:]:
                place, size = place * axes.sizes[k] + bins[k], size * axes.sizes[k]
            counts = np.bincount(place * 2 + pos, w, 2 * size)
            key = (slot, bundle)
            if key in acc:
                acc[key][0] += counts
            else:
                acc[key] = [counts.astype(float)]

    def finish(self, acc: dict) -> None:
        """Replace the counts of bundles by those of the tuples inside."""
        for slot in list(acc.get((), ())):
            self._add(acc, slot)
        acc.pop((), None)
        for slot, axes in self.axes.items():
            found = {b: acc.pop((slot, b))[0].reshape(*(axes.sizes[a] for a in b), 2) for b in axes.bundles if (slot, b) in acc}
            for key, used in axes.tuples if found else ():
                bundle = next(b for b in axes.bundles if set(b).issuperset(used))
                counts = found[bundle].sum(axis=tuple(i for i, a in enumerate(bundle) if a not in used))
                order = [a for a in bundle if a in used]
                acc[key] = [np.ascontiguousarray(counts.transpose(*[order.index(a) for a in used], len(used))).ravel()]


class Sides:
    """Adds, per candidate split of a node and side, counts of the bins of its features; keys (slot, candidate, side)."""

    def __init__(self, grids: dict[int, Grid], candidates: dict[int, list[Rule]], router: Router):
        self.grids, self.candidates, self.router = grids, candidates, router

    def __call__(self, acc: dict, b: Block, slot: int, rows, w) -> None:
        grid = self.grids.get(slot)
        if grid is None:
            return
        pos, bins = b.pos[rows], bins_of(grid, b, rows, self.router.raw, self.router.wide)
        for k, rule in enumerate(self.candidates[slot]):
            truth = self.router.truth(b, rule, rows)
            for side in (0, 1):
                mine = truth == bool(side)
                counts = np.concatenate([np.bincount((v * 2 + pos)[mine], None if w is None else w[mine], 2 * n) for v, n in zip(bins, grid.sizes)]).astype(float)
                key = (slot, k, side)
                if key in acc:
                    acc[key][0] += counts
                else:
                    acc[key] = [counts]


class Together:
    """Adds [(neg, pos), a, b]: rows for which truths a and b both hold; keys (slot,)."""

    def __init__(self, truths: dict[int, Callable]):
        self.truths = truths

    def __call__(self, acc: dict, b: Block, slot: int, rows, w) -> None:
        if slot not in self.truths:
            return
        pos = b.pos[rows]
        if w is None and len(pos) < 1 << 24:  # whole numbers up to there are exact in single precision
            t = np.array(self.truths[slot](b, rows), np.float32)  # [truth, row]
            both = (t @ t.T).astype(float)
            t *= pos
            hit = (t @ t.T).astype(float)
            counts = np.stack([both - hit, hit]).ravel()
        else:
            t = np.array(self.truths[slot](b, rows), float)
            weighted = t if w is None else t * w
            counts = np.stack([weighted[:, ~pos] @ t[:, ~pos].T, weighted[:, pos] @ t[:, pos].T]).ravel()
        if (slot,) in acc:
            acc[(slot,)][0] += counts
        else:
            acc[(slot,)] = [counts]

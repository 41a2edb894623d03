"""Whole groups of rows out of sorted Arrow batches, and small helpers on groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_groups(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows of a group in one partition, next to each other."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in cols)
        edges = np.flatnonzero(new)
        if not len(edges):
            held.append(batch)
            continue
        cut = int(edges[-1])
        head = held + ([batch.slice(0, cut)] if cut else [])
        n_held = sum(b.num_rows for b in held)
        inner = edges[:-1] + n_held if edges[0] or not n_held else np.append(n_held, edges[1:-1] + n_held) if len(edges) > 1 else np.empty(0, int)
        if head:
            table = pa.Table.from_batches(head)
            bounds = np.unique(np.concatenate([[0], inner, [table.num_rows]]))
            yield table, bounds.astype(int)
        held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, table.num_rows])


def rows_of(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

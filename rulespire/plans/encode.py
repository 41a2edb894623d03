"""Rows as small integer codes.

A fit passes over the rows once per level. Raw doubles are therefore replaced once by
codes: a feature with few distinct values gets one code per value, a finer-grained one
gets ``max_codes`` quantile cells. A code test ``code >= c`` is the same as
``x >= cuts[c - 1]``, so rules found on codes are exact on raw values. Cells only guide the
search: with ``exact`` the values of finer-grained features stay beside the codes and fits
cut anywhere between two of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from rulespire.operators.profile import unpivot


@dataclass
class Encoded:
    """``df`` has y, w, c array<smallint> and the kept columns."""

    df: DataFrame
    features: list[str]
    cuts: list[list[float]]  # ascending; code = number of cuts <= x
    values: list[list[float] | None]  # distinct values per code, None for quantile cells
    n_rows: int
    collapsed: bool = False
    raw: list[str] = field(default_factory=list)  # features whose values stand beside the codes

    def codes(self, f: int) -> int:
        return len(self.cuts[f]) + 1


#: Tables up to so many rows are dealt out evenly, whatever files they came from.
FEW_ROWS = 5_000_000


def _dictionaries(df: DataFrame, features: list[str], max_codes: int) -> tuple[dict[str, list[float]], int]:
    """Distinct values of the features that have at most max_codes of them, and the number of rows."""
    est = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(f, 0.05) for f in features]).first()
    small = [f for f, k in zip(features, est[1:]) if k <= max_codes]
    if not small:
        return {}, est[0]
    found = unpivot(df, small).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    # at most features x ~1.2 max_codes values; a feature above the limit is dropped below
    values = found.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("v")).collect()
    return {r["feature"]: [v + 0.0 for v in r["v"]] for r in values if len(r["v"]) <= max_codes}, est[0]


def _quantile_cuts(df: DataFrame, features: list[str], max_codes: int) -> dict[str, list[float]]:
    probs = [i / max_codes for i in range(1, max_codes)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, 10 * max_codes).alias(f) for f in features]).first()
    return {f: sorted({v + 0.0 for v in row[f]}) for f in features}


def encode(df: DataFrame, label: str, features: list[str], max_codes: int = 1024, weight: str | None = None,
           keep: list[str] = (), collapse: bool = True, row_key: str | None = None, exact: bool = False, cache: bool = True, values_only: bool = False) -> Encoded:
    """Learn the codes in at most three passes and add them to the rows; fits that pack them need no cache.

    With ``values_only`` the rows keep all their features and get no codes; packing adds them.
    """
    kept = list(dict.fromkeys([*keep, *([row_key] if row_key else [])]))
    df = df.select(*[k for k in kept if k not in features], F.col(label).cast("int").alias("y"),
                   (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                   # + 0.0: a negative zero must get the code of zero, as x >= 0 is true for it
                   *[(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in features])
    words, n_rows = _dictionaries(df, features, max_codes)
    rest = [f for f in features if f not in words]
    cells = _quantile_cuts(df, rest, max_codes) if rest else {}
    if exact:
        kept = list(dict.fromkeys([*kept, *rest]))
    cuts, values = [], []
    for f in features:
        if f in words:
            v = words[f]
            cuts.append([(a + b) / 2 if a < (a + b) / 2 <= b else b for a, b in zip(v, v[1:])])
            values.append(v)
        else:
            cuts.append(cells[f])
            values.append(None)
    coded = [f for f, c in zip(features, cuts) if c and not values_only]
    out = df
    if coded:
        inf = float("inf")
        out = Bucketizer(
            splitsArray=[[-inf, *c, inf] for c in cuts if c], inputCols=coded, outputCols=[f"__code_{f}" for f in coded],
        ).transform(df)
    codes = [] if values_only else [F.array(*[(F.col(f"__code_{f}") if c else F.lit(0)).cast("smallint") for f, c in zip(features, cuts)]).alias("c")]
    out = out.select(*dict.fromkeys([*kept, *(features if values_only else [])]), "y", "w", *codes)
    collapsed = False
    if collapse and not kept:
        distinct = out.agg(F.approx_count_distinct(F.struct("y", "c"))).first()[0]
        if distinct * 4 < n_rows:  # equal rows are worth adding up
            out = out.groupBy("y", "c").agg(F.sum("w").alias("w"))
            collapsed = True
    if not collapsed and n_rows <= FEW_ROWS:
        out = out.repartition(df.sparkSession.sparkContext.defaultParallelism)
    out = out.persist(StorageLevel.MEMORY_AND_DISK) if cache else out
    return Encoded(out, list(features), cuts, values, n_rows, collapsed, [f for f in features if f in kept])

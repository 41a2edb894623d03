"""Joint class counts over 1-3 bin axes, cumulative counts and range counts.

Rows are aggregated once (map-side combine keeps the shuffle at cells, not rows); the
windows below run on cells only. Cells of a tuple are bounded by its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

AXES = ("bi", "bj", "bk")


def class_counts(df: DataFrame, by: list[str], y: str = "y", w: str | None = None) -> DataFrame:
    weight = F.col(w) if w else F.lit(1.0)
    return df.groupBy(*by).agg(
        F.sum(F.when(F.col(y) == 1, weight).otherwise(F.lit(0.0))).alias("pos"),
        F.sum(F.when(F.col(y) == 1, F.lit(0.0)).otherwise(weight)).alias("neg"),
    )


def densify(cells: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Add empty cells so that every tuple has its full grid.

    One cell of each tuple also emits the zero cells of the whole grid, which one
    aggregation merges. The input is read once and shuffled once, by tuple; everything
    after it, including ``cumulate``, stays in that placement.
    """
    placed = cells.select(*keys, *axes, "pos", "neg").repartition(*keys) if keys else cells.select(*axes, "pos", "neg").repartition(1)
    whole = W.partitionBy(*keys)
    out = placed.withColumns({
        **{f"__n_{a}": F.max(a).over(whole) + 1 for a in axes},
        "__first": F.row_number().over(whole.orderBy(*axes)) == 1,
    })
    own, size = F.lit(0), F.lit(1)
    for a in axes:
        own, size = own * F.col(f"__n_{a}") + F.col(a), size * F.col(f"__n_{a}")
    spots = F.when(F.col("__first"), F.concat(F.array(own), F.sequence(F.lit(0), size - 1))).otherwise(F.array(own))
    sizes = [f"__n_{a}" for a in axes]
    out = out.select(*keys, *sizes, "pos", "neg", F.posexplode(spots).alias("__i", "__at"))
    real = lambda c: F.sum(F.when(F.col("__i") == 0, F.col(c)).otherwise(F.lit(0.0))).alias(c)
    out = out.groupBy(*keys, *sizes, "__at").agg(real("pos"), real("neg"))
    rest = F.col("__at")
    for a in reversed(axes):
        out = out.withColumn(a, F.pmod(rest, F.col(f"__n_{a}")).cast("int"))
        rest = F.call_function("div", rest, F.col(f"__n_{a}"))
    return out.select(*keys, *axes, "pos", "neg")


def cumulate(cells: DataFrame, keys: list[str], axes: list[str], placed: bool = False) -> DataFrame:
    """Prefix counts along every axis, with all margins.

    For each axis a running sum and a total are kept, so after k axes there is one
    column per subset of axes: ``c_xx`` runs on the axes marked x and totals those
    marked t. ``c_x..x`` is the full prefix, ``c_t..t`` the tuple total. Cells are
    first placed by tuple (``placed``: they already are), so all axes share one exchange.
    """
    out = cells.repartition(*keys) if keys and not placed else cells
    names = {"": ("pos", "neg")}
    for a in reversed(axes):
        part = [*keys, *[o for o in axes if o != a]]
        run = W.partitionBy(*part).orderBy(a).rowsBetween(W.unboundedPreceding, W.currentRow)
        full = W.partitionBy(*part).orderBy(a).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        step, new = {}, {}
        for tag, (p, n) in names.items():
            for mark, win in (("x", run), ("t", full)):
                step[f"p_{mark}{tag}"] = F.sum(p).over(win)
                step[f"n_{mark}{tag}"] = F.sum(n).over(win)
                new[mark + tag] = (f"p_{mark}{tag}", f"n_{mark}{tag}")
        drop = [c for pair in names.values() for c in pair if c not in ("pos", "neg")]
        out = out.withColumns(step).drop(*drop)
        names = new
    return out


def range_counts(cells: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Counts inside half-open bin ranges on several axes."""
    inside = F.lit(True)
    for axis, (lo, hi) in ranges.items():
        inside = inside & (F.col(axis) >= lo) & (F.col(axis) < hi)
    return cells.filter(inside).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def union_counts(cells: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Counts of rows inside at least one of the per-axis ranges."""
    inside = F.lit(False)
    for axis, (lo, hi) in ranges.items():
        inside = inside | ((F.col(axis) >= lo) & (F.col(axis) < hi))
    hit = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(F.lit(0.0)))
    return cells.groupBy(*keys).agg(hit("pos").alias("pos"), hit("neg").alias("neg"))

"""Bin edges and bin assignment for many features at once.

Edge tables are long: (keys..., feature, edges array<double>). Inputs are unpivoted
rows (keys..., feature, value[, y]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.scores import gini
from rulespire.operators.scan import exact_quantiles, prefix_sums


def quantile_edges(long: DataFrame, keys: list[str], n_bins: int, approx: bool = False) -> DataFrame:
    """n_bins + 1 percentiles per feature, raw (not yet cleaned)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    if approx:
        return long.groupBy(*keys).agg(F.percentile_approx("value", probs, 10000).alias("edges"))
    q = exact_quantiles(long, keys, "value", probs)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "quantile")))  # n_bins + 1 entries
    return q.groupBy(*keys).agg(F.transform(ordered, lambda s: s.quantile).alias("edges"))


def equal_width_edges(long: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    span = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / n_bins
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.col("lo") + i * step)
    return span.select(*keys, edges.alias("edges"))


def clean_edges(edges: Column) -> Column:
    """Distinct and sorted; a constant gets a hair on both sides, two values a midpoint."""
    e = F.array_sort(F.array_distinct(edges))
    a, b = F.get(e, F.lit(0)), F.get(e, F.lit(1))
    return (
        F.when(F.size(e) == 1, F.array(a - F.lit(1e-10), a, a + F.lit(1e-10)))
        .when(F.size(e) == 2, F.array(a, (a + b) / 2, b))
        .otherwise(e)
    )


def interior(edges: Column) -> Column:
    return F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin = number of interior edges not above the value."""
    return F.size(F.filter(interior(edges), lambda e: e <= value))


def bin_count(edges: Column) -> Column:
    return F.size(edges) - 1


def assign_bins(long: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``bin``; the edge table is features x bins numbers, so it is broadcast."""
    return long.join(F.broadcast(edges), keys).withColumn("bin", bin_of(F.col("value"), F.col("edges"))).drop("edges")


def density_edges(long: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """n_bins / 2 quantile bins; bins holding over 1.5 x the median count are halved."""
    base = quantile_edges(long, keys, n_bins // 2).withColumn("edges", F.array_sort(F.array_distinct("edges")))
    top = F.size("edges") - 2
    counted = (
        long.join(F.broadcast(base), keys)
        .withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, top))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    )
    grid = base.select(*keys, F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("bin", "lo"), "edges")
    grid = grid.select(*keys, "bin", "lo", F.get("edges", F.col("bin") + 1).alias("hi"))
    full = grid.join(counted, [*keys, "bin"], "left").na.fill({"cnt": 0})
    middle = full.groupBy(*keys).agg(F.percentile("cnt", 0.5).alias("mid"))  # one row per bin: n_bins / 2 values
    split = F.when(F.col("cnt") > F.col("mid") * 1.5, F.array("lo", (F.col("lo") + F.col("hi")) / 2, "hi")).otherwise(F.array("lo", "hi"))
    refined = full.join(F.broadcast(middle), keys).select(*keys, split.alias("e"))
    return refined.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("edges"))


def supervised_edges(long: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Best-first Gini splits of each feature into at most ``n_bins`` segments.

    Works on per-value class counts. One round splits, for every feature at once, the
    segment with the largest impurity drop; only the chosen cuts (features x bins
    numbers) go through the driver between rounds.
    """
    spark = long.sparkSession
    counts = (
        long.groupBy(*keys, "value")
        .agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
        .persist()
    )
    from rulespire.operators.scan import splitters
    from rulespire.session import cut_lineage

    borders = splitters(counts, keys, "value")
    cum = prefix_sums(counts, keys, "value", ["pos", "neg"], borders)
    cum = cum.withColumn("cut", (F.col("value") + F.col("next_value")) / 2).persist()
    schema = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in keys)
    chosen: dict[tuple, list[float]] = {tuple(r): [] for r in borders.select(*keys).collect()}  # features
    open_keys = set(chosen)
    while open_keys:
        cuts = spark.createDataFrame([(*k, sorted(chosen[k])) for k in open_keys], f"{schema}, cuts array<double>")
        seg = cum.join(F.broadcast(cuts), keys).withColumn("seg", F.size(F.filter("cuts", lambda c: c <= F.col("value"))))
        bounds = seg.groupBy(*keys, "seg").agg(
            F.min(F.col("cum_pos") - F.col("pos")).alias("p0"), F.max("cum_pos").alias("p1"),
            F.min(F.col("cum_neg") - F.col("neg")).alias("n0"), F.max("cum_neg").alias("n1"), F.max("value").alias("last"),
        )
        # features x segments rows
        cand = seg.join(F.broadcast(bounds), [*keys, "seg"]).filter(F.col("value") < F.col("last"))
        lp, ln = F.col("cum_pos") - F.col("p0"), F.col("cum_neg") - F.col("n0")
        tp, tn = F.col("p1") - F.col("p0"), F.col("n1") - F.col("n0")
        drop = gini(tp, tn) - gini(lp, ln) - gini(tp - lp, tn - ln)
        best = (
            cand.withColumn("drop", F.round(drop, 9)).filter(F.col("drop") > 0)
            .groupBy(*keys).agg(F.max_by("cut", F.struct(F.col("drop"), -F.col("cut"))).alias("cut"))
            .collect()
        )
        open_keys = set()
        for r in best:
            k = tuple(r[c] for c in keys)
            chosen[k].append(r["cut"])
            if len(chosen[k]) < n_bins - 1:
                open_keys.add(k)
    span = cut_lineage(counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    counts.unpersist()
    cum.unpersist()
    table = spark.createDataFrame([(*k, sorted(v)) for k, v in chosen.items()], f"{schema}, cuts array<double>")
    return span.join(F.broadcast(table), keys).select(
        *keys, F.array_sort(F.array_distinct(F.concat(F.array("lo"), "cuts", F.array("hi")))).alias("edges"))


def local_cuts(hist: DataFrame, keys: list[str], n_bins: int, value: str = "value") -> DataFrame:
    """Group-local thresholds from a value histogram (keys, value, pos, neg).

    A constant has none; up to n_bins distinct values give the midpoints of
    neighbours; more give the n_bins - 1 inner quantiles (linear interpolation).
    Output: (keys, threshold, cum_pos, cum_neg, tot_pos, tot_neg) where cum_* count the
    rows below the threshold. Values are added up in ordered buckets, so a group may have any number of them.
    """
    distinct = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_values"))
    h = prefix_sums(hist, keys, value, ["pos", "neg"]).withColumnRenamed(f"next_{value}", "nxt").join(distinct, keys)
    n = F.col("tot_pos") + F.col("tot_neg")
    last = F.col("cum_pos") + F.col("cum_neg")
    first = last - F.col("pos") - F.col("neg")
    spots = F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: i * (n - 1) / F.lit(n_bins))
    on_it = F.filter(spots, lambda s: (F.floor(s) >= first) & (F.floor(s) < last))
    def edge(s):
        reaches = (F.floor(s) == last - 1) & (s > F.floor(s)) & F.col("nxt").isNotNull()
        t = F.when(reaches, F.col(value) + (s - F.floor(s)) * (F.col("nxt") - F.col(value))).otherwise(F.col(value))
        # an edge equal to the value cuts below it, one between values cuts above it
        return F.struct(t.alias("threshold"), reaches.alias("after"))
    few = F.when(F.col("nxt").isNotNull(), F.array(F.struct(
        ((F.col(value) + F.col("nxt")) / 2).alias("threshold"), F.lit(True).alias("after"))))
    picked = F.when(F.col("distinct_values") <= n_bins, few).otherwise(F.transform(on_it, edge))
    cuts = h.select(*keys, "pos", "neg", "cum_pos", "cum_neg", "tot_pos", "tot_neg", F.explode(picked).alias("c"))
    below = lambda s: F.when(F.col("c.after"), F.col(f"cum_{s}")).otherwise(F.col(f"cum_{s}") - F.col(s))
    cuts = cuts.select(*keys, F.col("c.threshold").alias("threshold"), below("pos").alias("cum_pos"), below("neg").alias("cum_neg"), "tot_pos", "tot_neg")
    cuts = cuts.filter((F.col("cum_pos") + F.col("cum_neg")) > 0)
    return cuts.groupBy(*keys, "cum_pos", "cum_neg", "tot_pos", "tot_neg").agg(F.min("threshold").alias("threshold"))


def live_features(bounds: DataFrame) -> DataFrame:
    """Features whose path interval still holds a value (bounds: ..., feature, lo, hi)."""
    return bounds.filter(F.col("lo") < F.col("hi"))

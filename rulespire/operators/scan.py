"""Ranks, running sums and quantiles over groups of any size.

A plain ``row_number`` or running ``sum`` puts a whole group into one task. Here a
group is cut into ordered buckets; a small table of bucket totals gives every bucket
its starting offset and only the inside of a bucket goes through a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rulespire.session import cut_lineage

RANK_BUCKETS = 65536
VALUE_BUCKETS = 256
BROADCAST_GROUPS = 2_000  # groups whose borders are broadcast
BROADCAST_EDGES = 100_000  # groups of which one narrow row each is broadcast


def _one_per_group(df: DataFrame) -> DataFrame:
    """One narrow row per group, written once; few of them are broadcast, so that the rows they are joined to stay where they are."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_EDGES else df


def rank_by_hash(
    df: DataFrame, keys: list[str], u: str, tie: list[str], out: str = "rank", total: str | None = None,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """Exact 1-based rank by (u, tie) within ``keys``; ``u`` is uniform in [0, 1).

    Uniform draws spread evenly over buckets, so a hot key is ranked by many tasks.
    """
    # a bucket that cannot be null needs no filter, which would make the draws once more
    b = df.withColumn("__b", F.coalesce(F.floor(F.col(u) * buckets).cast("int"), F.lit(-1)))
    totals = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys, ).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *keys, "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(whole).alias("__tot"),
    )
    inside = W.partitionBy(*keys, "__b").orderBy(u, *tie)
    ranked = (
        b.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn(out, F.col("__r") + F.col("__off"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("__tot"))
    return ranked.drop("__b", "__r", "__off", "__tot")


def last_by_hash(df: DataFrame, keys: list[str], u: str, tie: list[str], take) -> DataFrame:
    """(keys, __last): the last (draw, tie) of the ``take(n)`` rows of each group with the smallest draws; n is the group size.

    Bucket totals tell in which bucket the last taken row lies. Only that one bucket (1/65536 of
    a group) is ranked.
    """
    b = df.withColumn("__b", F.floor(F.col(u) * RANK_BUCKETS).cast("int"))
    totals = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    size = F.sum("__n").over(W.partitionBy(*keys))
    run = totals.select(*keys, "__b", "__n", F.sum("__n").over(order).alias("__cum"), take(size).alias("__take"))
    # last bucket that starts before the quota is full, and what is left for it
    edge = run.filter(F.col("__cum") - F.col("__n") < F.col("__take")).groupBy(*keys).agg(
        F.max("__b").alias("__edge"), F.max_by(F.col("__take") - F.col("__cum") + F.col("__n"), "__b").alias("__left"))
    near = b.join(_one_per_group(edge), keys).filter(F.col("__b") == F.col("__edge")).select(*keys, "__left", F.struct(u, *tie).alias("__at"))
    ranked = near.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy("__at")))
    return ranked.filter(F.col("__i") <= F.col("__left")).groupBy(*keys).agg(F.max("__at").alias("__last"))


def smallest_by_hash(df: DataFrame, keys: list[str], u: str, tie: list[str], take, flag: str = "taken") -> DataFrame:
    """Flag the ``take(n)`` rows of each group with the smallest draws; n is the group size.

    The rows are compared with the last taken one of their group in one pass and neither shuffled nor sorted. Rows that
    agree in draw and tie share their flag.
    """
    last = _one_per_group(last_by_hash(df, keys, u, tie, take))
    # one row per group: as large as the table only where every row is its own group
    return df.join(last, keys, "left").withColumn(flag, F.coalesce(F.struct(u, *tie) <= F.col("__last"), F.lit(False))).drop("__last")


def splitters(df: DataFrame, keys: list[str], value: str, buckets: int = VALUE_BUCKETS) -> DataFrame:
    """Bucket borders per group from a mergeable sketch: groups x buckets numbers.

    They are written once, so every later pass uses the same borders. Which borders
    come back only balances the work; results do not depend on them.
    """
    probs = [i / buckets for i in range(1, buckets)]
    rows = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 4 * buckets).alias("__s"))
    return cut_lineage(rows.select(*keys, F.coalesce(F.array_sort(F.array_distinct("__s")), F.array().cast("array<double>")).alias("__s")))


def _with_value_bucket(df: DataFrame, keys: list[str], value: str, borders: DataFrame) -> DataFrame:
    few = borders.count() <= BROADCAST_GROUPS  # groups x buckets numbers
    joined = df.join(F.broadcast(borders) if few else borders, keys)
    return joined.withColumn("__b", _count_below(F.col("__s"), F.col(value))).drop("__s")


def _count_below(borders: Column, value: Column, block: int = 16) -> Column:
    """Number of sorted borders at or below the value: first by blocks, then inside one."""
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(borders), F.lit(1)), F.lit(block)), lambda i: F.get(borders, i - 1))
    full = F.greatest(F.size(F.filter(heads, lambda h: h <= value)) - 1, F.lit(0)) * block
    return full + F.size(F.filter(F.slice(borders, full + 1, F.lit(block)), lambda b: b <= value))


def prefix_sums(
    counts: DataFrame, keys: list[str], value: str, sums: list[str], borders: DataFrame | None = None,
    positions: list[float] | None = None,
) -> DataFrame:
    """Running sums of ``sums`` by ascending ``value`` within ``keys``.

    ``counts`` has one row per (keys, value) - duplicates are already added up, so a hot
    value is one row. Adds ``cum_<s>`` (up to and with the row), ``tot_<s>`` and
    ``next_<value>`` (the following value of the group or NULL). ``positions`` are shares p of
    the first sum's total: only buckets that hold a position p * (total - 1) are scanned and
    ``__hits`` lists those positions.
    """
    borders = splitters(counts, keys, value) if borders is None else borders
    b = _with_value_bucket(counts, keys, value, borders)
    per_bucket = b.groupBy(*keys, "__b").agg(
        F.min(value).alias("__first"), *[F.sum(s).alias(f"__t_{s}") for s in sums]
    )
    order = W.partitionBy(*keys).orderBy("__b")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "__b",
        F.lead("__first").over(order).alias("__after"),
        *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(W.partitionBy(*keys)).alias(f"tot_{s}") for s in sums],
    )
    if positions is not None:
        off, tot = F.col(f"__off_{sums[0]}"), F.col(f"tot_{sums[0]}")
        wanted = F.array(*[
            F.struct(F.lit(i).alias("idx"), F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (tot - 1)).alias("pos"))
            for i, p in enumerate(positions)])
        size = F.lead(off).over(order)
        offsets = offsets.withColumn("__end", F.coalesce(size, tot)).withColumn(
            "__hits", F.filter(wanted, lambda w: (F.floor(w.pos) >= off) & (F.floor(w.pos) < F.col("__end")))
        ).filter(F.size("__hits") > 0).drop("__end")
        b = b.join(offsets, [*keys, "__b"])
    inside = W.partitionBy(*keys, "__b").orderBy(value)
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    out = b.withColumn("__next", F.lead(value).over(inside)).withColumns({f"__c_{s}": F.sum(s).over(running) for s in sums})
    out = out if positions is not None else out.join(offsets, [*keys, "__b"])
    return (
        out
        .withColumns({f"cum_{s}": F.col(f"__c_{s}") + F.col(f"__off_{s}") for s in sums})
        .withColumn(f"next_{value}", F.coalesce("__next", "__after"))
        .drop("__b", "__next", "__after", *[f"__c_{s}" for s in sums], *[f"__off_{s}" for s in sums])
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, idx, prob, quantile).

    The built-in exact ``percentile`` keeps all values of a group in one task. This one
    adds up equal values first and ranks them bucket by bucket.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__cnt"))
    cum = prefix_sums(counts, keys, value, ["__cnt"], positions=probs)
    first = F.col("cum___cnt") - F.col("__cnt")
    # position p falls on this value (floor) and may reach into the next one
    here = F.filter("__hits", lambda w: (F.floor(w.pos) >= first) & (F.floor(w.pos) < F.col("cum___cnt")))
    hit = cum.withColumn("__hits", here).filter(F.size("__hits") > 0)
    out = hit.select(*keys, value, f"next_{value}", "cum___cnt", F.explode("__hits").alias("w"))
    frac = F.col("w.pos") - F.floor("w.pos")
    reaches = F.floor(F.col("w.pos")) == F.col("cum___cnt") - 1
    step = F.when(reaches & (frac > 0), frac * (F.col(f"next_{value}") - F.col(value))).otherwise(F.lit(0.0))
    return out.select(*keys, F.col("w.idx").alias("idx"), F.col("w.prob").alias("prob"), (F.col(value) + step).alias("quantile"))

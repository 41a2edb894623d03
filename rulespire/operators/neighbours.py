"""Information of a number about a label, estimated from nearest neighbours instead of bins.

For a row, r is the distance to its k-th nearest neighbour of its class (k is lowered to the rest of a small class), m the
number of rows nearer than r, itself included, and m_c those of its class: k where no distances are equal. With psi the
digamma function and n_c the size of its class,

    information = psi(N) + mean(psi(m_c) - psi(m) - psi(n_c)), in nats and at least 0.

Where more than k rows of the class share a value, r is 0; then the rows of the value are counted. So ties
need no noise, and two-valued columns are right as well. Equal values are one row from the first step on. Rows with
a null or not finite value or a null label, and classes of one row, are left out; without rows the information is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.scores import digamma
from rulespire.operators.profile import unpivot
from rulespire.operators.scan import prefix_sums
from rulespire.session import cut_lineage


def neighbour_information(rows: DataFrame, keys: list[str], value: str = "value", y: str = "y", k: int = 3) -> DataFrame:
    """(keys, feature_score): estimated information of ``value`` about the label for every group of ``keys``."""
    rows = rows.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)], F.col(value).alias("__value"), F.col(y).alias("__y"))  # names cannot clash below
    names, keys, value, y = keys, [f"__g{i}" for i in range(len(keys))], "__value", "__y"
    groups = rows.select(*keys).distinct()
    finite = F.col(y).isNotNull() & (F.abs(F.col(value)) < float("inf"))  # NaN is above infinity
    counts = rows.filter(finite).groupBy(*keys, (F.col(value) + F.lit(0.0)).alias("v"), (F.col(y) == 1).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts.withColumn("one", F.lit(1)), [*keys, "c"], "v", ["one", "n"])
    ranked = cut_lineage(ranked.select(*keys, "c", "v", "n", F.col("cum_one").alias("rank"), F.col("tot_n").alias("n_c")).filter("n_c > 1"))
    near = _ends(ranked, keys, k)
    # the ends become values without rows, so that one running sum counts the rows below all of them
    marks = ranked.select(*keys, "v", "n").unionByName(near.select(*keys, F.explode(F.array("lo", "hi")).alias("v"), F.lit(0).cast("long").alias("n")))
    below = prefix_sums(marks.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys, "v", ["n"])
    upto = below.select(*keys, F.col("v").alias("lo"), F.col("cum_n").alias("upto"), F.col("n").alias("here"))
    before = below.select(*keys, F.col("v").alias("hi"), (F.col("cum_n") - F.col("n")).alias("before"))
    m = F.when(F.col("lo") < F.col("hi"), F.col("before") - F.col("upto")).otherwise(F.col("here"))
    each = near.join(upto, [*keys, "lo"]).join(before, [*keys, "hi"]).select(*keys, "n", (digamma(F.col("m_c")) - digamma(m) - digamma(F.col("n_c"))).alias("part"))
    found = each.groupBy(*keys).agg(F.greatest(digamma(F.sum("n")) + F.sum(F.col("n") * F.col("part")) / F.sum("n"), F.lit(0.0)).alias("feature_score"))
    score = F.coalesce("feature_score", F.lit(0.0)).alias("feature_score")
    return groups.join(found, keys, "left").select(*[F.col(g).alias(c) for g, c in zip(keys, names)], score)


def _ends(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, c, v, n, n_c, m_c, lo, hi): rows strictly between lo and hi are nearer than the k-th neighbour; lo = hi where it
    is at the value itself.

    The k values on both sides hold the neighbours. Every value sends itself to the ranks around it, 2 k + 1
    small rows, so no class is sorted in one task and no border needs care.
    """
    at = ranked.select(*keys, "c", "v", "n", "n_c", "rank", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("j"))
    own = lambda c: F.max(F.when(F.col("j") == 0, F.col(c))).alias(c)
    around = at.groupBy(*keys, "c", (F.col("rank") + F.col("j")).alias("rank")).agg(
        own("v"), own("n"), own("n_c"), F.collect_list(F.when(F.col("j") != 0, F.struct("v", "n"))).alias("near")).filter("v is not null")
    around = around.withColumn("k", F.least(F.lit(k).cast("long"), F.col("n_c") - 1))
    others = F.transform("near", lambda x: F.array_repeat(F.abs(x.v - F.col("v")), F.least(x.n, F.lit(k)).cast("int")))
    own_copies = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    around = around.withColumn("r", F.get(F.array_sort(F.concat(own_copies, F.flatten(others))), F.col("k").cast("int") - 1))

    def end(sign: int) -> Column:
        """The neighbour's value itself where one lies there, as its distance was rounded."""
        there = F.filter("near", lambda x: (F.abs(x.v - F.col("v")) == F.col("r")) & ((x.v > F.col("v")) == F.lit(sign > 0)))
        values = F.transform(there, lambda x: x.v)
        return F.coalesce(F.array_min(values) if sign > 0 else F.array_max(values), F.col("v") + sign * F.col("r"))

    tied = F.col("r") == 0
    nearer = F.aggregate("near", F.col("n"), lambda s, x: s + F.when(F.abs(x.v - F.col("v")) < F.col("r"), x.n).otherwise(0))
    return around.select(*keys, "c", "v", "n", "n_c", nearer.alias("m_c"),
                         F.when(tied, F.col("v")).otherwise(end(-1)).alias("lo"), F.when(tied, F.col("v")).otherwise(end(1)).alias("hi"))


def feature_information(df: DataFrame, label: str, features: list[str], k: int = 3) -> DataFrame:
    """(feature, feature_score) of the columns of a table."""
    return neighbour_information(unpivot(df, features, [label]), ["feature"], "value", label, k)

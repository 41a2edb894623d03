"""Connected components of a table of links.

Alternates two steps until nothing changes: every node hands its larger neighbours to its
smallest one, then every node links its smaller neighbours to the smallest. Both are a
minimum per node (combined before the shuffle) and a join back, so a node with very many links
needs no task that holds them all. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespire.session import cut_lineage


#: Arcs per task: rounds on few arcs are not spread over more tasks and files than they need.
ARCS = 20_000


def _to_least(arcs: DataFrame, tasks: int) -> DataFrame:
    """arcs (u, v) -> (u, v, m): m is the least of u and all its v."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    return arcs.join(least, F.col("u") == F.col("u_")).select("u", "v", "m").coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component) for every node with a link; component is the least node reachable."""
    arcs = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = arcs.count() // ARCS + 1
    arcs = arcs.coalesce(tasks)
    while True:
        # done when every node has one smaller neighbour, which has none
        inner = arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        heads = arcs.select(F.col("v").alias("u")).distinct().withColumn("head", F.lit(True))
        if inner.join(heads, "u", "left").filter("n > 1 or head").isEmpty():
            break
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, tasks).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _to_least(large, tasks)
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        arcs = cut_lineage(small.distinct().coalesce(tasks))
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(arcs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

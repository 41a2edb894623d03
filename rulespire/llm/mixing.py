"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, offered ``passes`` times. The
virtual finish time of a document is the number of tokens its source has sent when the
document is through, divided by the source's weight. All documents are put in the order of
their finish times and the queue is cut where the budget of tokens is spent. A source that
runs dry leaves its share to the others, so the cut meets the targets of ``targets``.

Nothing is sorted by one task: a source's running sum is made of 4096 slices of the shuffled
order, the order of finish times of ranges of virtual time (every weight sends at a constant
rate, so equal ranges hold about equal numbers of tokens).

Defined cases: a null source is a source of its own, ordered last; null and empty texts have
size 0 and take nothing; a null doc_id is an id like any other; equal rows are separate
documents; an empty table gives an empty result; other columns of the input are not read by
``fair_queue`` and are passed through by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespire.llm.common import WORD, document_hash, document_hash_sql, fresh, small
from rulespire.session import cut_lineage

SEED = "mix"
WEIGHTS = (3, 1, 2)
SLICES = 4096
#: Ranges of virtual time up to the expected cut, and in all.
RANGES, ALL_RANGES = 8192, 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words), u (place in the shuffled order) and a row id, written once."""
    df = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(seed, F.col("doc_id"), F.col("text")).alias("u"))
    return cut_lineage(df.withColumn("row_id", F.monotonically_increasing_id()))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per source: weight, source_size, target and level, the virtual time of the cut.

    Sources by code point, null last, take the weights in turn. ``share`` of all tokens is dealt
    by weight; no source gets more than ``passes`` times its size, and what it leaves goes to the
    others by weight. Sources sorted by size over weight fill up in that order, so the number
    of full ones follows from running sums.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    per = per.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "budget": F.sum("source_size").over(every) * float(share),
        "full_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("level_here", (F.col("budget") - F.col("full_before")) / F.col("open_weight"))
    # the first source that its level doesn't fill is the first open one; beyond all caps every source is full
    per = per.withColumn("level", F.coalesce(F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(every)["level_here"], F.max("ratio").over(every)))
    return per.select("source", "weight", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"), "level", "budget")


def fair_queue(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per document and pass up to the cut's range of virtual time, in queue order by
    (finish, source, u, row_id): ``position`` is the number of tokens before it, ``taken`` tells whether it is
    within the budget."""
    to = cut_lineage(targets(sized, weights, share, passes))
    slice_of = F.shiftright("u", 48).alias("slice")
    step = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = sized.groupBy("source", slice_of).agg(F.sum("size").alias("n")).select(F.col("source").alias("s_"), F.col("slice").alias("sl_"), F.coalesce(F.sum("n").over(step), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("u", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("slice", slice_of).withColumn("sent", F.sum("size").over(inside))
    run = run.join(offset, F.col("source").eqNullSafe(F.col("s_")) & (F.col("slice") == F.col("sl_"))).withColumn("sent", F.col("sent") + F.col("offset"))
    per = to.select(F.col("source").alias("s2_"), "weight", "source_size", "target", "level", "budget")
    run = run.join(per, F.col("source").eqNullSafe(F.col("s2_"))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("weight")
    run = run.withColumn("finish", finish).withColumn("range", F.when(F.col("level") > 0, F.least(F.floor(F.col("finish") / F.col("level") * RANGES), F.lit(ALL_RANGES - 1))).otherwise(0).cast("int"))
    run = run.select("row_id", "doc_id", "source", "size", "u", "pass", "source_size", "target", "budget", "finish", "range")
    # at most ALL_RANGES rows, whatever the input
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = run.groupBy("range").agg(F.sum("size").alias("n"), F.first("budget").alias("b")).withColumn("before", F.coalesce(F.sum("n").over(every), F.lit(0)))
    ranges = ranges.filter(F.col("before") <= F.col("b")).select(F.col("range").alias("r_"), "before")
    queue = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "u", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    out = run.join(F.broadcast(ranges), F.col("range") == F.col("r_")).withColumn("end", F.col("before") + F.sum("size").over(queue))
    return out.select("row_id", "doc_id", "source", "u", "pass", "size", "source_size", "target", "finish", (F.col("end") - F.col("size")).alias("position"), (F.col("end") <= F.col("budget")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: str = SEED) -> DataFrame:
    """The documents that the queue takes, with all their columns, once for each pass that takes them.

    What a source sends in a pass is a beginning of its shuffled order, so the last place taken
    per source and pass is all that the documents need to know; texts are not shuffled. Equal
    rows share a place: the one at the cut lets in its equals.
    """
    sized = sized_documents(docs, seed)
    last = fair_queue(sized, weights, share, passes).filter("taken").groupBy("source", "pass").agg(F.max("u").alias("u"))
    s, u, p = fresh(docs, "mix_source", "mix_last", "mix_pass")
    last = small(last.select(F.col("source").alias(s), F.col("u").alias(u), F.col("pass").alias(p)))
    place = document_hash(seed, docs["doc_id"], docs["text"])
    return docs.join(last, docs["source"].eqNullSafe(last[s])).filter(place <= last[u]).select(*[docs[c] for c in docs.columns])


def op2_weighted_mix(spark, sf: str) -> DataFrame:
    """Words the mix takes of every document."""
    sized = sized_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    taken = fair_queue(sized).filter("taken").groupBy("row_id").agg(F.sum("size").alias("taken"))
    per = targets(sized).select(F.col("source").alias("s_"), "source_size", "target")
    rows = sized.join(taken, "row_id", "left").join(per, F.col("source").eqNullSafe(F.col("s_")))
    return rows.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))


ORACLE = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, {document_hash_sql(SEED)} AS u FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
b AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, 2.0 * source_size / w AS ratio FROM p),
f AS (SELECT *, (budget - coalesce(sum(2.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv FROM b
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(2.0 * source_size, w * (SELECT arg_min(lv, ratio) FROM f WHERE lv <= ratio)) AS target FROM f),
q AS (SELECT d.*, source_size, target, budget, w, (e * source_size + sum(size) OVER (PARTITION BY d.source, e ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING)) / w AS finish
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) passes(e)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, u, doc_id ROWS UNBOUNDED PRECEDING) <= budget AS ok FROM q)
SELECT doc_id, source, size, source_size, round(target, 3) AS target, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS taken FROM r GROUP BY ALL"""

"""Sharding over a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65 536 ticks. Every shard owns ``vnodes`` places on it, fixed by the shard's
number alone; a key belongs to the first place at or after its own tick. A shard takes its
own keys in ring order up to its bound; keys beyond it continue clockwise to the next shard
with room. With ``slack`` 0 the bounds are the exact quotas, so shard counts are at most one
apart; with more slack fewer keys move when a shard is added.

Spark counts the keys per tick (at most 65 536 rows). The walk over the ring needs these
counts only and yields runs (arc, ranks from and to, shard, first slot); rows get their
rank inside the arc from the ticks' offsets and a window inside one tick, then find their run by
an equality join on the arc. No task holds more than one tick's rows.

Defined cases: null and empty texts have size 16 and crc 0; the key of a row is
(doc_id, text), null doc_id included, so one id with many texts spreads over the ring; equal rows get slots
of their own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespire.llm.common import document_hash, fresh

TICKS = 1 << 16
SEED = "ring"


def places(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(tick, shard) of all virtual nodes in ring order; of two on one tick the lower shard has it."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for k in range(vnodes):
            tick = int.from_bytes(hashlib.md5(f"node|{shard}|{k}".encode()).digest()[:2], "big")
            owner.setdefault(tick, shard)
    return sorted(owner.items())


def quotas(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Bounds of the shards: exact quotas, or (1 + slack) times the mean, rounded up."""
    if slack > 0:
        return [-int(-(1 + slack) * total // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(nodes: list[tuple[int, int]], loads: list[int], bound: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, from rank, to rank, shard, first slot). Own keys first, then overflow goes clockwise."""
    room, slots, runs = list(bound), [0] * len(bound), []
    rest: list[tuple[int, int]] = []

    def put(arc: int, start: int, n: int, shard: int) -> None:
        runs.append((arc, start, start + n, shard, slots[shard]))
        slots[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(nodes):
        own = min(loads[arc], room[shard])
        if own:
            put(arc, 0, own, shard)
        if loads[arc] > own:
            rest.append((arc, own))
    for arc, start in rest:
        place = arc
        while start < loads[arc]:
            place = (place + 1) % len(nodes)
            shard = nodes[place][1]
            if room[shard] > 0:
                n = min(loads[arc] - start, room[shard])
                put(arc, start, n, shard)
                start += n
    return runs


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def shard_rows(df: DataFrame, shards: int, vnodes: int = 64, slack: float = 0.0, seed: str = SEED, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``df`` (which has doc_id and text) with their shard and slot."""
    spark = df.sparkSession
    key, tick, arc_, off = fresh(df, "ring_key", "ring_tick", "ring_arc", "ring_offset")
    rank, low, high, first = fresh(df, "ring_rank", "ring_low", "ring_high", "ring_first")
    keyed = df.withColumn(key, document_hash(seed, df["doc_id"], df["text"]))
    keyed = keyed.withColumn(tick, F.shiftright(key, 44).cast("int"))
    counts = {r[tick]: r["n"] for r in keyed.groupBy(tick).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most TICKS rows
    nodes = places(shards, vnodes)
    ends, loads, ticks = [t for t, _ in nodes], [0] * len(nodes), []
    # from just behind the last place, so that the arc over the ring's end is in one piece
    for t in sorted(counts, key=lambda t: (t <= ends[-1], t)):
        arc = bisect_left(ends, t) % len(nodes)
        ticks.append((t, arc, loads[arc]))
        loads[arc] += counts[t]
    runs = walk(nodes, loads, quotas(sum(counts.values()), shards, slack))
    of_tick = spark.createDataFrame(ticks, f"t_ int, {arc_} int, {off} long")
    of_run = spark.createDataFrame(runs, f"a_ int, {low} long, {high} long, {shard} int, {first} long")
    inside = Window.partitionBy(tick).orderBy(key)
    ranked = keyed.withColumn(rank, F.row_number().over(inside) - 1)
    ranked = ranked.join(F.broadcast(of_tick), F.col(tick) == F.col("t_")).withColumn(rank, F.col(rank) + F.col(off))
    placed = ranked.join(F.broadcast(of_run), (F.col(arc_) == F.col("a_")) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], shard, (F.col(first) + F.col(rank) - F.col(low)).alias(slot))


def op9_ring_shards(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text")
    keyed = shard_rows(narrow(rows), 40)
    return keyed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def narrow(rows: DataFrame) -> DataFrame:
    """The text's size, crc and hash in place of the text, so that only these are shuffled."""
    text = F.col("text")
    return rows.select("doc_id", text_size(text).alias("size"), text_crc(text).alias("text_crc32"), F.md5(F.coalesce(text, F.lit("~"))).alias("text"))

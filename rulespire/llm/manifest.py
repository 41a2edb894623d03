"""Merkle manifest of a dataset: a 16-ary hash tree per source, a tree over the sources, proofs and verification.

A leaf hashes the columns doc_id, source, lang, n_chars and text of a row. Per source the leaves ascend by doc_id; every
16 consecutive nodes become the hash of their digests, until one is left, the source's subroot; subroots ascend by
source and become the root in the same way. ``H`` is the lowercase hex SHA-256 of concatenated text.

Method: bitmap-rank indexing. Tasks pack the doc_ids they hold into compressed bitmaps, one per source and 65 536
consecutive ids (sorted 16-bit offsets up to 4 096 ids, bits beyond, and a list of ids that occur more than once).
Bitmaps of a chunk are merged; totals of chunks, added up in ranges, give every chunk its offset. A leaf's coordinate is
a rank query: offset, plus the popcount directory's entry of its 64-bit word, plus the popcount of the bits below it. No
leaves are sorted. A level is reduced by the key (source, rank / 16) into slot arrays of at most 16 digests,
so a source of any size spreads over all tasks. Proofs run back down the levels: a run of 16 nodes is joined once with
the steps above it, and its leaves are hashed where the run is.

Ids that several different rows share, and null ids, which come first, are told apart by a second bitmap over the first
60 bits of their leaves; equal rows are counted before anything else and get consecutive places.

Defined cases: a null column is hashed as ``-``; equal rows have equal leaves on neighbouring places and one row
each in the result; a source with one leaf has that leaf as its subroot, a table with one source its subroot as the
root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespire.llm.common import crc32_sql, map_arrow
from rulespire.llm.grouped import by_groups, whole_groups
from rulespire.operators.scan import prefix_sums
from rulespire.session import cut_lineage

#: Nodes of a run.
WIDTH = 16
#: Ids of a chunk that are kept as offsets; more are kept as bits.
SPARSE = 4096
#: Copies of a row that are listed in one step.
COPIES = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Chunk of null ids, before all others.
_FIRST = -(1 << 50)


class Bitmap:
    """Distinct offsets from 0 to 65 535, compressed, with the extra weight of those that count more than once."""

    def __init__(self, low: np.ndarray, weight: np.ndarray):
        self.low, at = np.unique(low, return_inverse=True)
        self.weight = np.bincount(at, weight, len(self.low)).astype(np.int64)

    def pack(self) -> tuple[bytes, bytes]:
        low = self.low.astype("<u2")
        more = self.weight > 1
        over = low[more].astype("<i8").tobytes() + (self.weight[more] - 1).astype("<i8").tobytes()
        if len(low) <= SPARSE:
            return low.tobytes(), over
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits, bitorder="little").tobytes() + b"\0\0", over

    @staticmethod
    def offsets(bits: bytes) -> np.ndarray:
        """The offsets of a packed bitmap; bits are told from offsets by their length."""
        if len(bits) <= 2 * SPARSE:
            return np.frombuffer(bits, "<u2")
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, 8192), bitorder="little"))

    @staticmethod
    def extra(over: bytes) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(over, "<i8")
        return both[: len(both) // 2], both[len(both) // 2 :]


class Ranks:
    """Rank queries on a packed bitmap."""

    def __init__(self, bits: bytes, over: bytes):
        self.sparse = np.frombuffer(bits, "<u2") if len(bits) <= 2 * SPARSE else None
        if self.sparse is None:
            self.words = np.frombuffer(bits, "<u8", 1024)
            self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.often, more = Bitmap.extra(over)
        self.more = np.concatenate([[0], np.cumsum(more)])

    def below(self, low: np.ndarray) -> np.ndarray:
        """Weight of all offsets below each of ``low``."""
        if self.sparse is not None:
            n = np.searchsorted(self.sparse, low)
        else:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            n = self.directory[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return n.astype(np.int64) + self.more[np.searchsorted(self.often, low)]


def _pack(batches):
    """Rows (grp, chunk, low, w) in any order -> a bitmap per chunk and batch."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).sort_by([("grp", "ascending"), ("chunk", "ascending")])
            yield from _bitmaps(whole_groups(t.to_batches(), ("grp", "chunk")), lambda rows, _: (rows.column("low").to_numpy(), rows.column("w").to_numpy()))


def _merge(batches):
    def ids(rows, n):
        low, weight = [], []
        for bits, over in zip(rows.column("bits").to_pylist(), rows.column("over").to_pylist()):
            some = Bitmap.offsets(bits).astype(np.int64)
            often, more = Bitmap.extra(over)
            low += [some, often]
            weight += [np.ones(len(some)), more]
        return np.concatenate(low), np.concatenate(weight)

    yield from _bitmaps(whole_groups(batches, ("grp", "chunk")), ids)


def _bitmaps(groups, ids):
    """The bitmaps of groups of rows, in batches."""
    for table, bounds in groups:
        out = []
        for a, z in zip(bounds[:-1], bounds[1:]):
            rows = table.slice(a, z - a)
            found = Bitmap(*ids(rows, z - a))
            out.append((rows.column("grp")[0].as_py(), rows.column("chunk")[0].as_py(), *found.pack(), int(found.weight.sum())))
        grp, chunk, bits, over, total = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(chunk, pa.int64()), pa.array(bits, pa.binary()), pa.array(over, pa.binary()), pa.array(total, pa.int64())], ["grp", "chunk", "bits", "over", "total"])


def bitmap_ranks(rows: DataFrame, grp: Column, key: Column, weight: Column) -> DataFrame:
    """``rows`` with ``before``, the weight of the smaller keys of their group, and ``tot``, that of the group.

    ``grp`` is a string, ``key`` a long (null before all others); no two rows agree in both.
    """
    keyed = rows.select("*", grp.alias("grp"), F.coalesce(F.shiftright(key, 16), F.lit(_FIRST)).alias("chunk"), F.coalesce(key.bitwiseAND(F.lit(0xFFFF)), F.lit(0)).cast("int").alias("low"), weight.cast("long").alias("w"))
    schema = "grp string, chunk long, bits binary, over binary, total long"
    part = map_arrow(keyed.select("grp", "chunk", "low", "w"), _pack, schema)
    bitmaps = cut_lineage(map_arrow(by_groups(part, "grp", "chunk"), _merge, schema))
    directory = prefix_sums(bitmaps, ["grp"], "chunk", ["total"])
    names = rows.columns
    heads = directory.select("grp", "chunk", F.lit(-1).alias("low"), (F.col("cum_total") - F.col("total")).alias("before"), F.col("tot_total").alias("tot"), "bits", "over", *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names])
    none = F.lit(None)
    asked = keyed.select("grp", "chunk", "low", none.cast("long").alias("before"), none.cast("long").alias("tot"), none.cast("binary").alias("bits"), none.cast("binary").alias("over"), *names)

    def query(batches):
        ranks, first, tot = None, 0, 0
        for b in batches:
            low = b.column("low").to_numpy()
            before, total = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
            heads_at, at = np.flatnonzero(low < 0), 0
            for e in [*heads_at.tolist(), len(low)]:
                if e > at:
                    before[at:e], total[at:e] = first + ranks.below(low[at:e]), tot
                if e < len(low):
                    ranks = Ranks(b.column("bits")[e].as_py(), b.column("over")[e].as_py())
                    first, tot = b.column("before")[e].as_py(), b.column("tot")[e].as_py()
                at = e + 1
            done = pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(before), pa.array(total)], [*names, "before", "tot"])
            yield done.filter(pa.array(low >= 0))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    both = heads.unionByName(asked).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "low")
    return map_arrow(both, query, f"{kept}, before long, tot long")


def _said(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_said(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _said(text)), 256)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Distinct leaves: grp (source; null before all), pos, left (leaves of the source), copies, doc_id, leaf, altered.

    ``altered`` is the text that a later reader finds (null: the same).
    """
    told = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(altered))
    grp = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    rows = docs.select(grp.alias("src"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), told.alias("altered"))
    distinct = cut_lineage(rows.groupBy("src", "doc_id", "leaf", "altered").agg(F.count(F.lit(1)).alias("copies")))
    ids = distinct.groupBy("src", "doc_id").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("texts"), F.min("leaf").alias("leaf"), F.min("altered").alias("altered"))
    ranked = cut_lineage(bitmap_ranks(ids, F.col("src"), F.col("doc_id"), F.col("all")))
    names = "src", "doc_id", "leaf", "altered", "copies"
    single = ranked.filter("texts = 1").select("src", "doc_id", "leaf", "altered", F.col("all").alias("copies"), F.col("before").alias("pos"), F.col("tot").alias("left"))
    shared = ranked.filter("texts > 1").select(F.col("src").alias("s_"), F.col("doc_id").alias("d_"), F.col("before").alias("pos_"), F.col("tot").alias("left"))
    if shared.isEmpty():
        return single
    rows = distinct.join(shared, (F.col("src") == F.col("s_")) & F.col("doc_id").eqNullSafe(F.col("d_"))).select(*names, "pos_", "left")
    one = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), "src")
    first = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    inner = bitmap_ranks(rows, one, first, F.col("copies"))
    return single.unionByName(inner.select(*names, (F.col("pos_") + F.col("before")).alias("pos"), "left"))


def _hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """grp, run, left, slots: the nodes of a run by their place."""
    slot = F.struct((F.col("pos") % WIDTH).alias("slot"), "digest", *more)
    return nodes.groupBy("grp", F.floor(F.col("pos") / WIDTH).cast("long").alias("run"), "left").agg(F.array_sort(F.collect_list(slot)).alias("slots"))


class Tree:
    """Runs of every level, lowest first, and the roots of all groups with their level."""

    def __init__(self, nodes: DataFrame, *more: str):
        """nodes: grp, pos, left (nodes of the group), digest; the columns ``more`` stay in the lowest runs."""
        self.levels = [cut_lineage(_runs(nodes, *more))]
        self.roots = [self.levels[0].filter("left = 1").select("grp", F.col("slots")[0]["digest"].alias("root"))]
        while True:
            above = self.levels[-1].filter("left > 1").select("grp", F.col("run").alias("pos"), F.ceil(F.col("left") / WIDTH).alias("left"), _hash(F.col("slots")["digest"]).alias("digest"))
            if self.levels[-1].filter("left > 1").isEmpty():
                break
            self.roots.append(above.filter("left = 1").select("grp", F.col("digest").alias("root")))
            self.levels.append(cut_lineage(_runs(above.filter("left > 1"))))

    def all_roots(self) -> DataFrame:
        out = self.roots[0]
        for r in self.roots[1:]:
            out = out.unionByName(r)
        return out

    def paths(self, top: DataFrame | None, *more: str) -> DataFrame:
        """grp, pos, digest, ``more``, root, steps: for every lowest node what stands before and after it, level by level.

        ``top`` (grp, root, steps): what is above the roots.
        """
        none = F.array().cast("array<struct<head:string,tail:string>>")

        def with_top(roots: DataFrame) -> DataFrame:
            return roots.withColumn("steps", none) if top is None else roots.join(top.select("grp", "steps"), "grp")

        above = None
        for k in range(len(self.levels) - 1, -1, -1):
            roots = with_top(self.roots[k])
            runs = self.levels[k].filter("left > 1")
            keep = more if k == 0 else ()
            if above is not None:
                below = runs.join(above, (runs["grp"] == above["g_"]) & (runs["run"] == above["p_"]))
                s, at = F.col("slots")["digest"], F.col("n")
                head, tail = F.array_join(F.slice(s, F.lit(1), at), ""), F.array_join(F.slice(s, at + 2, F.lit(WIDTH)), "")
                step = F.struct(head.alias("head"), tail.alias("tail"))
                spread = below.select("grp", "run", "root", "steps", "slots", F.posexplode("slots").alias("n", "one"))
                nodes = spread.select("grp", (F.col("run") * WIDTH + F.col("n")).alias("pos"), F.col("one.digest").alias("digest"), *[F.col(f"one.{m}").alias(m) for m in keep], "root", F.concat(F.array(step), "steps").alias("steps"))
            if k == 0:
                lone = self.levels[0].filter("left = 1").join(roots, "grp").select("grp", F.lit(0).cast("long").alias("pos"), F.col("root").alias("digest"), *[F.col("slots")[0][m].alias(m) for m in more], "root", "steps")
                return lone if above is None else nodes.unionByName(lone)
            alone = roots.select("grp", F.lit(0).cast("long").alias("pos"), "root", "steps")
            both = alone if above is None else nodes.drop("digest").unionByName(alone)
            above = both.select(F.col("grp").alias("g_"), F.col("pos").alias("p_"), "root", "steps")


def _in_line(roots: DataFrame) -> DataFrame:
    """The roots of the sources as nodes of one group, placed by source."""
    ranged = roots.repartitionByRange("grp").sortWithinPartitions("grp")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut_lineage(ranged.select(F.col("grp").alias("of"), F.col("root").alias("digest"), F.spark_partition_id().alias("part"), inside.alias("i")))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    line = Window.orderBy("part")
    parts = parts.select("part", (F.sum("n").over(line) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("left"))
    return rows.join(F.broadcast(parts), "part").select(F.lit("").alias("grp"), (F.col("first") + F.col("i")).alias("pos"), "left", "digest", "of")


def manifest(docs: DataFrame, altered: Column | None = None) -> tuple[str | None, DataFrame]:
    """The root, and a row per row of ``docs``: doc_id, leaf, altered, subroot, steps (digests before and after, upwards)."""
    found = leaves(docs, altered)
    spread = found.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    last = F.least(F.col("copies") - 1, F.col("lot") * COPIES + COPIES - 1)
    spread = spread.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES, last)))
    nodes = spread.select(F.col("src").alias("grp"), (F.col("pos") + F.col("copy")).alias("pos"), "left", F.col("leaf").alias("digest"), "doc_id", "altered")
    sources = Tree(nodes, "doc_id", "altered")
    whole = Tree(_in_line(sources.all_roots()), "of")
    root = whole.all_roots().first()
    top = whole.paths(None, "of").select(F.col("of").alias("grp"), F.col("digest").alias("root"), "steps")
    rows = sources.paths(cut_lineage(top), "doc_id", "altered")
    return root and root["root"], rows.select("doc_id", F.col("digest").alias("leaf"), "altered", F.col("root").alias("subroot"), "steps")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(steps, start, lambda d, s: F.sha2(F.concat(s["head"], d, s["tail"]), 256))


def op13_merkle_manifest(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", _UPPER, _LOWER))
    root, rows = manifest(docs, tampered)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["head"], s["tail"])), ""), 256)
    folded = fold(F.coalesce("altered", "leaf"), F.col("steps"))
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(source_levels: int = 5, top_levels: int = 3) -> str:
    """SQL for at most 16**5 leaves per source and 16**3 sources."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf_of = lambda text: "sha256(" + " || ".join(map(said, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    out = [f"""WITH d AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN
  {leaf_of(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf_of('text')} END AS seen FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS many FROM d),
s0 AS (SELECT source AS g, pos, many AS many, leaf AS digest FROM r)"""]

    def levels(name, n):
        for k in range(n):
            w = "PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
            out.append(f"""{name}{k}x AS (SELECT *, coalesce(string_agg(digest, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS head,
  coalesce(string_agg(digest, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS tail FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (any_value(many) + 15) // 16 AS many,
  CASE WHEN any_value(many) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY g, pos // 16)""")

    levels("s", source_levels)
    out.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS many, digest, g AS source FROM s{source_levels})")
    out[-1] = out[-1].replace("digest, g AS source", "digest") + f",\nplaces AS (SELECT g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS top, digest AS subroot FROM s{source_levels})"
    levels("t", top_levels)
    out.append("f0 AS (SELECT r.*, p.top, p.subroot, seen AS folded, '' AS proof FROM r JOIN places p ON r.source IS NOT DISTINCT FROM p.source)")
    n = 0
    for name, count, at, group in (("s", source_levels, "pos", "source"), ("t", top_levels, "top", "0")):
        for k in range(count):
            out.append(f"""f{n + 1} AS (SELECT f.* EXCLUDE (folded, proof), CASE WHEN x.many = 1 THEN folded ELSE sha256(x.head || folded || x.tail) END AS folded, proof || x.head || x.tail AS proof
  FROM f{n} f JOIN {name}{k}x x ON x.g IS NOT DISTINCT FROM {"f." + group if group == "source" else group} AND x.pos = f.{at} // {16**k})""")
            n += 1
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, q.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = q.digest AS verified FROM f{n}, t{top_levels} q"


ORACLE = _oracle()

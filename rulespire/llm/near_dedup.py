"""Near duplicates by a chosen-path similarity join on word shingles.

Every document has the set of its distinct 5-word shingles and 64 minwise tokens of it. Documents
with equal sets are one class. Class representatives descend 8 independent trees:
a tree's first level branches on one minwise token, so two documents of similarity 0.85 part in all trees with
probability 0.15**8 < 3e-7. Then, per node:

* up to ``NODE`` documents are compared exhaustively on their tokens;
* a larger node is compared with about 64 of its own documents. Those close to the main part of these are
  joined. If at most ``NODE`` documents are left over, they are compared with all of the node, which is then done; else
  its documents branch again on two further tokens each, chosen by the node. What is still large after
  ``DEPTH`` levels is compared in pairs of blocks.

Candidates (36 of 64 tokens equal; at 0.8 fewer have a probability of about 5e-6) form clusters.
Inside clusters the whole sets decide: first every document against one block of the cluster, which joins the
copies of one text in linear time, then, in pairs of blocks, only documents not yet
known to be in one component. Every pair of documents of a cluster is thus compared or already joined by links.

The row of a hot node or cluster is dealt by a hash of (node, block), so no task holds a whole one.

Defined cases: null and empty texts have no shingles and link with nothing; texts under five words are one
shingle; rows with one doc_id are one document with several texts; rows without doc_id link with nothing, have
a null component and stay; an empty table gives an empty result; other columns are not read, ``near_dedup`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespire.llm.common import fresh, map_arrow
from rulespire.llm.graph import components
from rulespire.llm.grouped import Union, by_groups, rows_of, whole_groups
from rulespire.llm.shingles import mix64, shingle_sets
from rulespire.session import cut_lineage

TOKENS, TREES, NODE, PIVOTS, DEPTH = 64, 8, 512, 64, 8
CLOSE = 36
#: Documents of a cluster compared with all others at first, and in blocks that are compared in pairs; characters of a block.
BLOCK, PAIRED, CHARS = 96, 384, 8 << 20
#: Multipliers of the minwise hash functions: odd numbers from the finalizer above.
_TIMES = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(shingles: np.ndarray) -> bytes:
    """64 minwise tokens of a non-empty set, four bytes each."""
    least = np.full(TOKENS, (1 << 32) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096, None] * _TIMES) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype("<u4").tobytes()


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def _sets(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for at in range(0, b.num_rows, 256):
            sets = shingle_sets(texts.slice(at, 256).to_pylist())
            with np.errstate(over="ignore"):
                one = [_signed(mix64(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                two = [_signed(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                pa.array([minwise(s) if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "one", "two", "tokens"])


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash (one, two) of the set and its tokens; written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(map_arrow(rows, _sets, "doc_id long, n_shingles long, one long, two long, tokens binary"))


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal tokens of each row of a with each row of b."""
    out = np.empty((len(a), len(b)), np.int32)
    for at in range(0, len(a), 16):
        out[at : at + 16] = (a[at : at + 16, None, :] == b[None]).sum(axis=2)
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64())])


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    a, b, node = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(node, pa.int64())], schema=_EDGES)


def _stars(joined: Union, ids: np.ndarray) -> list[tuple]:
    """Edges from every document to the first of its set: short paths for the component search."""
    roots = ((i, joined.find(i)) for i in range(len(ids)))
    return [(ids[i], ids[r], None) for i, r in roots if i != r]


def _compare_nodes(batches):
    """Groups (node, block) of documents, in a large node (mode 1 and 2) also pivots. Gives edges that join the candidates
    found. In mode 1 the documents that are not close to the pivots' main part come back with their node; in mode 2
    these are the pivots."""
    for table, bounds in whole_groups(batches, ("node", "block")):
        ids, node = table.column("rep").to_numpy(), table.column("node").to_numpy()
        pivot, mode = table.column("pivot").to_numpy(), table.column("mode").to_numpy()
        tokens = rows_of(table.column("tokens"), "<u4", TOKENS)
        out = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            own, t, n = ids[s:e], tokens[s:e], e - s
            joined = Union(n)
            if mode[s] == 0:
                for i in range(1, n):
                    for j in np.flatnonzero((t[:i] == t[i]).sum(axis=1) >= CLOSE):
                        joined.join(i, int(j))
                out += _stars(joined, own)
                continue
            at = np.flatnonzero(pivot[s:e])
            near = _equal(t, t[at]) >= CLOSE
            if mode[s] == 2:
                for i, k in zip(*np.nonzero(near)):
                    joined.join(int(i), int(at[k]))
                out += _stars(joined, own)
                continue
            among = Union(len(at))
            for i, k in zip(*np.nonzero(near[at])):
                among.join(int(i), int(k))
            roots = np.array([among.find(k) for k in range(len(at))], int)
            order = np.argsort(own[at], kind="stable")  # the same main part in every block of the node
            first = {}
            for k in order:
                first.setdefault(int(roots[k]), (-int((roots == roots[k]).sum()), int(own[at[k]])))
            main = roots == min(first, key=first.get) if len(at) else roots
            settled = near[:, main].any(axis=1) if len(at) else np.zeros(n, bool)
            if settled.any():
                hub = own[at[main]].min()
                out += [(own[i], hub, None) for i in np.flatnonzero(settled) if own[i] != hub]
            out += [(own[i], None, node[s]) for i in np.flatnonzero(~settled)]
        yield _edges(out)


def candidate_edges(reps: DataFrame) -> DataFrame:
    """reps (rep, tokens) -> edges (a, b) whose components hold every pair the trees bring together."""
    token = lambda i: F.conv(F.hex(F.substring(F.col("tokens"), i * 4 + 1, 4)), 16, 10).cast("long")
    roots = F.array(*[F.xxhash64(F.lit(t), token(F.lit(t))) for t in range(TREES)])
    members = reps.select("rep", F.explode(roots).alias("node"))
    edges = None
    schema = "a long, b long, node long"

    def dealt(known, pivots, mode, blocks):
        """Members in their block, pivots in all blocks of their node."""
        mine = F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int")
        copies = F.when(pivots, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
        return known.select("node", F.explode(copies).alias("block"), "rep", "tokens", mode.alias("mode"), pivots.alias("pivot"))

    for level in range(DEPTH + 1):
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        known = cut_lineage(members.join(sizes, "node").join(reps, "rep"))
        large = F.col("n") > NODE
        blocks = F.ceil(F.col("n") / NODE).cast("int")
        if level < DEPTH:
            chosen = large & (F.pmod(F.xxhash64("rep", "node"), F.col("n")) < PIVOTS)
            rows = dealt(known, chosen, large.cast("int"), blocks)
        else:  # the exact way for what doesn't divide: every pair of blocks, as a node of its own
            mine = F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int")
            pair = known.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            rows = pair.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), F.lit(0).alias("block"), "rep", "tokens", F.lit(0).alias("mode"), F.lit(False).alias("pivot"))
        found = cut_lineage(map_arrow(by_groups(rows, "node", "block"), _compare_nodes, schema))
        here = found.filter("b is not null").select("a", "b")
        edges = here if edges is None else edges.union(here)
        loose = found.filter("node is not null").select("node", F.col("a").alias("rep")).distinct()
        if level == DEPTH or loose.isEmpty():
            break
        loose = cut_lineage(loose)
        per_node = cut_lineage(loose.groupBy("node").agg(F.count(F.lit(1)).alias("n_loose")))
        # few loose ones: compare them with all of the node, which leaves nothing open in it
        few = per_node.filter(F.col("n_loose") <= NODE)
        last = known.join(few, "node").join(loose.withColumn("is_loose", F.lit(True)), ["node", "rep"], "left")
        last = dealt(last, F.coalesce("is_loose", F.lit(False)), F.lit(2), blocks)
        edges = edges.union(cut_lineage(map_arrow(by_groups(last, "node", "block"), _compare_nodes, schema)).select("a", "b"))
        many = per_node.filter(F.col("n_loose") > NODE)
        if many.isEmpty():
            break
        step = lambda k: F.pmod(F.xxhash64("node", F.lit(k), F.lit(level)), F.lit(TOKENS)).cast("int")
        branch = F.array(*[F.xxhash64("node", F.lit(k), token(step(k))) for k in range(2)])
        members = known.join(many, "node", "left_semi").select("rep", F.explode(branch).alias("node"))
    return edges


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _link_blocks(percent: int):
    def link(batches):
        """Groups (cluster, pair): documents of side 0 against those of side 1, or among themselves (side 2)."""
        for table, bounds in whole_groups(batches, ("cluster", "pair")):
            ids, side, part = (table.column(c).to_numpy() for c in ("rep", "side", "part"))
            texts = table.column("text")
            out = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                sets = shingle_sets(texts.slice(s, e - s).to_pylist())
                joined = Union(e - s)
                known: dict[int, int] = {}
                for i, p in enumerate(part[s:e]):  # documents already in one component
                    joined.join(i, known.setdefault(int(p), i))
                t, sides = np.frombuffer(b"".join(map(minwise, sets)), "<u4").reshape(-1, TOKENS), side[s:e]
                for i in range(e - s):
                    near = (t[:i] == t[i]).sum(axis=1) >= CLOSE
                    near &= (sides[:i] != sides[i]) | (sides[i] == 2)
                    for j in np.flatnonzero(near):
                        if joined.find(i) != joined.find(int(j)) and _linked(sets[i], sets[j], percent):
                            joined.join(i, int(j))
                out += _stars(joined, ids[s:e])
            yield _edges(out)
    return link


def _blocks(documents: int):
    """Blocks for n documents of m characters in all."""
    return F.greatest(F.ceil(F.col("n") / documents), F.ceil(F.col("m") / CHARS)).cast("int")


def verified_links(docs: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), decided on whole sets, that connect what is linked inside the clusters (rep, cluster)."""
    schema = "a long, b long, node long"
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(clusters, "rep")
    rows = cut_lineage(texts.select("rep", "cluster", "text", F.length("text").alias("chars")))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("m"))
    rows = rows.join(sizes, "cluster").withColumn("blocks", _blocks(BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("cluster")), F.col("blocks")).cast("int")).drop("n", "m")

    copies = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = rows.select("cluster", F.explode(copies.cast("array<long>")).alias("pair"), "rep", "text", "block")
    first = first.withColumn("side", F.when(F.col("pair") == 0, 2).when(F.col("block") == 0, 0).otherwise(1)).withColumn("part", F.col("rep"))
    links = cut_lineage(map_arrow(by_groups(first.drop("block"), "cluster", "pair"), _link_blocks(percent), schema)).select("a", "b")
    rest = rows.filter("blocks > 1 and block > 0")
    if rest.isEmpty():
        return links
    # documents of one component side by side; only blocks that hold two components are compared
    part = components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    rest = rest.drop("blocks", "block").join(part, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    sizes = cut_lineage(rest.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("m")))
    own = F.col("n") >= BLOCK
    small = sizes.filter(~own).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select("cluster", _blocks(PAIRED).alias("shared"))
    sizes = sizes.select("cluster", "part", own.alias("own"), _blocks(PAIRED).alias("blocks")).join(small, "cluster", "left")
    own = F.col("own")
    held = rest.join(sizes, ["cluster", "part"])
    key = F.when(own, F.xxhash64("part", F.pmod(F.xxhash64("rep", F.lit("own")), F.col("blocks")))).otherwise(
        F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("part", F.lit("small")), F.col("shared"))))
    held = held.select("cluster", "rep", "text", "part", key.alias("block"), F.when(own, F.col("part")).alias("pure"))
    blocks = cut_lineage(held.select("cluster", "block", "pure").distinct())
    p, q = blocks.alias("p"), blocks.alias("q")
    pairs = p.join(q, (F.col("p.cluster") == F.col("q.cluster")) & (F.col("p.block") <= F.col("q.block"))).filter("p.pure is null or q.pure is null or p.pure <> q.pure")
    pairs = pairs.select(F.col("p.cluster").alias("cluster"), F.col("p.block").alias("low"), F.col("q.block").alias("high"), F.xxhash64("p.block", "q.block").alias("pair"))
    sides = pairs.select("cluster", "pair", F.inline(F.when(F.col("low") == F.col("high"), F.array(F.struct(F.col("low").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("low").alias("block"), F.lit(0).alias("side")), F.struct(F.col("high").alias("block"), F.lit(1).alias("side"))))))
    second = held.join(sides, ["cluster", "block"]).select("cluster", "pair", "rep", "text", "side", "part")
    more = cut_lineage(map_arrow(by_groups(second, "cluster", "pair"), _link_blocks(percent), schema)).select("a", "b")
    return links.union(more)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sets = document_sets(docs)
    full = sets.filter("doc_id is not null and n_shingles > 0")
    classes = cut_lineage(full.groupBy("one", "two").agg(F.min("doc_id").alias("rep")))
    keys = ["one", "two"]
    reps = full.withColumnRenamed("doc_id", "rep").join(classes, ["rep", *keys], "left_semi").dropDuplicates(["rep", *keys]).select("rep", "tokens")
    reps = cut_lineage(reps)
    clusters = components(candidate_edges(reps)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    links = verified_links(docs, cut_lineage(clusters), percent)
    members = full.select("doc_id", *keys).join(classes, keys).select("doc_id", "rep")
    # one doc_id in several classes joins them
    least = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a <> most").select("doc_id", "a")
    same = members.join(least, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    parts = components(links.union(same)).select(F.col("node").alias("rep"), "component")
    found = classes.join(parts, "rep", "left").select(*keys, F.coalesce("component", "rep").alias("found"))
    out = sets.drop("tokens").join(found, keys, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all columns."""
    (gone,) = fresh(docs, "near_gone")
    dropped = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def op8_chosen_path(spark, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))

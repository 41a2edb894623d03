"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations and multiprobe.

A hash is the nearest signed axis after three rounds of random signs and a Walsh-Hadamard
transform; a bucket is ``width`` hashes together, so that there are at least eight buckets per vector.
A vector stands in its own bucket and in the ``PROBES`` next likely ones of each table; two
vectors are candidates where one of them is at home. The number of tables follows from a
simulation of pairs at exactly the threshold, so that they miss each other with probability ``miss``; closer pairs miss less.

Candidates are verified by cosine in double precision, block by block as matrix products. A pair that meets in
several buckets counts in the first of them only, which both vectors' codes tell without a
shuffle. Blocks return numbers of links per vector and a spanning forest, never all pairs. Equal vectors are one
class with a multiplicity; hot buckets are cut into blocks dealt by hash, so no task holds a whole bucket.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths don't link; rows with one id are one vector with several values; rows without id link with nothing and stay;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespire.llm.common import map_arrow
from rulespire.llm.graph import components
from rulespire.llm.grouped import Union, by_groups, whole_groups
from rulespire.session import cut_lineage

PROBES = 7
#: Next best axes considered per hash, and vectors of a bucket compared in one step.
AXES, BLOCK = 4, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


@lru_cache(maxsize=64)
def _signs(d: int, table: int, width: int) -> np.ndarray:
    return np.random.default_rng([d, table]).choice([-1.0, 1.0], (width, 3, d))


def bucket_codes(x: np.ndarray, table: int, width: int, probes: int = PROBES) -> np.ndarray:
    """The home bucket of each row and the next likely ones (-1 where there are fewer)."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    axes, loss = [], []
    for signs in _signs(d, table, width):
        y = padded
        for s in signs:
            y = hadamard(y * s)
        best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(AXES, d)]
        value = np.take_along_axis(y, best, 1)
        axes.append(2 * best + (value < 0))
        loss.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
    choices = np.array(list(product(range(axes[0].shape[1]), repeat=width)))
    cost = sum(loss[k][:, choices[:, k]] for k in range(width))
    taken = choices[np.argsort(cost, axis=1, kind="stable")[:, : probes + 1]]
    code = np.zeros(taken.shape[:2], np.int64)
    for k in range(width):
        code = code * (2 * d) + np.take_along_axis(axes[k], taken[:, :, k], 1)
    return np.hstack([code, np.full((n, probes + 1 - code.shape[1]), -1)])


@lru_cache(maxsize=64)
def tables_needed(dim: int, width: int, cosine: float, miss: float, pairs: int = 2000) -> int:
    """Tables for which pairs at the threshold miss each other with probability ``miss``, by simulation."""
    draw = np.random.default_rng(7)
    x, z = draw.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    met = 0.0
    for table in range(3):
        a, b = bucket_codes(x, table, width), bucket_codes(y, table, width)
        met += ((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).mean() / 3
    return max(2, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - min(met, 0.999)))))


def _hashed(plan: dict[int, tuple[int, int]]):
    def run(batches):
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            reps = batch.column("rep").to_numpy()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1)[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                width, tables = plan[int(dim)]
                codes = np.stack([bucket_codes(x, t, width) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(reps[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(codes.reshape(len(at), -1)), pa.list_(pa.int64())),
                ], ["rep", "dim", "unit", "codes", "buckets"])
    return run


def _compare(cosine: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for table, bounds in whole_groups(batches, ("place", "pair")):
            ids, home, side, copies, tab = (table.column(c).to_numpy() for c in ("rep", "home", "side", "copies", "tab"))
            code = table.column("code").to_numpy()
            units, all_codes = table.column("unit").to_pylist(), table.column("codes").to_pylist()
            out = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                m = e - s
                at_home = np.flatnonzero(home[s:e])
                if m < 2 or not len(at_home):
                    continue
                x = np.frombuffer(b"".join(units[s:e]), np.float64).reshape(m, -1)
                i, j = np.nonzero(x[at_home] @ x.T >= cosine)
                i = at_home[i]
                own, sd = ids[s:e], side[s:e]
                ok = (own[i] != own[j]) & ((sd[i] != sd[j]) | (sd[i] == 2)) & ~(home[s:e][j] & (j < i))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ok = np.zeros(len(i), bool)
                codes = np.frombuffer(b"".join(all_codes[s:e]), np.int64).reshape(m, -1, PROBES + 1)
                for k in range(0, len(i), 4096):  # counted in the first bucket where they meet
                    a, b = codes[i[k : k + 4096]], codes[j[k : k + 4096]]
                    meets = np.concatenate([a[:, :, :1] == b, b[:, :, :1] == a], axis=2)
                    first = meets.any(axis=2).argmax(axis=1)
                    where = np.arange(len(a)), first
                    shared = np.concatenate([np.where(a[where][:, :1] == b[where], b[where], np.iinfo(np.int64).max), np.where(b[where][:, :1] == a[where], a[where], np.iinfo(np.int64).max)], axis=1)
                    ok[k : k + 4096] = (first == tab[s]) & (shared.min(axis=1) == code[s])
                i, j = i[ok], j[ok]
                c = copies[s:e]
                n = np.bincount(i, c[j], m) + np.bincount(j, c[i], m)
                out += [(own[k], None, int(n[k])) for k in np.flatnonzero(n)]
                sets = Union(m)
                out += [(own[p], own[q], None) for p, q in zip(i, j) if sets.join(int(p), int(q))]
            a, b, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)
    return run


def similar_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-4) -> DataFrame:
    """One row per vector (vec_id, embedding): vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform("v", lambda x: x + 0.0)))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two"))
    keys = ["one", "two"]
    valid = rows.filter("v is not null and vec_id is not null")
    classes = cut_lineage(valid.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = valid.withColumnRenamed("vec_id", "rep").join(classes, ["rep", *keys], "left_semi").dropDuplicates(["rep", *keys])
    reps = reps.join(classes.select("rep", *keys, "copies"), ["rep", *keys]).select("rep", "v", "copies", F.size("v").alias("dim"))
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = {}
    for dim, n in sizes.items():
        axes = 2 << max(1, (dim - 1).bit_length())
        width = min(max(1, math.ceil(math.log(8 * n) / math.log(axes))), 62 // (axes.bit_length() - 1), 5)
        plan[dim] = (width, tables_needed(dim, width, cosine, miss))
    hashed = map_arrow(reps.select("rep", "dim", "v"), _hashed(plan), "rep long, dim int, unit binary, codes binary, buckets array<long>")
    hashed = cut_lineage(hashed.join(reps.select("rep", "copies"), "rep"))
    spots = hashed.select("rep", "dim", F.posexplode("buckets").alias("k", "code"))
    spots = spots.select("rep", "dim", (F.col("k") / (PROBES + 1)).cast("int").alias("tab"), (F.col("k") % (PROBES + 1) == 0).alias("home"), "code")
    spots = spots.withColumn("place", F.xxhash64("dim", "tab", "code")).filter("code >= 0")
    held = spots.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).filter("n > 1 and any_home")
    near = spots.join(held.select("place", "n"), "place").join(hashed.select("rep", "unit", "codes", "copies"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    near = near.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep", "place"), blocks).cast("int"))
    # every pair of blocks; a block with itself is side 2
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")).alias("pair")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side")
    groups = near.select("place", pair, "rep", "tab", "code", "home", side, "copies", "unit", "codes")
    found = cut_lineage(map_arrow(by_groups(groups, "place", "pair"), _compare(cosine), "a long, b long, n long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    per = classes.join(links, "rep", "left").join(parts, "rep", "left")
    per = per.select(*keys, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("found"))
    ids = rows.select("vec_id", *keys, F.col("v").isNotNull().alias("has"))
    out = ids.join(per, keys, "left")
    linked = F.col("has") & F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("found", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linked, F.col("n")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_cross_polytope(spark, sf: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))

"""Merkle manifest against a plain recomputation."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from rulespire.llm import manifest as mf
from tests.llm.helpers import documents, edge_rows, oracle_rows, plan_of


def h(*said):
    return hashlib.sha256("".join(said).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def reduce(nodes):
    """(root, for each node its proof, for each node a fold) of one tree."""
    proofs, folds, groups = [""] * len(nodes), [lambda d: d] * len(nodes), [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                head, tail = "".join(run[:k]), "".join(run[k + 1 :])
                for leaf in groups[at + k]:
                    proofs[leaf] += head + tail
                    folds[leaf] = lambda d, f=folds[leaf], a=head, z=tail: h(a, f(d), z)
            above.append(h(*run))
            owners.append([x for k in range(len(run)) for x in groups[at + k]])
        nodes, groups = above, owners
    return nodes[0], proofs, folds


def plain(rows):
    """Contract columns of (doc_id, text, lang, source, n_chars) rows, without Spark."""
    sources = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        fields = [field(doc_id), field(source), field(lang), field(n)]
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0
        leaf = h(*fields, field(text))
        sources[source].append((doc_id is not None, doc_id or 0, leaf, h(*fields, field(low)) if bad else leaf, doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: reduce([x[2] for x in sorted(sources[s])]) for s in order}
    root, proofs, folds = reduce([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        sub, own, fold = trees[s]
        for j, (*_, leaf, seen, doc_id) in enumerate(sorted(sources[s])):
            folded = folds[k](fold[j](seen))
            out.append((doc_id, leaf, sub, root, h(own[j], proofs[k]), folded, folded == root))
    return out


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def check(spark, df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    mine = mf.op13_merkle_manifest(spark, str(folder)).select(*names).collect()
    assert sorted(map(tuple, mine), key=str) == sorted(plain(as_rows(df)), key=str)


def test_edge_rows(spark, tmp_path):
    check(spark, documents(spark, edge_rows()), tmp_path)


def test_one_source_one_row_and_empty(spark, tmp_path):
    one = documents(spark, [(1, "A b", "en", "x")])
    check(spark, one, tmp_path / "one")
    assert mf.manifest(one)[0] == mf.leaves(one).first()["leaf"]
    one.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mf.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_shared_null_sparse_and_negative_ids(spark, tmp_path):
    draw = random.Random(3)
    rows = [(None, f"Text {k}", "en", "a") for k in range(60)] + [(7, f"Other {k % 40}", None, "a") for k in range(90)]
    rows += [(draw.choice([-1, 1]) * draw.randrange(1 << 62), f"T {k}", "en", draw.choice(["a", "é", "Z", None])) for k in range(300)]
    rows += [(k, "Same", "en", "a") for k in range(700)] + [(5, "Same", "en", "a")] * 5000
    check(spark, documents(spark, rows).repartition(5), tmp_path)


def test_wide_chunk_is_kept_as_bits():
    draw = np.random.default_rng(1)
    for n in (1, 4096, 4097, 60_000):
        low = np.sort(draw.choice(1 << 16, n, replace=False))
        weight = np.where(draw.random(n) < 0.01, 3, 1)
        bits, over = mf.Bitmap(low, weight).pack()
        assert len(bits) == (2 * n if n <= 4096 else 8194)
        assert (mf.Bitmap.offsets(bits) == low).all()
        asked = draw.integers(0, 1 << 16, 500)
        before = np.concatenate([[0], np.cumsum(weight)])[np.searchsorted(low, asked)]
        assert (mf.Ranks(bits, over).below(asked) == before).all()


def test_ranks_over_many_chunks(spark):
    ids = spark.range(-70_000, 130_000).filter("id % 3 <> 0").select(F.col("id").alias("k"), F.expr("CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END").alias("n"))
    found = mf.bitmap_ranks(ids, F.lit("g"), F.col("k"), F.col("n")).orderBy("k").toPandas()
    assert (found["before"] == found["n"].cumsum() - found["n"]).all() and (found["tot"] == found["n"].sum()).all()


def test_no_sort_of_leaves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "Window" not in plan_of(mf._runs(mf.leaves(docs).select(F.col("src").alias("grp"), "pos", "left", F.col("leaf").alias("digest"))))


def test_query_equals_sql(spark, sf):
    df = mf.op13_merkle_manifest(spark, sf)
    assert sorted(tuple(r[c] for c in df.columns) for r in df.collect()) == oracle_rows(mf.ORACLE, sf, df.columns)


def test_clashing_columns(spark):
    df = documents(spark, edge_rows())
    more = df.withColumn("grp", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("steps", F.lit(2)).withColumn("Leaf", F.lit(3))
    assert mf.manifest(more)[0] == mf.manifest(df)[0]

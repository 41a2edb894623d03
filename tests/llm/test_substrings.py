"""Substring dedup against a plain search of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from rulespire.llm import substrings as sb
from tests.llm.helpers import documents, edge_rows, oracle_rows


def plain(rows, window):
    """(doc_id, n_words, n_removed, hash) of (doc_id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc_id, _), w in zip(rows, words):
        for k in range(len(w) - window + 1) if doc_id is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if doc_id is not None else ():
            if first[tuple(w[k : k + window])] < doc_id:
                gone[k : k + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, window):
    got = sb.substring_dedup(df, window).collect()
    for r in got:
        assert sum(s["n"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str)


@pytest.mark.parametrize("window", [50, 7, 6, 1])
def test_equals_plain_search(spark, window):
    draw = random.Random(window)
    said = [f"w{draw.randrange(400)}" for _ in range(3000)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            a, n = draw.randrange(2900), draw.choice([3, 10, 49, 50, 51, 60, 120, 400])
            parts += said[a : a + n] if draw.random() < 0.6 else [f"x{draw.randrange(50)}" for _ in range(n)]
        rows.append((draw.randrange(200) if draw.random() < 0.95 else None, draw.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(500 + k, "again " * 200) for k in range(3)] + [(3, rows[0][1])] * 40 + [(1, None), (2, ""), (2, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(df, window) == plain(rows, window)


def test_edge_rows(spark):
    rows = edge_rows()
    assert found(documents(spark, rows), 50) == plain([(r[0], r[1]) for r in rows], 50)
    assert sb.substring_dedup(documents(spark, rows).limit(0)).count() == 0


def test_every_copy_of_a_run_counts_the_same_half_window():
    draw = np.random.default_rng(2)
    order = draw.integers(0, 1 << 62, 500).astype(np.uint64)
    at = set(sb.chosen(order, 26).tolist())
    for a in range(500 - 26):
        assert a + int(order[a : a + 26].argmin()) in at
    assert len(at) < 80


def test_columns_of_other_names(spark):
    from pyspark.sql import functions as F

    df = documents(spark, [(1, "a " * 60, "en", "x"), (2, "a " * 60, "en", "x")])
    more = df.withColumns({c: F.lit(1) for c in ("salt", "kind", "h", "answer", "first")})
    assert found(more, 50) == plain([(1, "a " * 60), (2, "a " * 60)], 50)


def test_query_equals_sql(spark, sf):
    df = sb.op11_substring_dedup(spark, sf)
    assert sorted(tuple(r[c] for c in df.columns) for r in df.collect()) == oracle_rows(sb.ORACLE, sf, df.columns)

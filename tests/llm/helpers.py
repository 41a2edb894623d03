"""Small tables and oracles for the operators' tests."""

from __future__ import annotations

import duckdb
import pyarrow.parquet as pq

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOCS):
    """Documents from (doc_id, text, lang, source) rows."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], schema)


def edge_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two three", "en", "b"), (5, "one two three", "en", "b"),
        (5, "one two three", "en", "b"), (None, "one two three four five six", None, "c"), (7, long, "en", "a"), (8, long, "en", "a"), (9, "x" * 200_000, "de", None), (7, "other text of the same id here", "en", "c"),
    ]


def read(folder, table):
    return pq.read_table(f"{folder}/{table}.parquet").to_pylist()


def oracle_rows(sql, folder, columns):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    return sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def word_sets(text):
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plan_of(df):
    return df._jdf.queryExecution().toString()

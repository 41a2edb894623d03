"""Run registered queries against their SQL in DuckDB and compare all values.

Usage: python tools/check_oracle.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from rulespire.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def kind(v):
    return type(v).__name__ if v is not None else "none"


def compare(spark_df, rel) -> str:
    cols = sorted(spark_df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    mine = [tuple(r[c] for c in cols) for r in spark_df.collect()]
    theirs = [tuple(r[i] for i in order) for r in rel.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}; mine {mine[:2]} theirs {theirs[:2]}"
    a = sorted(tuple(map(norm, r)) for r in mine)
    b = sorted(tuple(map(norm, r)) for r in theirs)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {bad[0]} cols {cols}"
    for i, c in enumerate(cols):
        ka, kb = {kind(r[i]) for r in mine} - {"none"}, {kind(r[i]) for r in theirs} - {"none"}
        if ka != kb:
            return f"type of {c}: {ka} vs {kb}"
    return f"ok {len(mine)} rows"


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    from rulespire.catalog import ORACLES, QUERIES

    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = 0
    for name, fn in QUERIES.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                verdict = compare(df, con.sql(ORACLES[name]))
            else:
                verdict = f"ok rows-only {df.count()}"
        except Exception as problem:  # report and go on
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:700]}"
        if not verdict.startswith("ok"):
            failed += 1
        print(f"{name:40s} {time.time() - start:6.1f}s {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

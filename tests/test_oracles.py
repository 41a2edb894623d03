"""Every registered query against its SQL at the smallest size.

Fits without SQL are covered by the other test files. RULESPIRE_ALL=1 runs all queries,
otherwise every third one but the slowest.
"""

import os

import duckdb
import pytest

from rulespire.catalog import ORACLES, QUERIES
from tools.check_oracle import TABLES, compare

SLOW = {"pip3_family_front_end", "tre1_planted_root", "sea27_stump", "bin4_supervised_edges"}
PICKED = [n for i, n in enumerate(sorted(ORACLES)) if os.environ.get("RULESPIRE_ALL") or (i % 3 == 0 and n not in SLOW)]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, sf, con, name):
    verdict = compare(QUERIES[name](spark, sf), con.sql(ORACLES[name]))
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("op")]

"""Conversation structure repair against an enumeration of all edits."""

import hashlib
import random
from functools import lru_cache

import pytest

from rulespire.llm import structure as st
from rulespire.llm.structure import BLANK, CUT, DUPLICATE, FINE, align, audits, repaired_rows


def plain(roles, faults):
    """Cheapest edits into the grammar by trying all of them; (cost, audit)."""

    @lru_cache(None)
    def rest(i, state):  # state: 0 nothing yet, 1 after s, 2 after u, 3 after a
        found = []
        if i == len(roles) and state in (0, 3):
            found.append((0, ""))
        follow = 3 if state == 2 else 2
        want = "a" if state == 2 else "u"
        if i < len(roles):
            extra = 3 if faults[i] == CUT else 0
            found.append(step(4, "D", rest(i + 1, state)))
            if faults[i] not in (BLANK, DUPLICATE):
                if roles[i] == "s" and state == 0:
                    found.append(step(extra, "K", rest(i + 1, 1)))
                if roles[i] == want:
                    found.append(step(extra, "K", rest(i + 1, follow)))
                else:
                    found.append(step(3 + extra, "R", rest(i + 1, follow)))
        if state in (1, 2) or i < len(roles):
            # an insert from here leads to the opposite state; two in a row end a pair
            found.append(step(3, "I", inserted(i, follow, 1)))
        return min(found)

    @lru_cache(None)
    def inserted(i, state, n):
        found = []
        if i == len(roles) and state == 3:
            found.append((0, ""))
        follow, want = (3, "a") if state == 2 else (2, "u")
        if i < len(roles):
            extra = 3 if faults[i] == CUT else 0
            found.append(step(4, "D", rest(i + 1, state)))
            if faults[i] not in (BLANK, DUPLICATE):
                found.append(step(extra, "K", rest(i + 1, follow)) if roles[i] == want else step(3 + extra, "R", rest(i + 1, follow)))
        if n < 4:
            found.append(step(3, "I", inserted(i, follow, n + 1)))
        return min(found, default=(1 << 30, ""))

    def step(cost, edit, after):
        return cost + after[0], edit + after[1]

    return rest(0, 0)


def test_alignment_equals_enumeration():
    draw = random.Random(5)
    cases = [("", b""), ("s", bytes([FINE])), ("a", bytes([FINE])), ("uuuu", bytes([BLANK] * 4)), ("sssuaua", bytes(7))]
    for _ in range(1500):
        n = draw.randrange(9)
        cases.append(("".join(draw.choice("suuaa-") for _ in range(n)), bytes(draw.choice([FINE, FINE, BLANK, DUPLICATE, CUT]) for _ in range(n))))
    for roles, faults in cases:
        want = plain(roles, faults)
        assert align(roles, faults) == want, (roles, list(faults))
        assert align(roles, faults, long=-1) == want, (roles, list(faults))


@pytest.mark.parametrize("n", [300, 1500])
def test_long_conversations_by_band_and_folded(n):
    draw = random.Random(n)
    roles = "".join(draw.choice("ua" if k % 11 else "suua") for k in range(n))
    faults = bytes(draw.choice([FINE] * 8 + [BLANK, DUPLICATE, CUT]) for _ in range(n))
    assert align(roles, faults, long=1 << 20) == align(roles, faults, long=-1)


def test_cases(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"),  # fine
        (2, 0, "user", "One."), (2, 1, "user", "One."), (2, 3, "assistant", "cut off"),  # a duplicate, a gap, a cut text
        (3, None, None, None), (3, 5, "assistant", "Yes?  \n"),  # nulls
        (None, 0, "user", "Lost."), (None, 1, "assistant", "Found."),
        (4, 0, "user", " \t"), (5, 0, "user", "x" * 300_000 + "."), (5, 1, "assistant", "End."),
    ] + [(6, 7, "assistant", "Same.")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in audits(df).collect()}
    assert [(found[k]["cost"], found[k]["audit"]) for k in (1, None, 5)] == [(0, "KKK"), (0, "KK"), (0, "KK")]
    two = found[2]
    assert (two["gaps"], two["duplicate"], two["truncated"], two["illegal"], two["cost"], two["audit"]) == (1, 1, 1, 1, 7, "KDK")
    assert (found[3]["blank"], found[3]["audit"], found[3]["gaps"], found[3]["illegal"]) == (1, "DIK", 0, 1)
    assert (found[4]["blank"], found[4]["audit"]) == (1, "D")
    assert (found[6]["duplicate"], found[6]["gaps"], found[6]["illegal"]) == (499, 0, 499)
    fixed = sorted((r["conv_id"] or -1, r["place"], r["edit"], r["role"], r["text"][:9]) for r in repaired_rows(df, audits(df)).collect())
    assert [f for f in fixed if f[0] in (2, 3, 6)] == [
        (2, 0, "K", "user", "One."), (2, 1, "K", "assistant", "cut off"), (3, 0, "I", "user", ""), (3, 1, "K", "assistant", "Yes?  \n"),
        (6, 0, "I", "user", ""), (6, 1, "K", "assistant", "Same.")]
    assert audits(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    import duckdb

    from tests.llm.helpers import oracle_rows

    df = st.op12_structure_repair(spark, sf)
    mine = sorted(tuple(r[c] for c in df.columns) for r in df.collect())
    assert mine == oracle_rows(st.ORACLE, sf, df.columns)
    assert len(mine) == duckdb.sql(f"SELECT count(DISTINCT conv_id) FROM '{sf}/conversations.parquet'").fetchall()[0][0]


def test_digest_of_no_rows(spark, tmp_path):
    from zlib import crc32

    lost = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = st.op12_structure_repair(spark, str(tmp_path)).collect()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())

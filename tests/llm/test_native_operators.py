"""Mixing, sharding, chat formatting and decontamination: DataFrame functions only."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rulespire.llm import chat, decontamination, mixing, sharding
from rulespire.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import documents, edge_rows, oracle_rows, plan_of, read


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == oracle_rows(ORACLES[name], sf, cols)


def test_no_python_in_plans(spark, sf):
    for name in ("op1_decontamination", "op2_weighted_mix", "op7_chat_format", "op9_ring_shards"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert not any(x in plan for x in ("Python", "InPandas", "InArrow", "Cartesian")), name


# --- mixing -------------------------------------------------------------------------------


def test_targets_fill_up_by_weight(spark):
    docs = documents(spark, [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 100), ("b", 10), ("c", 10), (None, 80)])])
    t = {r["source"]: r["target"] for r in mixing.targets(mixing.sized_documents(docs)).collect()}
    # weights 3 1 2 3: b and c stop at 20, the other 260 of 300 words are shared 3 to 3
    assert t == pytest.approx({"a": 130.0, "b": 20.0, "c": 20.0, None: 130.0})


def test_mix_edges(spark):
    docs = documents(spark, edge_rows()).withColumn("weight", F.lit("x")).withColumn("mix_last", F.lit(1))
    rows = mixing.fair_queue(mixing.sized_documents(docs)).collect()
    assert all(r["size"] >= 0 and r["position"] >= 0 for r in rows)
    total = sum({r["source"]: r["source_size"] for r in rows}.values())
    assert 0 < sum(r["size"] for r in rows if r["taken"]) <= 1.5 * total
    out = mixing.mix_documents(docs, share=1.0, passes=1)
    assert out.columns == docs.columns and out.count() >= 10
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_is_the_same_in_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second = (sorted(map(tuple, mixing.mix_documents(d, 0.9 and (3, 1, 2), 0.9, 1).select("doc_id").collect())) for d in (docs, docs.repartition(7, "source")))
    assert first == second


def test_positions_are_global(spark, sf):
    q = mixing.fair_queue(mixing.sized_documents(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    at = 0
    for r in sorted(q, key=lambda r: (r["finish"], r["source"] is None, r["source"], r["u"], r["row_id"])):
        assert r["position"] == at
        at += r["size"]


# --- sharding -----------------------------------------------------------------------------


def test_shards(spark, sf):
    rows = QUERIES["op9_ring_shards"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in read(sf, "documents")}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_edges(spark):
    docs = documents(spark, edge_rows()).withColumn("shard_", F.lit(1)).withColumn("ring_key", F.lit(2))
    out = sharding.shard_rows(docs, 4)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == len(edge_rows())
    assert {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 2}
    assert sharding.shard_rows(docs.limit(0), 4).count() == 0


def test_walk_moves_few_keys_when_a_shard_comes():
    def owners(shards, slack):
        nodes = sharding.places(shards, 64)
        ends, loads = [t for t, _ in nodes], [0] * len(nodes)
        keys = [int.from_bytes(hashlib.md5(str(k).encode()).digest()[:2], "big") for k in range(20_000)]
        from bisect import bisect_left

        rank, out = [], {}
        for k in sorted(range(len(keys)), key=lambda k: (keys[k] <= ends[-1], keys[k], k)):
            arc = bisect_left(ends, keys[k]) % len(nodes)
            rank.append((k, arc, loads[arc]))
            loads[arc] += 1
        runs = sharding.walk(nodes, loads, sharding.quotas(len(keys), shards, slack))
        for k, arc, r in rank:
            (out[k],) = [s for a, lo, hi, s, _ in runs if a == arc and lo <= r < hi]
        return out

    for slack, most in ((0.0, 0.35), (0.25, 0.12)):
        a, b = owners(20, slack), owners(21, slack)
        assert sum(a[k] != b[k] for k in a) <= most * len(a)


# --- chat ---------------------------------------------------------------------------------


def test_parts_are_visited_in_order(spark):
    part = "struct<kind:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see <|image|> & [INST]", None, None), ("image", None, "s3://x/1.png", None), ("audio", None, "a.wav", 40), None]),
            (1, 1, "assistant", [("text", "well", None, None), ("document", None, "d.pdf", None), ("text", " done", None, None)]), (1, 2, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = {r["turn"]: r for r in chat.format_turns(df).collect()}
    assert out[0]["segment"] == "<|user|>\nsee &lt;|image|> &amp; &lsqb;INST]<|image 0.1|><|audio 0.2|><|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in out[0]["attachments"]] == [("image", "s3://x/1.png", 256), ("audio", "a.wav", 40)]
    assert out[0]["tokens"] == 4 + 256 + 40 and out[0]["loss_spans"] == []
    seg = out[1]["segment"]
    assert [seg[s["start"] : s["start"] + s["length"]] for s in out[1]["loss_spans"]] == ["well", " done"]
    assert all(seg[a["place"] :].startswith(a["placeholder"]) for a in out[1]["attachments"])
    assert out[2]["segment"] == "<||>\n<|end|>\n"


def test_chat_round_trip(spark):
    texts = ["", "&amp;", "&", "<|end|>\n<|user|>\n", "&lt;&lsqb;[[<<", "a|b", "</s>[INST] ok [/INST]", None, "é \U0001f600" * 1000]
    df = spark.createDataFrame([(k, 0, "assi|st>\nant" if k % 2 else "assistant", t) for k, t in enumerate(texts)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = chat.read_turns(chat.format_turns(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()
    for r in rows:
        want = texts[r["conv_id"]] if r["conv_id"] is not None else ""
        assert r["text"] == (want or "")
        if r["role"] == "assistant":
            assert r["loss_text"] == (want or "")
    assert chat.digest_conversations(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


# --- decontamination ----------------------------------------------------------------------


def brute_contaminated(docs, items, threshold=0.8):
    """All windows at all places."""
    from collections import Counter

    def runs(text):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text.lower()) if x]
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])

    best = {}
    for d in docs:
        a = runs(d["text"] or "")
        own = set(a)
        for it in items:
            b = runs(it["text"] or "")
            if not own & set(b):
                continue
            cb = Counter(b)
            for s in range(max(1, len(a) - len(b) + 1)):
                ca = Counter(a[s : s + len(b)])
                both = sum((ca & cb).values())
                sim = both / (sum(ca.values()) + sum(cb.values()) - both)
                if sim >= threshold:
                    best[d["doc_id"], it["item_id"]] = max(sim, best.get((d["doc_id"], it["item_id"]), 0))
    return best


def test_contaminated_as_brute_force(spark, sf):
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    want = brute_contaminated(read(sf, "documents"), read(sf, "benchmark"))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_contaminated_edges(spark):
    words = [f"word{k}" for k in range(40)]
    item = " ".join(words)
    one_off = " ".join(["start"] * 30 + words[:20] + ["NEW"] + words[21:] + ["end"] * 30)
    rows = [*edge_rows(), (20, "x y z " + item.upper() + " tail", "en", "a"), (21, one_off, "en", "a"), (21, one_off, "en", "a"), (None, item, "en", None), (23, " ".join(words[:12]), "en", "a")]
    docs = documents(spark, rows).withColumn("item_id", F.lit(9)).withColumn("place", F.lit(1))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three"), (None, item)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert {k for k in found if k[1] is not None} == {(4, 4), (5, 4), (20, 1), (None, 1)} | ({(21, 1)} if (21, 1) in found else set())
    assert found[20, 1]["start"] == 3 and found[20, 1]["similarity"] == 1.0
    kept = [r["doc_id"] for r in decontamination.clean_documents(docs, items).select("doc_id").collect()]
    assert 23 in kept and 1 in kept and 4 not in kept and 20 not in kept
    assert decontamination.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


def test_hamming_blocks_find_all_within_radius(spark):
    import random

    draw = random.Random(3)
    base = draw.getrandbits(63)
    rows = []
    for n in range(0, decontamination.RADIUS + 1):
        x = base
        for b in draw.sample(range(63), n):
            x ^= 1 << b
        rows.append((n, x))
    df = spark.createDataFrame(rows, "n int, f long").select("n", F.inline(decontamination.blocks(F.col("f"))))
    one = spark.createDataFrame([(base,)], "f long").select(F.inline(decontamination.blocks(F.col("f"))))
    assert df.join(one, ["no", "bits"]).select("n").distinct().count() == len(rows)


def test_simhash_is_the_majority_of_bits(spark):
    hs = [5, -1, 1 << 40, 5, 12345678901]
    got = spark.createDataFrame([(hs,)], "h array<long>").select(decontamination.simhash(F.col("h")).alias("s")).first()["s"]
    want = sum((1 << b) for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))
    assert got == (want - (1 << 64) if want >> 63 else want)

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact check.

Texts become arrays of 5-word shingle hashes (in lower case; fewer words are one shingle). For every
benchmark item, windows of its own length are laid over the documents and fingerprinted with the same 64-bit
SimHash, each shingle counted as often as it occurs. Fingerprints are cut into ``RADIUS`` + 1 blocks: two that differ
in at most ``RADIUS`` bits agree in one block, so an equality join on the blocks finds every fingerprint within
the radius. The pairs are then decided by weighted Jaccard similarity of the shingle counts.

Windows are laid where they can matter: a window without a shingle of its item has similarity 0, so
each occurrence of an item's shingle places one window by its offset in the item, and no other is fingerprinted.
Shingles are looked up by a join; the item side is broadcast when it has few rows, which is counted, else it is shuffled.

Everything is DataFrame expressions. No group is collected: windows are grouped by document, place and item length,
and the join keys are hashes of short runs of bits combined with the item length.

Defined cases: null and empty texts or items match nothing; a document shorter than an item is one window; equal rows
give equal results once per distinct (doc_id, text); a null doc_id is reported as null; empty tables give an empty
result; other columns are kept by ``clean_documents`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.llm.common import SPACE, bound, document_hash, fresh, small
from rulespire.session import cut_lineage

K, RADIUS = 5, 20
#: Bits that end the blocks of a fingerprint: 21 blocks of three or four bits.
CUTS = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    def of(ws):
        n = F.size(ws)
        runs = F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(K)]))
        return F.when(n >= K, runs).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))
    return bound(words(F.coalesce(text, F.lit(""))), of)


def counted(hashes: Column) -> Column:
    """Sorted distinct hashes with their numbers of occurrences."""
    return bound(hashes, lambda hs: F.transform(F.array_sort(F.array_distinct(hs)), lambda h: F.struct(h.alias("h"), F.size(F.filter(hs, lambda x: x == h)).alias("c"))))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: bit i is set where more shingle occurrences have it set than not."""
    def of(hs):
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(hs, F.lit(0), lambda s, h: s + F.getbit(h, i).cast("int")))
        ones = F.transform(bits, lambda c, i: F.when(2 * c > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(ones, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return bound(hashes, of)


def blocks(fingerprint: Column) -> Column:
    """(number, bits) of the blocks."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(CUTS[:-1], CUTS[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of (h, c)."""
    both = bound(F.map_from_entries(b), lambda theirs: F.aggregate(a, F.lit(0), lambda s, x: s + F.least(x["c"], F.coalesce(F.element_at(theirs, x["h"]), F.lit(0)))))
    total = F.aggregate(a, F.lit(0), lambda s, x: s + x["c"]) + F.aggregate(b, F.lit(0), lambda s, x: s + x["c"])
    return bound(both, lambda n: n / (total - n))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, place (key of doc_id and text), item_id, start (word), n_words, distance, similarity: the best window of every document and item that reach the threshold."""
    bench = items.select("item_id", F.size(words(F.coalesce("text", F.lit("")))).alias("n_words"), shingles(F.col("text")).alias("hs")).filter("n_words > 0")
    bench = cut_lineage(bench.select("item_id", "n_words", "hs", F.size("hs").alias("n"), simhash(F.col("hs")).alias("fingerprint"), counted(F.col("hs")).alias("counts")))
    marks = bench.select(F.posexplode("hs").alias("at", "h"), "n").distinct()
    marks = small(marks.groupBy("h").agg(F.collect_set(F.struct("at", "n")).alias("offsets")))  # at most one entry per place in an item
    text = F.col("text")
    key = document_hash("leak", F.col("doc_id"), text)
    spread = docs.select(key.alias("place"), F.posexplode(shingles(text)).alias("pos", "h"))
    hits = spread.join(marks, "h").select("place", "pos", F.inline("offsets"))
    starts = hits.select("place", "n", (F.col("pos") - F.col("at")).alias("start")).distinct()
    starts = cut_lineage(starts)
    # the few documents with windows are read again, which is cheaper than carrying all shingles along
    found = docs.select(key.alias("place"), "doc_id", "text").join(small(starts.select("place").distinct()), "place").dropDuplicates(["place"])
    found = found.select("place", "doc_id", shingles(text).alias("hs"))
    placed = found.join(starts, "place").withColumn("start", F.greatest(F.lit(0), F.least(F.col("start"), F.size("hs") - F.col("n"))))
    window = placed.select("place", "doc_id", "n", "start", F.slice("hs", F.col("start") + 1, F.col("n")).alias("w")).dropDuplicates(["place", "n", "start"])
    window = cut_lineage(window.withColumn("print", simhash(F.col("w"))))
    left = window.select("place", "start", "n", "print", F.inline(blocks(F.col("print"))))
    right = bench.select("item_id", "n", "fingerprint", F.inline(blocks(F.col("fingerprint"))))
    near = left.join(right, ["n", "no", "bits"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))))
    near = near.filter(F.col("distance") <= RADIUS).select("place", "start", "n", "item_id", "distance").distinct()
    checked = near.join(window.select("place", "doc_id", "n", "start", "w"), ["place", "n", "start"]).join(bench.select("item_id", "n", "n_words", "counts"), ["item_id", "n"])
    checked = checked.withColumn("own", counted(F.col("w"))).withColumn("similarity", similarity(F.col("own"), F.col("counts"))).filter(F.col("similarity") >= threshold)
    best = checked.groupBy("place", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "doc_id", "n_words", "distance")).alias("b"), F.first("doc_id").alias("doc_id"))
    return best.select("doc_id", "place", "item_id", (-F.col("b")["col2"]).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without a contaminated window, with all columns."""
    (gone,) = fresh(docs, "leak_place")
    bad = small(contaminated(docs, items, threshold).select(F.col("place").alias(gone)).distinct())
    return docs.join(bad, document_hash("leak", docs["doc_id"], docs["text"]) == F.col(gone), "left_anti")


def op1_decontamination(spark, sf: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"))


def _shingles_sql(table: str, key: str) -> str:
    """key, ws (words) and hs (shingles as text) of every row."""
    return f"""(SELECT *, CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS hs
    FROM (SELECT {key}, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '{SPACE}') if x <> ''] AS ws FROM {table}))"""


# The same windows compared exactly, without fingerprints: equal unless a match is more than RADIUS bits apart.
ORACLE = f"""WITH d AS {_shingles_sql("documents", "doc_id")}, b AS {_shingles_sql("benchmark", "item_id")},
i AS (SELECT item_id, len(ws) AS n_words, len(hs) AS n, hs FROM b WHERE len(ws) > 0),
m AS (SELECT DISTINCT n, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS off FROM i),
p AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM d),
s AS (SELECT DISTINCT p.doc_id, m.n, greatest(0, least(pos - off, len(d.hs) - m.n)) AS start FROM p JOIN m ON p.h = m.h JOIN d ON d.doc_id = p.doc_id),
w AS (SELECT s.*, d.hs[start + 1:start + n] AS hs FROM s JOIN d USING (doc_id)),
wc AS (SELECT doc_id, n, start, h, count(*) AS c FROM (SELECT doc_id, n, start, unnest(hs) AS h FROM w) GROUP BY ALL),
ic AS (SELECT item_id, n, n_words, h, count(*) AS c FROM (SELECT item_id, n, n_words, unnest(hs) AS h FROM i) GROUP BY ALL),
o AS (SELECT doc_id, item_id, start, n, n_words, sum(least(wc.c, ic.c)) AS shared FROM wc JOIN ic USING (n, h) GROUP BY ALL),
r AS (SELECT o.doc_id, item_id, start, n_words, shared / (len(w.hs) + o.n - shared)::DOUBLE AS similarity FROM o JOIN w USING (doc_id, n, start))
SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

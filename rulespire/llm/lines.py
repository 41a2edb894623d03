"""Line deduplication by pairwise alignment.

Documents are ordered by doc_id (null last). A line that occurs in several documents pairs each of them with
the earliest one that has it, and so does each shortest run of lines with ``BLOCK_WORDS`` words that begins or ends at a line. Every
block that a document shares with any earlier one consists of such runs, so it is deleted whoever holds its single lines first. The
number of pairs is at most three times the number of lines, however often a line occurs, and
rare and frequent lines are treated alike: nothing is capped. Each pair is aligned by patience diff on line hashes:
lines that are unique on both sides, in longest increasing order, then the gaps between them in the same way, then equal
lines next to them. Lines that repeat give no anchor: equal runs that the alignment passes over are looked up by their
hashes. Runs of equal lines with at least ``BLOCK_WORDS`` words are deleted from the later document, and the
rest is aligned again, so moved blocks go as well, until the two share no such run. The earliest holder of a line never loses it.

Shuffles carry line hashes; texts move once, in the join with the deletions. A line with a third of all documents
is one row after the minimum per line, and the joins on its earliest holder can be split.

Lines are compared without surrounding spaces and tabs (and carriage returns); lines without words align only next to others.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; rows with equal doc_id and text are
one document and get equal results; of one doc_id with several texts, order is by the text's hash; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulespire.llm.common import WORD, document_hash, fresh, map_arrow
from rulespire.session import cut_lineage

BLOCK_WORDS = 5


def unique_matches(a: list[int], b: list[int], la: int, ha: int, lb: int, hb: int) -> list[tuple[int, int]]:
    """Places of lines that are unique in a[la:ha] and in b[lb:hb], in the longest order increasing in both."""
    at: dict[int, int] = {}
    for i in range(la, ha):
        at[a[i]] = -1 if a[i] in at else i
    there: dict[int, int] = {}
    for j in range(lb, hb):
        there[b[j]] = -1 if b[j] in there else j
    pairs = [(i, there[x]) for x, i in at.items() if i >= 0 and x != 0 and there.get(x, -1) >= 0]
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            tops.append(k)
        else:
            tails[p], tops[p] = j, k
        back[k] = tops[p - 1] if p else -1
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i in a, j in b), increasing in both; hash 0 (no words) is never an anchor."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        la, ha, lb, hb = todo.pop()
        while la < ha and lb < hb and a[la] == b[lb]:
            out.append((la, lb))
            la, lb = la + 1, lb + 1
        while la < ha and lb < hb and a[ha - 1] == b[hb - 1]:
            ha, hb = ha - 1, hb - 1
            out.append((ha, hb))
        if la == ha or lb == hb:
            continue
        found = unique_matches(a, b, la, ha, lb, hb)
        for i, j in found:  # the gaps before and after it, up to the next one
            out.append((i, j))
        edges = [(la - 1, lb - 1), *found, (ha, hb)]
        if found:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def runs(words: list[int]) -> list[tuple[int, int]]:
    """First and last place of the shortest runs of enough words that begin at each line with words, or end there. Every
    line of a longer run lies in one of those inside it."""
    out: list[tuple[int, int]] = []
    at = [k for k, n in enumerate(words) if n]
    p = total = 0
    for k in at:
        total += words[k]
        if total >= BLOCK_WORDS and not out:
            out.append((at[0], k))
        while total - words[at[p]] >= BLOCK_WORDS:
            total, p = total - words[at[p]], p + 1
            out.append((at[p], k))
        if total >= BLOCK_WORDS and out[-1:] != [(at[p], k)]:
            out.append((at[p], k))
    return out


def shared_runs(a: list[int], words: list[int], b: list[int]) -> set[int]:
    """Places in a of all runs with enough words that stand in b as well, however often their lines repeat."""
    count = dict(zip(a, words))
    there = {tuple(b[s : e + 1]) for s, e in runs([count.get(x, BLOCK_WORDS) for x in b])}
    return {i for s, e in runs(words) if tuple(a[s : e + 1]) in there for i in range(s, e + 1)}


def repeated_lines(a: list[int], words: list[int], b: list[int]) -> list[int]:
    """Places in a of aligned blocks and other shared runs with enough words. What is left is aligned again, so blocks in another order are found too."""
    left, drop = list(range(len(a))), []
    while True:
        own_a = [a[i] for i in left]
        pairs, k = patience(own_a, b), 0
        gone = [left[i] for i in shared_runs(own_a, [words[i] for i in left], b)]
        while k < len(pairs):
            end = k + 1
            while end < len(pairs) and pairs[end] == (pairs[end - 1][0] + 1, pairs[end - 1][1] + 1):
                end += 1
            own = [left[i] for i, _ in pairs[k:end]]
            if sum(words[i] for i in own) >= BLOCK_WORDS:
                gone += own
            k = end
        if not gone:
            return sorted(drop)
        drop += set(gone)
        left = sorted(set(left) - set(gone))


def block_keys(h: list[int], words: list[int]) -> set[int]:
    """Hashes of the lines with words and of the shortest runs of several lines with enough words."""
    return {x for x in h if x} | {hash(tuple(h[s : e + 1])) for s, e in runs(words) if s < e}


def _keys(batches):
    for batch in batches:
        keys = [list(block_keys(h, n)) for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["place", "doc_id", "keys"])


def _align(batches):
    for batch in batches:
        later, hashes, words, first = (batch.column(c).to_pylist() for c in range(4))
        found = [(p, repeated_lines(a, n, b)) for p, a, n, b in zip(later, hashes, words, first)]
        place, gone = [p for p, g in found if g], [g for _, g in found if g]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["place", "gone"])


def _place(docs: DataFrame) -> Column:
    return document_hash("lines", docs["doc_id"], docs["text"])


def deletions(docs: DataFrame) -> DataFrame:
    """place (key of doc_id and text) and the numbers of the lines to delete, where there are any."""
    bare = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    rows = docs.select(_place(docs).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), bare.alias("lines")).filter("lines is not null")
    words = F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)))
    rows = rows.select("place", "doc_id", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), words.alias("n"))
    rows = rows.withColumn("h", F.transform(F.arrays_zip("h", "n"), lambda x: F.when(x["n"] > 0, x["h"]).otherwise(F.lit(0).cast("long"))))
    rows = cut_lineage(rows.dropDuplicates(["place"]))
    # null doc_ids come last
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")
    keys = map_arrow(rows.select("place", "doc_id", "h", "n"), _keys, "place long, doc_id long, keys array<long>")
    held = keys.select(F.explode("keys").alias("x"), order.alias("d"))
    first = held.groupBy("x").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("df")).filter("df > 1").select("x", F.col("first.place").alias("first"))
    pairs = held.join(first, "x").select(F.col("d.place").alias("later"), "first").filter("later <> first").distinct()
    a = rows.select(F.col("place").alias("later"), F.col("h").alias("ha"), F.col("n").alias("na"))
    b = rows.select(F.col("place").alias("first"), F.col("h").alias("hb"))
    both = pairs.join(a, "later").join(b, "first").select("later", "ha", "na", "hb")
    found = map_arrow(both, _align, "place long, gone array<int>")
    return found.groupBy("place").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, deleted: str = "deleted_lines") -> DataFrame:
    """All rows with their columns, the text without its repeated blocks, and the number of lines deleted."""
    place, gone = fresh(docs, "line_place", "line_gone")
    what = deletions(docs).select(F.col("place").alias(place), F.col("gone").alias(gone))
    df = docs.join(what, _place(docs) == F.col(place), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), docs["text"]).otherwise(left)
    return df.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], F.coalesce(F.size(gone), F.lit(0)).alias(deleted))


def op5_line_alignment(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0))))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("deleted_lines").cast("long").alias("deleted_lines"), F.length("text").cast("long").alias("kept_chars"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))

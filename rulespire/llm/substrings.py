"""Substring dedup: words of passages that also stand in an earlier document are removed.

A window is a run of ``WINDOW`` words (runs of bytes other than white space, unchanged) of one text. A word goes if a
window that covers it starts, with the same words, in a document with a smaller doc_id. All windows are judged on the
input.

Method: level-wise doubling. (1) Half windows. Every run of ``WINDOW`` words holds a half window whose hash is least among
the neighbours that fit into one window, the same one in every copy of the run; only these are counted. Those of a single
document are dropped. (2) Runs of windows whose least half window is repeated are candidates, extended to ``WINDOW`` words. Of these, and of lengths 2, 4, 8 ... times that, again the least start among those that
fit into the next length is counted; starts that are repeated at one length are extended to twice that length,
until none survives. A repeated start with an earlier holder settles all windows inside it. (3) The other
candidates, near the ends of copied passages and in their first holders, are decided window by window.

A hash of twice the length is a hash of the two halves' hashes. What a step learns about a hash (its least holder) is
the same for all its holders, so shuffles carry distinct hashes per document, never places: a task finds the places again
from the text. Half windows are filtered by 64 bits, windows decided by 128. Counts are combined before the shuffle;
joins back to a very common passage are between two plain shuffles, which Spark splits. Texts that hold no candidate
leave after one shuffle; the others are written once to the shared folder.

Defined cases: null and empty texts have no words; rows with a null doc_id neither lose words nor make others lose
some; rows that share a doc_id are one holder, so a passage that only they have stays; equal rows give equal
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespire.llm.common import map_arrow
from rulespire.llm.files import shared_folder
from rulespire.llm.shingles import _Powers, mix64

WINDOW = 50
#: Bytes of text that are hashed at a time.
STEP = 1 << 20
_SPACE = b" \t\n\x0b\f\r"
_IS_SPACE = np.isin(np.arange(256), list(_SPACE))
_FOLD, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.empty(0, np.int64)


#: Two bases of the words' hashes, with the powers up and down that take a word's place out of them.
_BASES = [(_Powers(base), _Powers(pow(base, -1, 1 << 64))) for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between words."""
    at = 0
    while at < len(text):
        cut = at + STEP
        while cut < len(text) and text[cut] not in _SPACE:
            cut += 1
        yield text[at:cut]
        at = cut


def _hash_words(text: bytes, n_hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """[hashes, words] and the words' starts."""
    b = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[b], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    out = np.empty((n_hashes, len(start)), np.uint64)
    value = b + np.uint64(1)
    for h, (up, down) in zip(out, _BASES):
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(value * down.upto(len(b)), out=run[1:])
        h[:] = mix64((run[end] - run[start]) * up.upto(len(b) + 1)[start] + (end - start).astype(np.uint64) * _FOLD)
    return out, start


def codes(texts: list[bytes], n_hashes: int = 2) -> Iterator[np.ndarray]:
    """[hashes, words] of every text; short texts are hashed together."""
    some: list[bytes] = []
    held = 0

    def flush():
        h, start = _hash_words(b" ".join(some), n_hashes)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in some]))
        yield from (h[:, a:z] for a, z in zip([0, *ends[:-1]], ends))

    for text in texts:
        if held + len(text) > STEP and some:
            yield from flush()
            some, held = [], 0
        if len(text) > STEP:
            yield np.concatenate([_hash_words(part, n_hashes)[0] for part in pieces(text)], axis=1)
            continue
        some.append(text)
        held += len(text) + 1
    if some:
        yield from flush()


def doubled(h: np.ndarray, tail: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of h's windows, each with the one of ``tail`` that starts ``gap`` later."""
    n = max(0, tail.shape[-1] - gap)
    out = h[..., :n] * _FOLD
    out += tail[..., gap : gap + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words from the words' hashes."""
    size = 1
    while 2 * size <= length:
        h, size = doubled(h, h, size), 2 * size
    return doubled(h, h, length - size) if size < length else h


def _least(x: np.ndarray, run: int) -> np.ndarray:
    """Minimum of every ``run`` neighbours."""
    size = 1
    while 2 * size <= run:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - run + size], x[run - size :]) if size < run else x


def chosen(order: np.ndarray, run: int) -> np.ndarray:
    """Places that are the least of some ``run`` neighbours (of all, if there are fewer)."""
    run = min(run, len(order))
    if run == 0:
        return _NONE
    low, wall = _least(order, run), np.zeros(run - 1, np.uint64)
    most = ~_least(~np.concatenate([wall, low, wall]), run)
    return np.flatnonzero(order == most)


def halves(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct counted half windows of a text's words, as 64-bit hashes."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    half = windows(h, (window + 1) // 2)
    return np.unique(half[chosen(half, window - (window + 1) // 2 + 1)])


def candidates(h: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """[runs, 2] bounds of consecutive starts of windows whose least half window is repeated."""
    size = (window + 1) // 2
    least = _least(windows(h[0], size), window - size + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.isin(least, repeated), [0]])))
    return edge.reshape(-1, 2)


def extended(full: np.ndarray, runs: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, starts, [2, starts] hashes): the counted starts of ``window << level`` words in runs of candidates."""
    for a, z in runs.tolist():
        h, level, length = full[:, a:z], 0, window
        while h.shape[1]:
            at = chosen(full[0, a : a + h.shape[1]], length + 1)
            yield level, a + at, h[:, at]
            h, level, length = doubled(h, h, length), level + 1, 2 * length


def settled(full: np.ndarray, runs: np.ndarray, window: int, answers: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that earlier holders settle, and the other candidates, as masks."""
    step, open_ = np.zeros(full.shape[1] + 1, np.int64), np.zeros(full.shape[1], bool)
    for a, z in runs.tolist():
        open_[a:z] = True
    if answers:
        for level, at, h in extended(full, runs, window):
            for p, key in zip(at.tolist(), zip(h[0].view(np.int64).tolist(), h[1].view(np.int64).tolist())):
                if (level, *key) in answers:
                    step[p] += 1
                    step[p + (window << level) - window + 1] -= 1
    done = np.cumsum(step[:-1]) > 0
    return done, open_ & ~done


def kept(text: bytes, gone: np.ndarray | None) -> tuple[int, str]:
    """Number of words, and the hash of those not ``gone``, joined by spaces."""
    n, digest, first = 0, hashlib.sha256(), True
    for part in pieces(text):
        ws = part.split()
        some = ws if gone is None else [w for w, x in zip(ws, gone[n : n + len(ws)].tolist()) if not x]
        if some:
            digest.update((b"" if first else b" ") + b" ".join(some))
            first = False
        n += len(ws)
    return n, digest.hexdigest()


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """Words inside the windows that start at ``starts`` (a mask)."""
    step = np.zeros(len(starts) + window, np.int64)
    step[: len(starts)] += starts
    step[window:] -= starts
    return np.cumsum(step[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, salt, text; the salt only spreads rows that share a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(text) % 65536).cast("int").alias("salt"), text.alias("text"))


def _written(df: DataFrame, address: str) -> DataFrame:
    df.write.parquet(address)
    return df.sparkSession.read.schema(df.schema).parquet(address)


def _holders(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several documents hold, with the first."""
    both = rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return both.filter("first < last").drop("last")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def half_windows(docs: DataFrame, window: int) -> DataFrame:
    """h, doc_id, salt: the counted half windows of every document."""

    def run(batches):
        for b in batches:
            found, ids, salts = [], [], []
            texts = [t.encode() for t in b.column("text").to_pylist()]
            for doc_id, salt, words in zip(b.column("doc_id").to_pylist(), b.column("salt").to_pylist(), codes(texts, 1)):
                if doc_id is not None:
                    h = halves(words[0], window)
                    found.append(h)
                    ids.append(np.full(len(h), doc_id))
                    salts.append(np.full(len(h), salt, np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(salts))], ["h", "doc_id", "salt"])

    return map_arrow(docs, run, "h long, doc_id long, salt int")


CLEAN, OPEN, LADDER = range(3)
_SORTED = "doc_id long, salt int, n_words long, kept_sha256 string, text string, runs array<int>, asks array<int>, a array<long>, b array<long>, kind int"


def _sort_out(batches, window: int):
    """Texts with the repeated half windows they hold -> results of clean texts, open texts with their runs, hashes to count."""
    out, held = [], 0

    def table():
        nonlocal out, held
        cols = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()))]
        out, held = [], 0
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "salt", "n_words", "kept_sha256", "text", "runs", "asks", "a", "b", "kind"])

    for batch in batches:
        texts, given = batch.column("text").to_pylist(), batch.column("answer").to_pylist()
        # texts that hold nothing repeated aren't hashed
        hashed = codes([t.encode() for t, a in zip(texts, given) if a])
        for doc_id, salt, text, answer in zip(batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), texts, given):
            said = text.encode()
            runs = _NONE.reshape(0, 2)
            if answer:
                h = next(hashed)
                repeated = np.array([x["h"] for x in answer], np.int64).view(np.uint64)
                runs = candidates(h, repeated, window)
            if not len(runs):
                out.append((doc_id, salt, *kept(said, None), None, None, None, None, None, CLEAN))
                held += 200
            else:
                # a window whose least half window has no earlier holder has none itself
                earlier = np.array([x["earlier"] for x in answer], bool)
                asks = candidates(h, repeated[earlier], window)
                out.append((doc_id, salt, None, None, text, runs.ravel().tolist(), asks.ravel().tolist(), None, None, OPEN))
                held += len(said)
                chains: dict[int, tuple[list, list]] = {}
                for level, at, hashes in extended(windows(h, window), runs, window):
                    for p, x, y in zip(at.tolist(), *hashes.view(np.int64).tolist()):
                        if level == 0 or p in chains and len(chains[p][0]) == level:
                            a, b = chains.setdefault(p, ([], []))
                            a.append(x)
                            b.append(y)
                out += [(doc_id, salt, None, None, None, None, None, a, b, LADDER) for a, b in chains.values()]
                held += 40 * len(chains)
            if held > STEP:
                yield table()
    if out:
        yield table()


#: Rows per task of the later levels, which are few.
FEW = 50_000


def climb(ladder: DataFrame, folder: str) -> DataFrame:
    """doc_id, salt, level, x, y: windows of all lengths that an earlier document holds; ladder: doc_id, salt, a, b."""
    found, now, level = None, ladder, 0
    while True:
        here = now.filter(F.size("a") > level).select("doc_id", "salt", "a", "b", F.col("a")[level].alias("x"), F.col("b")[level].alias("y"))
        tasks = here.count() // FEW + 1
        holders = _written(_holders(here, "x", "y").coalesce(tasks), f"{folder}/holders-{level}")
        now = _written(here.join(holders, ["x", "y"]).withColumn("earlier", F.col("first") < F.col("doc_id")).coalesce(tasks), f"{folder}/level-{level}")
        if now.isEmpty() and level:
            return found
        hit = now.filter("earlier").select("doc_id", "salt", F.lit(level).alias("level"), "x", "y")
        found, level = hit if found is None else found.unionByName(hit), level + 1


def _answers(rows: DataFrame, *what: str) -> DataFrame:
    return rows.groupBy("doc_id", "salt").agg(F.collect_set(F.struct(*what)).alias("answer"))


def _opened(batches, window: int) -> Iterator[tuple]:
    """(batch row as dict, 128-bit hashes of its windows, settled starts, other candidates)."""
    for batch in batches:
        rows = batch.to_pylist()
        for row, words in zip(rows, codes([r["text"].encode() for r in rows])):
            full = windows(words, window)
            runs = np.array(row["runs"], np.int64).reshape(-1, 2)
            answers = {(x["level"], x["x"], x["y"]) for x in row["answer"] or ()}
            yield row, full, *settled(full, runs, window, answers)


def remaining(opened: DataFrame, window: int) -> DataFrame:
    """x, y, doc_id, salt, asks: windows to be decided one by one; ``asks`` where the document may lose it."""

    def run(batches):
        for row, full, _, rest in _opened(batches, window):
            asks = np.zeros(full.shape[1], bool)
            for a, z in np.array(row["asks"], np.int64).reshape(-1, 2).tolist():
                asks[a:z] = True
            at = np.flatnonzero(rest)
            if len(at):
                n = len(at)
                yield pa.RecordBatch.from_arrays([_signed(full[0, at]), _signed(full[1, at]), pa.array(np.full(n, row["doc_id"])), pa.array(np.full(n, row["salt"], np.int32)), pa.array(asks[at])], ["x", "y", "doc_id", "salt", "asks"])

    return map_arrow(opened.drop("asked"), run, "x long, y long, doc_id long, salt int, asks boolean")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,n:int>>"


def _decide(batches, window: int):
    out = []
    for row, full, done, rest in _opened(batches, window):
        lost = np.array([(x["x"], x["y"]) for x in row["lost"] or ()], np.int64).reshape(-1, 2)
        at = np.flatnonzero(rest)
        if len(lost) and len(at):
            keys = {(x, y) for x, y in lost.tolist()}
            pairs = zip(full[0, at].view(np.int64).tolist(), full[1, at].view(np.int64).tolist())
            done[at[[key in keys for key in pairs]]] = True
        gone = covered(done, window)
        n, digest = kept(row["text"].encode(), gone)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        out.append((row["doc_id"], n, int(gone.sum()), digest, [{"first": a, "n": z - a} for a, z in edges.tolist()]))
        if len(out) >= 1000:
            yield _result(out)
            out = []
    if out:
        yield _result(out)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), span))]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (removed runs of words)."""
    docs = _keyed(docs)
    folder = shared_folder(docs.sparkSession, "substrings")
    key = ["doc_id", "salt"]
    counted = half_windows(docs, window)
    repeated = _written(_holders(counted, "h"), f"{folder}/halves")
    held = counted.join(repeated, "h").select(*key, "h", (F.col("first") < F.col("doc_id")).alias("earlier"))
    held = _written(_answers(held, "h", "earlier"), f"{folder}/held")
    parts = map_arrow(docs.join(held, key, "left"), lambda b: _sort_out(b, window), _SORTED)
    parts.write.partitionBy("kind").parquet(f"{folder}/parts")
    parts = docs.sparkSession.read.schema(_SORTED).parquet(f"{folder}/parts")
    texts = parts.filter(F.col("kind") == OPEN).select(*key, "text", "runs", "asks")
    longer = climb(parts.filter(F.col("kind") == LADDER).select(*key, "a", "b"), folder)
    longer = _written(_answers(longer, "level", "x", "y"), f"{folder}/longer")
    opened = texts.join(longer, key, "left")
    rest = _written(remaining(opened, window), f"{folder}/rest")
    holders = _written(_holders(rest, "x", "y"), f"{folder}/holders")
    lost = rest.filter("asks").join(holders, ["x", "y"]).filter("first < doc_id")
    lost = _written(_answers(lost, "x", "y").withColumnRenamed("answer", "lost"), f"{folder}/lost")
    decided = map_arrow(opened.join(lost, key, "left"), lambda b: _decide(b, window), RESULT)
    clean = parts.filter(F.col("kind") == CLEAN).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast("array<struct<first:int,n:int>>").alias("spans"))
    return clean.unionByName(decided)


def op11_substring_dedup(spark, sf: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).drop("spans")


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS p, w FROM d WHERE len(w) >= {WINDOW}),
v AS (SELECT r, doc_id, p, md5(array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS k FROM v JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT r, list(k) AS gone FROM c GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS said FROM words ANTI JOIN c USING (r, k) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)"""

"""Language-model scoring: a log-bilinear model over word classes, trained by noise-contrastive estimation.

Tokens are white-space words (A-Z in lower case) and one end per text. The ``OWN`` most frequent words and the end are
classes of their own, all other words fall in ``TAILS`` classes by their last two bytes. With q the sum of the two
preceding classes' vectors, each scaled by a vector of its position,

    p(word | context) = exp(q . r[class] + b[class]) / Z(context) * (count + 0.5) / (class total + 0.5 (class words + 1))

where the last factor is 1 in a class of its own; the half counts leave room for one unknown word per class, so
probabilities sum to one. Z is computed exactly for all pairs of classes by batched matrix products.

Word counts are one pass (a table per task, then a sum by word). Training is one pass per round: every task runs
AdaGrad on its documents in numpy, from the same start, with class unigrams as noise; results are averaged by position in
Spark, weighted by tokens, so the driver sees one set of parameters whatever the number of tasks. Scoring is one
pass. Of the words, only the ``OWN`` ones are ever in the driver. The frequent words, at most ``TABLE`` of them, are those
at or above a count that a grouped histogram of the counts gives; one task writes them to a file in the
shared folder, which every scoring task reads. All other words are joined with the count table by a shuffle. All
passes read every text whole.

Defined cases: null and empty texts are one end; a null doc_id counts as the empty text for the fold; equal rows are
scored one by one; without training documents the start parameters are used; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulespire.llm.common import map_arrow
from rulespire.llm.files import locate, shared_folder
from rulespire.session import cut_lineage

END = b"\n"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Size of the model.
OWN, TAILS, WIDTH = 159, 96, 16
CLASSES = 1 + OWN + TAILS
#: Training: tokens in a step, noise samples of a step, learning rate, rounds over the corpus.
STEP, NOISE, RATE, ROUNDS = 2048, 24, 0.15, 1
#: Most words in the file of frequent ones; distinct words that a task counts before it passes them on.
TABLE, HELD = 200_000, 400_000
#: Steps of a doubling of counts in their histogram.
FINE = 16


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def tail_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % TAILS


def _tail(word: Column) -> Column:
    """Number of a word's tail class from 0, as ``tail_class`` has it."""
    return F.pmod(F.crc32(F.when(F.length(word) > 2, F.substring(word, -2, 2)).otherwise(word)), F.lit(TAILS)).cast("int")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def _count(batches):
    def out(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    held: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            held.update(tokens(text))
            held[END] += 1
            if len(held) > HELD:
                yield out(held)
                held = Counter()
    if held:
        yield out(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes; the end is a line feed), c over all texts; written once."""
    return cut_lineage(map_arrow(docs.select("text"), _count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    """What the model knows of the counts: the own words, the totals of the classes, the file of frequent words."""

    classes: dict[bytes, int]
    class_totals: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int
    table: str

    @classmethod
    def of(cls, counts: DataFrame, size: int = TABLE) -> "Vocabulary":
        top = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(OWN).collect()
        end = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c").alias("c")).first()["c"]
        classes = {END: 0} | {bytes(r["word"]): k + 1 for k, r in enumerate(top)}
        own_total, own_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in counts.groupBy(_tail(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            own_total[1 + OWN + r["k"]], own_words[1 + OWN + r["k"]] = r["c"], r["n"]
        total, distinct = int(own_total.sum()), int(own_words.sum())
        for word, c in [(END, end or 0), *((bytes(r["word"]), r["c"]) for r in top)]:
            if c:
                k, t = classes[word], tail_class(word)
                own_total[k], own_words[k] = c, 1
                own_total[t] -= c
                own_words[t] -= 1
        return cls(classes, own_total, own_words, total, distinct, _frequent(counts, list(classes), size))

    def class_shares(self) -> np.ndarray:
        p = self.class_totals + 0.5
        return p / p.sum()

    def word_logs(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        single = classes < 1 + OWN
        return np.where(single, 0.0, np.log10((counts + 0.5) / (self.class_totals[classes] + 0.5 * (self.class_words[classes] + 1))))

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _frequent(counts: DataFrame, own: list[bytes], size: int) -> str:
    """Folder of the ``own`` words and of those at or above the least count that at most ``size`` words reach."""
    step = F.floor(F.log2(F.col("c").cast("double")) * FINE).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 * FINE rows
    least, n = 64 * FINE, 0
    for r in sorted(histogram, key=lambda r: -r["step"]):
        n += r["n"]
        if n > size:
            break
        least = r["step"]
    address = shared_folder(counts.sparkSession, "words")
    counts.filter((step >= least) | F.col("word").isin(*map(F.lit, own))).coalesce(1).write.parquet(address)
    return address


def _read_words(address: str) -> tuple[list[bytes], np.ndarray]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = locate(address)
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=system) for f in files]
    words = [w for t in tables for w in t.column("word").to_pylist()]
    return words, np.concatenate([np.zeros(0, np.int64), *[t.column("c").to_numpy() for t in tables]])


class LogBilinear:
    """Parameters; class number CLASSES is the place before a text's first token."""

    def __init__(self, flat: np.ndarray):
        cut = np.cumsum([(CLASSES + 1) * WIDTH, CLASSES * WIDTH, CLASSES, 2 * WIDTH])
        self.flat = flat
        self.seen, self.said, self.bias, self.place = (
            flat[: cut[0]].reshape(-1, WIDTH), flat[cut[0] : cut[1]].reshape(-1, WIDTH), flat[cut[1] : cut[2]], flat[cut[2] : cut[3]].reshape(2, WIDTH))

    @classmethod
    def start(cls, shares: np.ndarray) -> "LogBilinear":
        draw = np.random.default_rng(11)
        sizes = (CLASSES + 1) * WIDTH, CLASSES * WIDTH
        return cls(np.concatenate([draw.normal(0, 0.1, sum(sizes)), np.log(shares), np.ones(2 * WIDTH)]))

    def train(self, runs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], shares: np.ndarray, seed: int) -> int:
        """Noise-contrastive estimation with AdaGrad over (class two before, class before, class); returns the tokens seen."""
        draw = np.random.default_rng(seed)
        grown, steps = np.full(len(self.flat), 1e-3), LogBilinear(np.zeros(len(self.flat)))
        bar, cumulative = np.log(NOISE * shares), np.cumsum(shares)
        columns, n = np.arange(WIDTH), 0

        def scatter(to, k, values):
            to += np.bincount((k[:, None] * WIDTH + columns).ravel(), values.ravel(), to.size).reshape(to.shape)

        for two, one, now in runs:
            for at in range(0, len(now), STEP):
                a, b, t = two[at : at + STEP], one[at : at + STEP], now[at : at + STEP]
                va, vb, vt = self.seen[a], self.seen[b], self.said[t]
                q = va * self.place[0] + vb * self.place[1]
                false = np.minimum(np.searchsorted(cumulative, draw.random(NOISE)), CLASSES - 1)
                vf = self.said[false]
                real = 1 / (1 + np.exp((q * vt).sum(1) + self.bias[t] - bar[t]))  # 1 - probability of being data
                noise = 1 / (1 + np.exp(bar[false] - self.bias[false] - q @ vf.T))  # of being taken for data
                dq = real[:, None] * vt - noise @ vf
                steps.flat[:] = 0
                scatter(steps.said, t, real[:, None] * q)
                scatter(steps.said, false, -(noise.T @ q))
                scatter(steps.seen, a, dq * self.place[0])
                scatter(steps.seen, b, dq * self.place[1])
                steps.bias += np.bincount(t, real, CLASSES) - np.bincount(false, noise.sum(0), CLASSES)
                steps.place[0], steps.place[1] = (va * dq).sum(0), (vb * dq).sum(0)
                g = steps.flat / len(t)
                grown += g * g
                self.flat += RATE * g / np.sqrt(grown)
                n += len(t)
        return n

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores [place, context class, class] with the bias in the second, and log Z of every pair of context classes."""
        one = (self.seen * self.place[0]) @ self.said.T
        two = (self.seen * self.place[1]) @ self.said.T + self.bias
        z = np.empty((CLASSES + 1, CLASSES + 1))
        for k in range(CLASSES + 1):
            s = one[k] + two
            top = s.max(axis=1)
            z[k] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return np.stack([one, two]), z


class _Classes(dict):
    """Class of every word met, from the own ones; bounded."""

    def __missing__(self, word):
        k = tail_class(word)
        if len(self) < 1_000_000:
            self[word] = k
        return k


def _contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two before, one before and the class itself for texts that end with their end token."""
    now = np.concatenate(classes)
    ends = np.cumsum([len(c) for c in classes])
    starts = ends - [len(c) for c in classes]
    one, two = np.empty_like(now), np.empty_like(now)
    one[1:], two[2:] = now[:-1], now[:-2]
    one[starts] = two[starts] = CLASSES
    second = starts + 1
    two[second[second < ends]] = CLASSES
    return two, one, now


def _texts(batches, limit: int = 1 << 20) -> Iterator[list]:
    """Rows (as tuples, the text last) in lists of about ``limit`` characters."""
    for b in batches:
        some, n = [], 0
        for row in zip(*(c.to_pylist() for c in b.columns)):
            some.append(row)
            n += len(row[-1] or "") + 1
            if n > limit:
                yield some
                some, n = [], 0
        if some:
            yield some


def fit(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Train on all texts of ``docs``."""
    shares = vocabulary.class_shares()
    own, model = vocabulary.classes, LogBilinear.start(shares)
    for turn in range(rounds):
        flat = model.flat

        def run(batches):
            from pyspark import TaskContext

            known = _Classes(own)
            here = LogBilinear(flat.copy())

            def runs():
                for some in _texts(batches):
                    yield _contexts([np.fromiter(map(known.__getitem__, [*tokens(t), END]), np.int64) for (t,) in some])

            n = here.train(runs(), shares, 1000 * turn + TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([here.flat.tolist()], pa.list_(pa.float64()))], ["n", "flat"])

        each = map_arrow(docs.select("text"), run, "n double, flat array<double>").filter("n > 0")
        mean = each.select("n", F.posexplode("flat").alias("k", "x")).groupBy("k").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).toArrow()
        if mean.num_rows:
            model = LogBilinear(mean.sort_by("k").column("x").to_numpy().copy())
    return model


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score, score."""
    both, z = model.tables()
    (far, near), log_z = both / math.log(10), z / math.log(10)

    def run(batches):
        words, found = _read_words(vocabulary.table)
        word_class = np.fromiter((vocabulary.classes[w] if w in vocabulary.classes else tail_class(w) for w in words), np.int64, len(words))
        word_log, base_log = vocabulary.word_logs(found, word_class), vocabulary.base_logs(found)
        place = {w: k for k, w in enumerate(words)}
        if END not in place:  # no training text
            place[END] = len(words)
            word_class, word_log, base_log = np.append(word_class, 0), np.append(word_log, 0.0), np.append(base_log, 0.0)
        first = len(words)
        for some in _texts(batches):
            rows = [[*tokens(t), END] for _, t in some]
            at = [np.fromiter((place.get(w, -1) for w in r), np.int64, len(r)) for r in rows]
            rest = [Counter(r[k] for k in np.flatnonzero(a < 0)) for r, a in zip(rows, at)]
            classes = []
            for r, a in zip(rows, at):
                c = word_class[np.where(a < 0, 0, a)]
                for k in np.flatnonzero(a < 0):
                    c[k] = tail_class(r[k])
                classes.append(c)
            two, one, now = _contexts(classes)
            flat = np.concatenate(at)
            known = flat >= 0
            score = far[two, now] + near[one, now] - log_z[two, one] + np.where(known, word_log[flat * known], 0)
            base = np.where(known, base_log[flat * known], 0)
            starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
            said = pa.array([list(r.keys()) for r in rest], pa.list_(pa.binary()))
            times = pa.array([list(r.values()) for r in rest], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in some], pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(np.add.reduceat(known & (flat < first), starts).astype(np.int64)),
                pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts)), said, times,
            ], ["doc_id", "n_tokens", "known", "base", "score", "words", "times"])

    schema = "doc_id long, n_tokens long, known long, base double, score double, words array<binary>, times array<long>"
    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    rare = rare.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    room = F.array(*[F.lit(float(t + 0.5 * (n + 1))) for t, n in zip(vocabulary.class_totals[1 + OWN :], vocabulary.class_words[1 + OWN :])])
    all_room = float(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    terms = rare.select("row", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10((c + 0.5) / all_room)).alias("base"), (F.col("n") * F.log10((c + 0.5) / F.get(room, _tail(F.col("word"))))).alias("score"))
    sums = terms.groupBy("row").agg(F.sum("known").alias("k_"), F.sum("base").alias("b_"), F.sum("score").alias("s_"))
    out = scored.drop("words", "times").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "n_tokens", plus("known", "k_").cast("long").alias("n_known"), plus("base", "b_").alias("base_score"), plus("score", "s_").alias("score"))


def op10_log_bilinear(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    training = docs.filter(fold(F.col("doc_id")) != 1)
    counts = word_counts(training)
    vocabulary = Vocabulary.of(counts)
    model = fit(training, vocabulary)
    scored = score_texts(docs, counts, vocabulary, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")

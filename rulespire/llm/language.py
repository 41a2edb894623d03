"""Language identification by Bayesian fusion of several pieces of evidence.

    P(language | all) ~ P(text | language)**(1/3) * P(declared | language) * P(suffix | language) * P(language | host)

* text: hashed byte trigrams of letters, counted per language over all labelled texts, for every label there is (sums per
  task, then by language and bucket; the model that goes to the workers grows with the number of labels); the power stands for the overlap of the trigrams;
* declared: the language named by the markup (``<html lang>``) or by the table; suffix: the last label of the address. Their
  likelihoods are shares of the texts' own posteriors, added up per value;
* host: shares of a host are smoothed towards those of its parent domain, these towards the shares of all texts,
  with weights ``HOST`` and ``DOMAIN``. All are grouped aggregations with map-side sums, so a host
  with a third of all rows is one row in the tables; joins to them are left to adaptive execution.

``und`` is one more hypothesis, under which all trigrams are equally likely and other evidence says nothing. A text
is kept if its likeliest language is a known, accepted one with a posterior of at least ``least``.

Defined cases: null and empty texts and texts without letters are ``und`` and not kept; a null or empty declaration,
suffix or host is no evidence; equal rows get equal results; without labelled texts everything is ``und``; an
empty table gives an empty result; other columns pass through ``accepted_documents`` and are not read otherwise.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from rulespire.llm.common import bound, document_hash, fresh, map_arrow, small
from rulespire.session import cut_lineage

BUCKETS = 8192
#: Prior of ``und``, strengths of the smoothing.
UNKNOWN, HOST, DOMAIN, VALUES = 1e-4, 20.0, 100.0, 50.0
#: Languages whose counts a task holds before it hands them on.
HELD = 256
#: Share of a text's trigrams that may be anything (keys, names), so that some of them don't outweigh the rest.
NOISE = 0.2
_KIND = np.full(256, 32, np.uint8)  # bytes of letters; everything else is a space
_KIND[97:123] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)
_BLOCK = re.compile(r"<(?:(script|style)\b|!--)", re.I | re.A)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I | re.A), "style": re.compile(r"</style\s*>", re.I | re.A), "--": re.compile("-->")}
_HTML = re.compile(r"<html\b", re.I | re.A)
_LANG = re.compile(r"""(?=\slang\s*=\s*["']?([a-z]{2,3}))""", re.I | re.A)


def read_page(page: str | None) -> tuple[str, str | None]:
    """Text of a page and the language of its first html tag that names one, read once from front to back.

    Scripts, styles and comments are left out to their ends. The end of a kind of block is searched no more once there is none; such
    an opener is a tag like any other. A tag that is not closed is text, with all that follows.
    """
    page = page or ""
    text, declared, unclosed, at = [], None, set(), 0
    while (start := page.find("<", at)) >= 0:
        end, block = 0, _BLOCK.match(page, start)
        kind = (block[1] or "--").lower() if block else None
        if block and kind not in unclosed:
            if close := _CLOSE[kind].search(page, block.end()):
                end = close.end()
            else:
                unclosed.add(kind)
        if not end:
            end = page.find(">", start) + 1
            if declared is None and _HTML.match(page, start):
                said = _LANG.findall(page, start, end or len(page))
                declared = said[-1].lower() if said else None
            if not end:
                break
        text.append(page[at:start])
        at = end
    return html.unescape(" ".join([*text, page[at:]])), declared


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram with at least two letters, of all texts in order, and the texts' numbers of them. Digits and
    the ASCII letters joined to them are no evidence: keys and numbers look the same in every language. Other letters beside
    them are, as scripts without spaces have no other place for a number."""
    joined = [(t or "").lower().encode() for t in texts]
    raw = np.frombuffer(b"  ".join([b"", *joined, b""]), np.uint8)
    digit = (raw >= 48) & (raw <= 57)
    other = ~(digit | ((raw >= 97) & (raw <= 122)))
    word = np.cumsum(other, dtype=np.int32)  # its first byte is the one before the letters and digits
    code_words = np.zeros(word[-1] + 1, bool)
    code_words[word[digit]] = True
    b = np.where(code_words[word] & ~other, np.uint8(32), _KIND[raw]).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    letter = (b != 32).astype(np.uint8)
    some = np.flatnonzero(letter[:-2] + letter[1:-1] + letter[2:] >= 2)
    ends = np.cumsum([len(j) + 2 for j in joined]) + 1  # a trigram is its middle letter's text's
    return ((code[some] * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64), np.diff(np.searchsorted(some, ends), prepend=0)


def _pieces(columns: list[list], text_at: int, limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows whose texts have about ``limit`` characters."""
    start = n = 0
    for k, text in enumerate(columns[text_at]):
        n += len(text or "") + 2
        if n > limit:
            yield slice(start, k + 1)
            start, n = k + 1, 0
    if start < len(columns[text_at]):
        yield slice(start, len(columns[text_at]))


def _count(batches):
    sums: dict[str, np.ndarray] = {}

    def held():
        for name, row in sums.items():
            k = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(row[k])], ["language", "k", "n"])
        sums.clear()

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for at in _pieces(columns, 1):
            bucket, n = trigrams(columns[1][at])
            start = 0
            for name, end in zip(columns[0][at], np.cumsum(n).tolist()):
                if name not in sums and len(sums) == HELD:
                    yield from held()
                sums[name] = sums.get(name, 0) + np.bincount(bucket[start:end], minlength=BUCKETS)
                start = end
    yield from held()


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled (language, text) -> all languages and log probabilities [language, bucket]; ``und`` comes last."""
    rows = labelled.filter("language is not null and language <> '' and language <> 'und'")
    names = sorted(r["language"] for r in rows.select("language").distinct().collect())
    logs = np.full((len(names) + 1, BUCKETS), -np.log(BUCKETS))
    if names:
        each = map_arrow(rows.select("language", "text"), _count, "language string, k long, n long")
        number, counts = {x: k for k, x in enumerate(names)}, np.zeros((len(names), BUCKETS))
        for b in each.groupBy("language", "k").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most languages x BUCKETS rows
            counts[[number[x] for x in b.column(0).to_pylist()], b.column(1).to_numpy()] = b.column(2).to_numpy()
        shares = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        logs[:-1] = np.log((1 - NOISE) * shares + NOISE / BUCKETS)
    return [*names, "und"], logs


def evidence(rows: DataFrame, logs: np.ndarray) -> DataFrame:
    """Replace ``text`` (the last column) by n (trigrams) and ll, the tempered log likelihood of each language. A true
    ``is_markup`` column tells that the text is a page."""
    kept = [c for c in rows.columns if c != "text"]
    table = np.ascontiguousarray(logs.T)
    schema = rows.select(*kept).schema.add("n", LongType()).add("ll", ArrayType(DoubleType()))

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            markup = b.column(b.schema.get_field_index("is_markup")).to_pylist()
            texts = [read_page(t)[0] if m else t for t, m in zip(texts, markup)]
            for at in _pieces([texts], 0):
                bucket, n = trigrams(texts[at])
                ll = np.zeros((len(n), table.shape[1]))
                has = n > 0
                if has.any():
                    starts = (np.cumsum(n) - n)[has]
                    for k in range(table.shape[1]):
                        ll[has, k] = np.add.reduceat(table[bucket, k], starts) / 3
                columns = [b.column(b.schema.get_field_index(c)).slice(at.start, at.stop - at.start) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(list(ll), pa.list_(pa.float64()))], [*kept, "n", "ll"])

    return map_arrow(rows.select(*kept, "text"), run, schema)


def _softmax(logits: Column) -> Column:
    def shares(powers):
        return bound(F.aggregate(powers, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(powers, lambda x: x / total))

    def of(xs):
        powers = bound(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(F.greatest(x - top, F.lit(-700.0)))))
        return bound(powers, shares)

    return bound(logits, of)


def fuse(rows: DataFrame, names: list[str], carry: list[str], accepted: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Evidence rows (carry, n, ll, declared, suffix, host, domain) -> carry, language, posterior, kept."""
    known = len(names) - 1
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rows = rows.select(*carry, "n", "ll", *[blank(c) for c in ("declared", "suffix", "host", "domain")])
    und = F.lit(float(np.log(UNKNOWN)))
    own = F.when(F.col("n") > 0, F.transform("ll", lambda x, i: F.when(i == known, x + und).otherwise(x))).otherwise(F.transform("ll", lambda x, i: F.when(i == known, 0.0).otherwise(-700.0)))
    rows = cut_lineage(rows.withColumn("own", own).withColumn("p", _softmax(F.col("own"))).drop("own"))
    shares = [F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(known)]
    arr = lambda: F.array(*[F.col(f"s{k}") for k in range(known)]) if known else F.array().cast("array<double>")

    all_ = rows.agg(*shares, F.count(F.lit(1)).alias("n_all")).first()
    sums = [float(all_[f"s{k}"] or 0.0) for k in range(known)]
    prior = [(s + 1) / (sum(sums) + known) for s in sums]
    level = F.array(*[F.lit(x) for x in prior]) if known else F.array().cast("array<double>")
    totals = F.array(*[F.lit(s) for s in sums]) if known else F.array().cast("array<double>")

    def per_value(c):
        """log P(value | language), smoothed towards the value's share of all rows."""
        t = rows.filter(F.col(c).isNotNull()).groupBy(c).agg(*shares, F.count(F.lit(1)).alias("m"))
        share = F.col("m") / F.lit(float(max(1, all_["n_all"])))
        return t.select(F.col(c).alias(f"{c}_"), F.transform(F.arrays_zip(arr().alias("a"), totals.alias("b")), lambda x: F.log((x["a"] + VALUES * share) / (x["b"] + VALUES))).alias(f"{c}_log"))

    def smooth(counts, towards, weight):
        total = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y)
        return bound(total, lambda t: F.transform(F.arrays_zip(counts.alias("a"), towards.alias("b")), lambda x: (x["a"] + weight * x["b"]) / (t + weight)))

    domains = rows.filter("domain is not null").groupBy("domain").agg(*shares, F.count(F.lit(1))).select(F.col("domain").alias("d_"), smooth(arr(), level, DOMAIN).alias("d_share"))
    hosts = rows.filter("host is not null").groupBy("host", "domain").agg(*shares, F.count(F.lit(1))).join(domains, F.col("domain") == F.col("d_"), "left")
    hosts = hosts.select(F.col("host").alias("h_"), F.col("domain").alias("hd_"), smooth(arr(), F.coalesce("d_share", level), HOST).alias("h_share"))

    df = rows.join(per_value("declared"), F.col("declared") == F.col("declared_"), "left").join(per_value("suffix"), F.col("suffix") == F.col("suffix_"), "left")
    df = df.join(hosts, (F.col("host") == F.col("h_")) & F.col("domain").eqNullSafe(F.col("hd_")), "left")
    nothing = F.array_repeat(F.lit(0.0), known)
    # und has its prior, and for other evidence the mean of the languages
    def with_und(a, unknown):
        return F.concat(a, F.array(unknown))
    mean = lambda a: F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.lit(float(known or 1)), F.lit(0.0))
    said = [F.coalesce(f"{c}_log", nothing) for c in ("declared", "suffix")]
    host = F.transform(F.coalesce("h_share", level), lambda x: F.log(x))
    total = F.transform(F.arrays_zip(F.col("ll").alias("t"), *[with_und(a, mean(a)).alias(x) for a, x in zip(said, "ds")], with_und(host, und).alias("h")), lambda x: x["t"] + x["d"] + x["s"] + x["h"])
    named = F.array(*[F.lit(x) for x in names])
    best = bound(_softmax(total), lambda q: bound(F.array_max(q), lambda p: F.struct(F.element_at(named, F.array_position(q, p).cast("int")).alias("language"), p.alias("posterior"))))
    df = df.select(*carry, "n", best.alias("best"))
    some = F.col("n") > 0
    df = df.select(*carry, F.when(some, F.col("best.language")).otherwise("und").alias("language"), F.when(some, F.col("best.posterior")).otherwise(0.0).alias("posterior"))
    fine = F.col("language").isin(accepted if accepted is not None else names[:-1])
    return df.withColumn("kept", fine & (F.col("posterior") >= least))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for ``evidence``: the lang column is the declaration, the source the host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("lang").alias("declared"),
        none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"), F.lit(False).alias("is_markup"), "text")


def _read_pages(batches):
    for b in batches:
        found = [read_page(p) for p in b.column(2).to_pylist()]
        said, texts = (pa.array(x, pa.string()) for x in ([d for _, d in found], [t for t, _ in found]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), said, texts], ["page_id", "host", "declared", "text"])


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``evidence``: their texts and declared languages, read together."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), "html")
    rows = map_arrow(rows, _read_pages, "page_id long, host string, declared string, text string")
    return rows.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", "declared", F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"),
        "host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("domain"), F.lit(False).alias("is_markup"), "text")


def accepted_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is identified, with all columns."""
    names, logs = train(docs.select(F.col("lang").alias("language"), "text"))
    place = document_hash("language", F.col("doc_id"), F.col("text"))
    rows = document_rows(docs).withColumn("place", place)
    (gone,) = fresh(docs, "language_place")
    rejected = fuse(evidence(rows, logs), names, ["place"], least=least).filter("not kept").select(F.col("place").alias(gone)).distinct()
    return docs.join(small(rejected), document_hash("language", docs["doc_id"], docs["text"]) == F.col(gone), "left_anti")


def op3_language_id(spark, sf: str) -> DataFrame:
    """Documents and pages together, with one model and one set of host tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, logs = train(docs.select(F.col("lang").alias("language"), "text"))
    rows = document_rows(docs).unionByName(page_rows(spark.read.parquet(f"{sf}/pages.parquet")))
    out = fuse(evidence(rows, logs), names, ["kind", "doc_id", "page_id"])
    return out.select("kind", "doc_id", "page_id", "language", F.round("posterior", 6).alias("posterior"), "kept")

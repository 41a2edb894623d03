"""Token ids in Arrow files of equal-length sequences.

``write_tokens`` puts the documents in ascending doc_id order (ranges, no single sort),
encodes every whole text and writes one pair of Arrow IPC files per range to a shared
folder:

    part-N.arrow         ids: fixed_size_list<uint16>[length], mask: fixed_size_list<bool>[length]
    part-N-docs.arrow    doc_id, offset (in the part), n_tokens

A part's ids follow each other without gaps; its last sequence is filled up, with the mask
false there. ``Sequences`` opens a part as a memory map: sequence k is a view of the file.
Files get their final names when complete, and the manifest lists those that count, so a
repeated or speculative task leaves nothing behind that is read.

Encoding looks up white-space words in a bounded table of pieces already encoded by the
library's model; a space can only begin a piece of this tokenizer, so words between single spaces are
encoded on their own, split as the tokenizer splits them. Texts for which that doesn't hold by inspection (runs of spaces,
characters outside Latin scripts, special tokens) are encoded whole.

Defined cases: null and empty texts are one end id; null doc_ids come first; equal doc_ids
are ordered by the text's hash, then text, so one id with a third of all rows is spread over ranges; an empty
table writes nothing and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rulespire.llm.common import map_arrow
from rulespire.llm.files import locate, shared_folder
from rulespire.session import cut_lineage

END = 0
LENGTH = 2048
#: Sequences in a record batch; texts encoded together, in characters; pieces kept.
BATCH, CHUNK, PIECES = 256, 1 << 16, 1_000_000
#: Characters that this tokenizer's pattern and the word split agree on: Latin letters, digits, common marks.
OTHER = re.compile("[^\t\n\r\x20-\x7e¡§«»¿À-ɏ‐-―‘-‟…€]")
RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", "<|endoftext|>")


#: The tokenizer's own split, for characters that OTHER lets pass.
SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _shown() -> dict[int, str]:
    """A byte-level tokenizer's character for each byte: itself where printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


SHOWN = _shown()


class Pieces(dict):
    """Number of each piece. Unknown ones are numbered and left in ``todo``, or in ``joint`` when they consist of
    several pieces. A text without a space before it is a tuple of one string."""

    def __init__(self):
        super().__init__()
        self.todo: list[tuple[int, str]] = []
        self.joint: list[tuple[int, list[int]]] = []

    def __missing__(self, piece):
        said = piece[0] if type(piece) is tuple else " " + piece
        parts = [said] if type(piece) is str and piece.isalpha() else SPLIT.findall(said)
        if len(parts) > 1:
            own = [self[x[1:]] if x[0] == " " and x != " " else self[(x,)] for x in parts]
            self[piece] = at = len(self)
            self.joint.append((at, own))
        else:
            self[piece] = at = len(self)
            self.todo.append((at, said))
        return at


class Encoder:
    """Encodes texts with a tokenizers file, END appended to each."""

    kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One encoder per worker process and file: its pieces serve all tasks of the worker."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def forget(self) -> None:
        self.pieces = Pieces()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.first, self.count = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)

    def _keep(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Store the ids of pieces ``at``, which follow each other in ``ids``."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[at], self.first[at] = counts, self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces ``at`` and the end of each."""
        counts = self.count[at]
        ends = np.cumsum(counts, dtype=np.int64)
        return self.flat[np.repeat(self.first[at] - (ends - counts), counts) + np.arange(ends[-1])], ends

    def _learn(self) -> None:
        if len(self.pieces) > len(self.first):
            self.first, self.count = (np.resize(x, max(len(self.pieces), 2 * len(x))) for x in (self.first, self.count))
        todo, joint, tokenize = self.pieces.todo, self.pieces.joint, self.tokenizer.model.tokenize
        for k in range(0, len(todo), 20_000):
            some = todo[k : k + 20_000]
            ids = [[t.id for t in tokenize(x.encode().decode("latin-1").translate(SHOWN))] for _, x in some]
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            self._keep(np.array([at for at, _ in some]), np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)
        if joint:
            parts = np.fromiter(chain.from_iterable(own for _, own in joint), np.int64)
            ids, _ = self._gather(parts)
            start = np.cumsum([0] + [len(own) for _, own in joint[:-1]])
            self._keep(np.array([at for at, _ in joint]), ids, np.add.reduceat(self.count[parts], start))
        self.pieces.todo, self.pieces.joint = [], []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with END."""
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list = []
        sizes, where, whole = [], [], []
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.array([END], np.uint32)
            elif text[0] == " " or text[-1] == " " or any(r in text for r in RUNS) or OTHER.search(text):
                whole.append(k)
            else:
                own = text.split(" ")
                own[0] = (own[0],)
                words += own
                sizes.append(len(own))
                where.append(k)
        if words:
            if len(self.pieces) > PIECES:
                self.forget()
            at = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
            if self.pieces.todo or self.pieces.joint:
                self._learn()
            ids, ends = self._gather(at)
            start = 0
            for k, end in zip(where, ends[np.cumsum(sizes) - 1]):
                out[k] = np.append(ids[start:end], np.uint32(END))
                start = end
        for k in whole:  # one at a time: such a text may be very long
            out[k] = np.append(np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32), np.uint32(END))
        return out


def in_chunks(rows: Iterable[tuple], text_at: int, limit: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows in lists whose texts add up to about ``limit`` characters."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[text_at] or "") + 1
        if n >= limit:
            yield some
            some, n = [], 0
    if some:
        yield some


def _schema(length: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs ids into sequences of one length and writes them batch by batch."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = _schema(length, pa.from_numpy_dtype(self.dtype))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        full = self.n_held // (BATCH * self.length) * BATCH * self.length
        if full:
            self._put(full)

    def _put(self, n: int) -> None:
        ids = np.concatenate(self.held)
        rest = ids[n:].copy()
        real = min(n, len(ids))
        full = np.zeros(n, self.dtype)
        full[:real] = ids[:real]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, np.arange(n) < real)]
        self.file.write_table(pa.Table.from_arrays(lists, schema=self.schema), max_chunksize=BATCH)
        self.n_sequences += n // self.length
        self.held, self.n_held = [rest] if len(rest) else [], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._put(-(-self.n_held // self.length) * self.length)
        self.file.close()


class Sequences:
    """A part's equal-length sequences; on a local file nothing is copied."""

    def __init__(self, address: str):
        from pyarrow import fs

        system, path = locate(address)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k; all batches but the last hold BATCH sequences."""
        batch = self.file.get_batch(k // BATCH)
        at = (k % BATCH) * self.length
        return tuple(batch.column(c).values.slice(at, self.length).to_numpy(zero_copy_only=c == 0) for c in (0, 1))

    def real_ids(self) -> np.ndarray:
        """All ids under the mask, in order."""
        out = []
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids, mask = (batch.column(c).values.to_numpy(zero_copy_only=c == 0) for c in (0, 1))
            out.append(ids if mask.all() else ids[mask])
        return np.concatenate(out) if out else np.empty(0, np.uint32)


DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, dtype: str = "uint16") -> DataFrame:
    """Write all documents (doc_id, text); returns the manifest: part, file, n_docs, n_tokens, n_sequences."""

    def write(batches):
        import uuid

        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), Encoder.at(tokenizer)
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        first = next(rows, None)
        if first is None:
            return
        name, own = f"part-{part:08d}", uuid.uuid4().hex
        system, base = locate(folder)
        system.create_dir(base, recursive=True)
        final, hidden = f"{base}/{name}-{own}", f"{base}/_{name}-{own}"
        doc_ids, counts = [], []
        with system.open_output_stream(f"{hidden}.arrow") as sink:
            out = SequenceWriter(sink, length, dtype)
            for some in in_chunks(chain([first], rows), 1):
                for (doc_id, _), ids in zip(some, encoder.encode([t for _, t in some])):
                    out.add(ids)
                    doc_ids.append(doc_id)
                    counts.append(len(ids))
            out.close()
        n = np.array(counts, np.int64)
        with system.open_output_stream(f"{hidden}-docs.arrow") as sink, pa.ipc.new_file(sink, DOCS) as index:
            index.write_table(pa.table([pa.array(doc_ids, pa.int64()), np.cumsum(n) - n, n], schema=DOCS))
        for end in (".arrow", "-docs.arrow"):
            system.move(hidden + end, final + end)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{name}-{own}"], "n_docs": [len(n)], "n_tokens": [int(n.sum())], "n_sequences": [out.n_sequences]}, pa.schema(
            [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return cut_lineage(map_arrow(ordered, write, "part int, file string, n_docs long, n_tokens long, n_sequences long"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start among all ids, n_tokens and crc32 of its ids as little-endian uint32."""

    def read(batches):
        system, base = locate(folder)
        for b in batches:
            for row in b.to_pylist():
                ids = Sequences(f"{folder}/{row['file']}.arrow").real_ids()
                with system.open_input_file(f"{base}/{row['file']}-docs.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                offset, n = (index.column(c).to_numpy() for c in (1, 2))
                if int(n.sum()) != len(ids):
                    raise ValueError(f"{row['file']}: {len(ids)} ids under the mask, {int(n.sum())} in the index")
                crc = np.fromiter((zlib.crc32(ids[o : o + k].astype("<u4")) for o, k in zip(offset, n)), np.int64, len(n))
                yield pa.RecordBatch.from_arrays([index.column(0).combine_chunks(), pa.array(offset + row["before"]), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per part
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", "file", before.cast("long").alias("before"))
    spread = parts.repartitionByRange(max(1, manifest.count()), "part")
    return map_arrow(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, folder)

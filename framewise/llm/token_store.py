"""Token ids of a corpus as binary files with Elias-Fano coded document bounds.

A file holds the ids of its documents one after another (2 bytes each where the
vocabulary allows, else 4), then the ends of the documents and their doc_ids,
which ascend too, as Elias-Fano sequences with select samples, and a JSON footer.
Files follow ascending doc_id; a document's global start is the ids of the files
before plus what its file's bounds say.

Nulls and odd input: null or empty text encodes to the end id alone; very long
texts are encoded whole; a null doc_id sorts first and is kept; rows that share a
doc_id are ordered by text and all kept; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .common import arrow_rows, new_dir, released, written
from .elias_fano import SAMPLE, EliasFano
from .tokens import tokenizer

MAGIC = b"FWTOKEN1"
MANIFEST = "part long, uri string, n_docs long, n_ids long"
PARTS = ("low", "high", "samples")
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_file(uri: str, attempt: str, dtype: np.dtype, documents) -> tuple[int, int]:
    """Write (doc_id, ids as bytes) pairs as one file; the numbers of documents and ids."""
    keys, ends, total = [], [], 0
    with storage.AtomicFile(uri, attempt) as out:
        for doc_id, ids in documents:
            out.write(ids)
            total += len(ids) // dtype.itemsize
            keys.append(doc_id)
            ends.append(total)
        known = np.array([k for k in keys if k is not None], "<i8")
        first = int(known[0]) if len(known) else 0
        codes = {"ends": EliasFano.encode(np.array(ends, np.uint64)), "doc_ids": EliasFano.encode((known - np.int64(first)).view(np.uint64))}
        parts = [(f"{of}.{name}", getattr(code, name)) for of, code in codes.items() for name in PARTS]
        footer = {"n_docs": len(keys), "n_ids": total, "n_null": len(keys) - len(known), "first_id": first, "dtype": dtype.str, "low_bits": {of: code.low_bits for of, code in codes.items()}, "parts": {}}
        at = total * dtype.itemsize
        for name, values in parts:
            raw = values.tobytes()
            footer["parts"][name] = [at, len(raw), values.dtype.str]
            out.write(raw)
            at += len(raw)
        raw = json.dumps(footer).encode()
        out.write(raw + struct.pack("<Q", len(raw)) + MAGIC)
    return len(keys), total


class TokenFile:
    """One file, opened: `bounds` in Elias-Fano form, `documents()` in order, `document(i)` at random."""

    def __init__(self, uri: str):
        self.file = storage.read_file(uri)
        size = self.file.size()
        self.file.seek(size - 16)
        length, magic = struct.unpack("<Q8s", self.file.read(16))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.file.seek(size - 16 - length)
        self.footer = json.loads(self.file.read(length))
        self.dtype = np.dtype(self.footer["dtype"])
        n, null = self.footer["n_docs"], self.footer["n_null"]
        self.bounds, self.doc_ids = self._code("ends", n), self._code("doc_ids", n - null)

    def _code(self, of: str, n: int) -> EliasFano:
        return EliasFano(n, self.footer["low_bits"][of], *(self._part(f"{of}.{name}") for name in PARTS))

    def doc_id(self, i: int) -> int | None:
        """The i-th document's id, found by select; null ones come first."""
        at = i - self.footer["n_null"]
        return None if at < 0 else self.footer["first_id"] + self.doc_ids[at]

    def _part(self, name: str) -> np.ndarray:
        at, size, dtype = self.footer["parts"][name]
        self.file.seek(at)
        return np.frombuffer(self.file.read(size), dtype)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by select."""
        return self.ids(self.bounds[i - 1] if i else 0, self.bounds[i])

    def documents(self):
        """(doc_id, start in this file, ids) of each document, block by block."""
        start = 0
        names = self._names()
        for j in range(math.ceil(self.footer["n_docs"] / SAMPLE)):
            for end in self.bounds.block(j).tolist():
                yield next(names), start, self.ids(start, end)
                start = end

    def _names(self):
        yield from [None] * self.footer["n_null"]
        for j in range(math.ceil(self.doc_ids.n / SAMPLE)):
            yield from (self.footer["first_id"] + x for x in self.doc_ids.block(j).tolist())


def write_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 1, rows_per_file: int = 20_000, directory: str | None = None) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; a table of files: uri, before (ids in all files before it), n_docs, n_ids.

    Documents are dealt by ranges of doc_id, as many as keep files near
    `rows_per_file` rows, and tokenized where they arrive. A file's name holds
    its attempt, and the table names those of tasks that succeeded.
    """
    spark = docs.sparkSession
    directory = directory or new_dir(spark, "tokens")
    storage.ensure_dir(directory)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_file))

    def encode(batches):
        task, tok = TaskContext.get(), tokenizer(tokenizer_path)
        end = np.array([end_id], tok.dtype).tobytes()

        def documents():
            for batch in batches:
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for doc_id, ids in zip(batch.column(0).to_pylist(), tok.encode(texts), strict=True):
                    yield doc_id, ids + end

        stream = documents()
        head = next(stream, None)
        if head is None:
            return
        uri = f"{directory}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        n_docs, n_ids = write_file(uri, str(task.taskAttemptId()), tok.dtype, _chain(head, stream))
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    arrow_rows(spark)
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(released(encode), MANIFEST), "token-files")
    # A row per file, not per document.
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return written(manifest.select("uri", F.coalesce(before, F.lit(0)).alias("before"), "n_docs", "n_ids"), "token-manifest")


def _chain(head, rest):
    yield head
    yield from rest


def read_corpus(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from a table of files."""

    def read(batches):
        for uri, before in (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            rows: list[tuple] = []
            for doc_id, start, ids in TokenFile(uri).documents():
                rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return files.select("uri", "before").repartition(max(1, files.count()), "uri").mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

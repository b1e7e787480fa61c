"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of the words in it and of their
beginnings (3 to 7 characters, so that new compounds of a known stem count); a
document's is the noisy-or, 1 - prod(1 - p), of one small constant and of what each
sentence has beyond that constant, if anything: (1 - p) / (1 - constant), at most 1.
So sentences that say nothing, or next to nothing, add as little, however many
there are. The weights are fitted so that this noisy-or agrees with the labels of
documents, so the sentences that carry a toxic document's score are located without
sentence labels.

Fitting uses at most `sample_rows` labelled rows with different texts, the first
by a hash of doc_id, and the `most_words` features that tell most about the label
(documented bounds of the classifier); scoring covers every whole text. Only
the texts are inputs: labels, lang, source and doc_id are not.

Nulls and odd input: null and empty texts are one empty sentence; very long texts
are scored whole, sentence by sentence; rows with a
null doc_id or label aren't fitted on; of several labels of a document the
largest counts; without any usable labels all scores are the same small value;
an empty table gives no rows; other columns are ignored, or kept by `reject`.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, text_or_empty, written

SENTENCE = re.compile(rb"[^.!?\r\n]+")
#: ASCII letters, digits and all other code points' bytes make words.
WORD_BYTES = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(128)) + bytes(range(128, 256))
RESULT = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"


PREFIXES = range(3, 8)
#: A document without known words is worth this at most, once whatever its length, so that length alone never makes a document toxic.
MOST_BIAS = -10.0


def features(word: bytes) -> list[bytes]:
    """A word's features: itself, and its beginnings with a star."""
    text = word.decode("utf-8", "replace")
    return [word, *(text[:k].encode() + b"*" for k in PREFIXES if k <= len(text))]


class _Values(dict):
    """Word -> summed weight of its features, worked out once a word; emptied when over `CAP` words."""

    CAP = 100_000

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.CAP:
            self.clear()
        found = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= 64:
            self[word] = found
        return found


class Model:
    """Feature weights and the value of a document without known words."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.values = _Values(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def document(self, text: bytes | None, locate: bool = True) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a UTF-8 text, and byte spans of sentences with a probability of 1/2 or more."""
        plain = float(np.log1p(np.exp(self.bias)))  # -log(1 - p) of a document without known words
        low = (text or b"").lower()
        value = self.values.__getitem__
        if not any(map(value, low.translate(WORD_BYTES).split())):
            return float(-np.expm1(-plain)), []
        total, spans = plain, []
        for m in SENTENCE.finditer(low):
            known = sum(map(value, m[0].translate(WORD_BYTES).split()))
            if known <= 0:
                continue
            z = self.bias + known
            total += max(z, 0.0) + log1p(exp(-abs(z))) - plain
            if locate and z >= 0:
                spans.append((m.start(), m.end(), 1 / (1 + exp(-z))))
        return -expm1(-total), spans


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """y and text of the sample; doc_ids whose CRC-32 as text is a multiple of 5 are held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    # A limit on rows once more: documents may share an id, and fit on each text once.
    return sample.groupBy(F.sha2("text", 256).alias("_key")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_words: int = 2_000, rounds: int = 400) -> Model:
    """Fit on a bounded sample. Executors count words and turn texts into lists of known words; the driver gets those alone."""
    sample = written(training_rows(docs, labels, sample_rows), "toxicity-sample")
    arrow_rows(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()

        def flush():
            keys = [*seen]
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.binary()), pa.array([y for _, y in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["word", "y", "n"])
            seen.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen.update((f, y) for f in {f for w in {*text.lower().translate(WORD_BYTES).split()} for f in features(w)})
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(n for y, n in size.items() if y == 1), sum(n for y, n in size.items() if y != 1)
    if not n1 or not n0:
        return Model({}, MOST_BIAS)
    words = sample.mapInArrow(released(count), "word binary, y int, n long").groupBy("word")
    words = words.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("b"))
    # Chi-square of word against label, one degree of freedom; kept beyond the 0.1 % point with at least threefold odds either way.
    n, a, b = float(n1 + n0), F.col("a").cast("double"), F.col("b").cast("double")
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2.0) / (n1 * float(n0) * (a + b) * (n - a - b))
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    words = words.filter("a + b >= 5").withColumns({"chi": F.when(a + b < n, chi), "ratio": ratio}).filter("chi > 10.8 and (ratio > 3 or ratio < 1 / 3D)")
    vocabulary = sorted(bytes(r.word) for r in words.orderBy(F.desc("chi"), "word").limit(most_words).collect())
    if not vocabulary:
        return Model({}, MOST_BIAS)
    at = {w: i for i, w in enumerate(vocabulary)}

    def known(batches):
        for batch in batches:
            ys, rows = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = [[at[f] for w in s.translate(WORD_BYTES).split() for f in features(w) if f in at] for s in SENTENCE.findall(text.lower())]
                ys.append(int(y == 1))
                rows.append([s for s in found if s])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int32())))], ["y", "known"])

    rows = sample.mapInArrow(known, "y int, known array<array<int>>").collect()
    return _fit(np.array([r.y for r in rows]), [r.known for r in rows], vocabulary, rounds)


def _fit(y: np.ndarray, known: list, vocabulary: list[bytes], rounds: int, ridge: float = 1e-5) -> Model:
    """Full-batch Adam on the noisy-or's log loss, with a ridge on the weights."""
    sentences = [s for doc in known for s in doc]
    doc_of = np.repeat(np.arange(len(known)), [len(doc) for doc in known])
    word = np.array([w for s in sentences for w in s], np.int64)
    sentence_of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    x = np.zeros(len(vocabulary) + 1)
    x[-1] = MOST_BIAS
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(sentence_of, x[word], len(sentences))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1 / (1 + np.exp(-x[-1]))
        # A sentence counts by its excess over the bias alone; below it, not at all.
        counts = z >= x[-1]
        rest = np.bincount(doc_of, np.where(counts, np.logaddexp(0, z) - np.logaddexp(0, x[-1]), 0.0), len(y)) + np.logaddexp(0, x[-1])
        # Loss by `rest` = -log(1 - score): 1 for clean documents, -1 / (e^rest - 1) for toxic ones.
        by_rest = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(rest, 50)), 1e-9), 1.0) / len(y)
        by_doc = np.where(counts, by_rest[doc_of], 0.0)
        by_z = by_doc * p
        g = np.append(np.bincount(word, by_z[sentence_of], len(vocabulary)) + ridge * x[:-1], (by_doc * (p - p0)).sum() + by_rest.sum() * p0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        x[-1] = min(x[-1], MOST_BIAS)
    return Model({w: float(c) for w, c in zip(vocabulary, x[:-1], strict=True) if abs(c) > 1e-3}, float(x[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences as byte spans of the UTF-8 text."""

    def read(batches):
        for batch in batches:
            rows = [(d, *model.document(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            spans = [[{"start": a, "end": b, "score": c} for a, b, c in r[2]] for r in rows]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    arrow_rows(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(released(read), "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score stays below the threshold, all columns as they are."""
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([model.document(t, False)[0] < threshold for t in texts], pa.bool_()))

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(released(keep), docs.schema)

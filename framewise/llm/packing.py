"""Packing token sequences into as few fixed-size sequences as possible.

Large items (over a third of the capacity) go at most two to a bin: the largest
left takes the largest partner that fits. Smaller items, longest first, go to
the fullest bin that still holds them. Only lengths matter for that, and there
are at most `capacity` of them, so the plan is made on the driver over a
histogram whose size doesn't depend on the corpus: each step places a run of
equal items into a run of equal bins. Documents then find their place by their
rank among pieces of the same length, in parallel.

Nulls and odd input: null or empty text is the end id alone; very long texts are
cut into pieces, whole; null doc_ids and rows that share one are all packed; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, released, written
from .tokens import tokenizer

#: Parts of all lengths together, besides one a length.
MOST_PARTS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """The documents' token runs of at most `capacity` ids: only longer documents are cut."""

    def cut(batches):
        tok = tokenizer(tokenizer_path)
        end = np.array([end_id], tok.dtype).tobytes()
        for batch in batches:
            rows = []
            encoded = tok.encode(batch.column(1).cast(pa.binary()).to_pylist())
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.frombuffer(raw + end, tok.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(cut), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, first bin, items a bin, offset in the bin) for all items, in rank order of each length.

    Slot ranks run on: a slot ends where the next of its length begins. Item
    `r` of a slot lies in bin `first bin + (r - first rank) // items a bin`.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def place(length: int, count: int, base: int, each: int) -> None:
        """`count` items, `each` to a bin, from bin `base`; the bins' gap is known to the caller."""
        slots.append((length, rank[length], base, each, 0))
        rank[length] += count

    # Large items: greedy matching of equal runs, the largest left with the largest that fits.
    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for a in large:
        while left[a]:
            partner = next((b for b in large if b <= capacity - a and left[b] and (b != a or left[a] > 1)), None)
            base = bins
            if partner is None:
                count = left[a]
                place(a, count, base, 1)
                left[a] = 0
                gaps.setdefault(capacity - a, []).append((base, count))
            elif partner == a:
                count = left[a] // 2
                place(a, 2 * count, base, 2)
                left[a] -= 2 * count
                gaps.setdefault(capacity - 2 * a, []).append((base, count))
            else:
                count = min(left[a], left[partner])
                place(a, count, base, 1)
                slots.append((partner, rank[partner], base, 1, a))
                rank[partner] += count
                left[a] -= count
                left[partner] -= count
                gaps.setdefault(capacity - a - partner, []).append((base, count))
            bins += count
    # Smaller items, longest first, each into the smallest gap that holds it.
    for a in sorted((n for n in left if n <= third), reverse=True):
        for gap in sorted(g for g in gaps if g >= a):
            each, runs = gap // a, gaps[gap]
            while left[a] and runs:
                base, count = runs.pop()
                full = min(count, left[a] // each)
                if full:
                    slots.append((a, rank[a], base, each, capacity - gap))
                    rank[a] += full * each
                    left[a] -= full * each
                    gaps.setdefault(gap - each * a, []).append((base, full))
                rest = left[a] if full < count else 0
                if rest:
                    slots.append((a, rank[a], base + full, rest, capacity - gap))
                    rank[a] += rest
                    left[a] = 0
                    gaps.setdefault(gap - rest * a, []).append((base + full, 1))
                if (taken := full + bool(rest)) < count:
                    runs.append((base + taken, count - taken))
            if not left[a]:
                break
        if left[a]:
            each = capacity // a
            full, rest = divmod(left[a], each)
            for count, some in ((full, each), (1 if rest else 0, rest)):
                if count:
                    slots.append((a, rank[a], bins, some, 0))
                    rank[a] += count * some
                    gaps.setdefault(capacity - some * a, []).append((bins, count))
                    bins += count
            left[a] = 0
        gaps = {g: r for g, r in gaps.items() if r and g}
    return sorted(slots)


def pack(found: DataFrame, capacity: int, rows_per_part: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table with doc_id, piece, length).

    Ranks within a length are counted in parts of about `rows_per_part` rows, so
    that a length which a third of all pieces share isn't ranked in one task: one
    in `MOST_PARTS` of all pieces, but 1,000 at least.
    """
    spark = found.sparkSession
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    rows_per_part = rows_per_part or max(1000, sum(histogram.values()) // MOST_PARTS)
    # The parts of all lengths number at most capacity + MOST_PARTS; there is no larger broadcast here.
    parts = spark.createDataFrame([(n, -(-c // rows_per_part)) for n, c in histogram.items()], "_length long, _parts long")
    number = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts"))
    dealt = found.join(F.broadcast(parts), F.col("length") == F.col("_length")).withColumn("_part", number).drop("_length", "_parts")
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inner) - 1).join(F.broadcast(counts), ["length", "_part"])
    ranked = ranked.select(*found.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    shared = spark.sparkContext.broadcast(slots)
    names = [*found.columns, "sequence_id", "offset"]
    at_length, at_rank = found.columns.index("length"), len(found.columns)

    def seat(batches):
        table = shared.value
        order = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at_length, at_rank))
            slot = table[np.searchsorted(order, (length << 45) + rank, "right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            behind = rank - slot[:, 1]
            seats = [slot[:, 2] + behind // np.maximum(slot[:, 3], 1), slot[:, 4] + behind % np.maximum(slot[:, 3], 1) * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in seats)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(seat, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)

"""Exact top-k search by inner product with a table of distances to pivots.

For integer vectors, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and any pivot p
gives d(q, x) >= |d(q, p) - d(x, p)|. The largest of these lower bounds over all
pivots bounds the score from above without touching x. Distances are 64-bit, as a
far pivot's error counts against vectors much smaller than its distance. Candidates
are evaluated in the order of that bound; as soon as the bound falls below the k-th
score known so far, the rest cannot enter and the search of the block stops.

Vectors and queries are written in packed blocks. A few blocks of vectors are
searched first, which gives every query a k-th score to begin with; then each task
takes its blocks of vectors and reads the blocks of queries one after another, so
that no vector is copied or shuffled for a query, and k-th scores carry over from
block to block. The tasks' best are merged at the end.

Nulls and odd input: vectors that are null or hold a null or non-finite
component, and rows with a null vec_id, take no part; shorter vectors count as
padded with zeros, and very long ones are taken whole; rows that share a query's
vec_id are its own; several query rows of one vec_id are answered one by one, each
with ranks of its own; equal scores go by the smaller vec_id, and rows that agree
in both are all candidates; with fewer than k candidates all are returned;
components or scores beyond 64 bits raise an OverflowError; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .common import arrow_rows, gathered, new_dir, written

PACKED = "block long, ids binary, vectors binary, distances binary"
#: A block of queries with the best of the first search: how many each has, and those.
ASKED = PACKED + ", counts binary, best_ids binary, best_scores binary"
FOUND = "asked long, query_id long, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * component) for vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return part.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def exact_dtype(a: np.ndarray, b: np.ndarray):
    """The cheapest type in which all inner products of rows of two int64 matrices are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def as_scores(products: np.ndarray) -> np.ndarray:
    """Products in an exact type as int64; an error where that can't hold them."""
    if products.dtype == object and products.size and not -(2**63) <= products.min() <= products.max() < 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return products.astype(np.int64)


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of `count` rows."""
    if not len(sample):
        return sample
    points, chosen = sample.astype(np.float64), [0]
    nearest = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row to each pivot."""
    v, pivots = v.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (v @ pivots.T), 0))


def packed(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Blocks of at most `size` vectors with their distances to the pivots."""
    width = pivots.shape[1]

    def pack(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(gathered(batches, size)):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = np.zeros((len(ids), width), np.int64)
            for i, x in enumerate(batch.column(1)):
                x = x.values.to_numpy(zero_copy_only=False)
                v[i, : len(x)] = x
            yield pa.RecordBatch.from_pydict({"block": [(task << 24) + number], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "distances": [distances(v, pivots).tobytes()]})

    arrow_rows(rows.sparkSession)
    return rows.mapInArrow(pack, PACKED)


class Block:
    """A packed block, unpacked; `number` is its own."""

    def __init__(self, row: dict, width: int):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), width)
        self.distances = np.frombuffer(row["distances"], np.float64).reshape(len(self.ids), -1)


class Best:
    """The k best (score, vec_id) of each query so far; `least`: scores below it are known not to count."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k, self.least = k, least
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0, np.int64)] * queries

    def kth(self, i: int) -> float:
        own = self.scores[i][-1] if len(self.scores[i]) >= self.k else -np.inf
        return own if self.least is None else max(own, self.least[i])

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]


def search_block(best: Best, q_ids, q, q_far, ids, x, far, step: int = 256) -> int:
    """Let one block of candidates meet the queries; how many scores were computed."""
    evaluated, columns, kind = 0, np.ascontiguousarray(far.T), exact_dtype(q, x)
    exact_x, exact_q = x.astype(kind), q.astype(kind)
    x_sq, q_sq = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    # Few queries at a time, so that their bounds stay in the processor's cache.
    away = np.empty((16, len(x)))
    for at in range(0, len(q), 16):
        some = slice(at, min(at + 16, len(q)))
        low, way = np.zeros((some.stop - at, len(x))), away[: some.stop - at]
        for p in range(far.shape[1]):
            np.subtract(q_far[some, p, None], columns[p], out=way)
            np.abs(way, out=way)
            np.maximum(low, way, out=low)
        total = q_sq[some, None] + x_sq[None, :]
        bound = np.floor((total - low**2) / 2 + 1e-5 * total + 1e-3)
        for j in range(some.stop - at):
            i = at + j
            left = np.flatnonzero(bound[j] >= best.kth(i))
            if not len(left):
                continue
            order = left[np.argsort(-bound[j][left], kind="stable")]
            start, width = 0, max(step, best.k)
            while start < len(order) and bound[j][order[start]] >= best.kth(i):
                part = order[start : start + width]
                scores = as_scores(exact_x[part] @ exact_q[i])
                evaluated += len(part)
                good = (scores >= best.kth(i)) & (ids[part] != q_ids[i])
                if good.any():
                    best.add(i, ids[part][good], scores[good])
                start += len(part)
                width *= 2
    return evaluated


def _first_search(asked: DataFrame, base_path: str, first: int, k: int, width: int) -> DataFrame:
    """The blocks of queries with their best among the vectors of the blocks up to number `first`."""

    def read(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            own = Block(row, width)
            best = Best(len(own.ids), k)
            for x in storage.parquet_rows(base_path, pc.field("block") <= first):
                x = Block(x, width)
                search_block(best, own.ids, own.vectors, own.distances, x.ids, x.vectors, x.distances)
            row |= {"counts": np.array([len(x) for x in best.ids], np.int64).tobytes(), "best_ids": np.concatenate(best.ids).tobytes(), "best_scores": np.concatenate(best.scores).tobytes()}
            yield pa.RecordBatch.from_pylist([row])

    return asked.mapInArrow(read, ASKED)


def _best_rows(blocks: Iterator[tuple[Block, list, list]]) -> Iterator[pa.RecordBatch]:
    """Rows of `FOUND`; a query row is told from others by its block and its place there."""
    for own, ids, scores in blocks:
        times = [len(x) for x in ids]
        columns = [np.repeat((own.number << 24) + np.arange(len(own.ids)), times), np.repeat(own.ids, times), np.concatenate(ids), np.concatenate(scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["asked", "query_id", "vec_id", "score"])


def _known(row: dict) -> tuple[list, list]:
    """The best of the first search, query by query."""
    cuts = np.cumsum(np.frombuffer(row["counts"], np.int64))[:-1]
    return np.split(np.frombuffer(row["best_ids"], np.int64), cuts), np.split(np.frombuffer(row["best_scores"], np.int64), cuts)


def _second_search(base: DataFrame, asked_path: str, k: int, width: int, held: int) -> DataFrame:
    """The best of each query among the blocks of a task, taken `held` at a time, where they reach the query's k-th score of the first search."""

    def read(batches):
        def answers(blocks: list[Block]):
            for row in storage.parquet_rows(asked_path):
                own, (_, scores) = Block(row, width), _known(row)
                least = np.array([s[-1] if len(s) >= k else -np.inf for s in scores])
                best = Best(len(own.ids), k, least)
                for x in blocks:
                    search_block(best, own.ids, own.vectors, own.distances, x.ids, x.vectors, x.distances)
                yield own, best.ids, best.scores

        blocks: list[Block] = []
        for row in (r for batch in batches for r in batch.to_pylist()):
            blocks.append(Block(row, width))
            if len(blocks) == held:
                yield from _best_rows(answers(blocks))
                blocks = []
        if blocks:
            yield from _best_rows(answers(blocks))

    return base.mapInArrow(read, FOUND)


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 32, block: int = 4096, query_block: int = 1024, first_blocks: int = 2, held: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row for which `is_query` holds."""
    spark = rows.sparkSession
    own = quantised(rows, scale)
    size = rows.filter("vec_id is not null and embedding is not null").select(F.size("embedding").alias("n"), F.array_max(F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), F.abs(x.cast("double"))))).alias("most")).agg(F.max("n"), F.max("most")).first()
    width = max(1, size[0] or 1)
    if (size[1] or 0) * scale >= 2**63:
        raise OverflowError("a component is beyond 64 bits")
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1024).collect()
    table = np.zeros((max(1, len(sample)), width), np.int64)
    for i, r in enumerate(sample):
        table[i, : len(r.v)] = r.v
    chosen = spread_out(table, pivots)
    base_path, asked_path = new_dir(spark, "vectors"), new_dir(spark, "queries")
    packed(own, chosen, block).write.parquet(base_path)
    base = spark.read.schema(PACKED).parquet(base_path)
    numbers = [r.block for r in base.select("block").orderBy("block").limit(first_blocks).collect()]
    first = numbers[-1] if numbers else -1
    _first_search(packed(own.filter(is_query), chosen, query_block), base_path, first, k, width).write.parquet(asked_path)
    asked = spark.read.schema(ASKED).parquet(asked_path)
    rest = base.filter(F.col("block") > first)
    blocks = rest.count()
    # Each task reads all queries: no more tasks than keep the cores busy, once they hold `held` blocks.
    rest = rest.repartition(max(1, min(blocks, spark.sparkContext.defaultParallelism), blocks // held), "block")
    known = asked.mapInArrow(lambda batches: _best_rows((Block(r, width), *_known(r)) for batch in batches for r in batch.to_pylist()), FOUND)
    found = known.unionByName(_second_search(rest, asked_path, k, width, held))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = written(found, "found").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

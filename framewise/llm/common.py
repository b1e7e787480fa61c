"""Shared helpers: reading tables, bounding Arrow batches and workers' memory, dropping rows by id."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, new_dir, shared_dir, written
from ..shipping import ship

__all__ = ["arrow_rows", "discard", "drop_ids", "gathered", "kept", "new_dir", "released", "shared_dir", "table", "text_or_empty", "tidy", "trim", "unused_prefix", "written"]

#: Rows of text in one Arrow batch: bounds a Python worker's memory together with Spark's byte limit.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession) -> None:
    """Send the package to the executors and bound the rows of the Arrow batches that Python functions get.

    Plans run later than they are made, so all operators share one bound, which is
    lowered once for the session and never raised; who wants larger batches
    gathers them.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows`, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def text_or_empty(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unused_prefix(df: DataFrame) -> str:
    """A beginning that no column of `df` has, for helper columns."""
    found = "_"
    while any(c.lower().startswith(found) for c in df.columns):
        found += "_"
    return found


def trim() -> None:
    """Give this worker's free memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def released(read: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A reader of Arrow batches that trims when it has ended."""

    @wraps(read)
    def run(batches: Iterator) -> Iterator:
        yield from read(batches)
        trim()

    return run


_kept: dict = {}


def kept(name: Hashable, make: Callable):
    """What a worker keeps from task to task: one thing, let go when a task asks for another."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def tidy(reduce: Callable) -> Callable:
    """A function of a group that trims after each."""

    def run(group):
        out = reduce(group)
        trim()
        return out

    return run


#: Ids that are broadcast at most: 8 bytes each, with their hash table under 64 MB.
BROADCAST_IDS = 2_000_000


def drop_ids(docs: DataFrame, lost: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose doc_id isn't among the ids of a written one-column table.

    Up to `most` ids are counted and broadcast, so texts stay where they are
    read; more are joined by a shuffle.
    """
    name = lost.columns[0]
    side = F.broadcast(lost) if lost.count() <= most else lost
    return docs.join(side, F.col("doc_id") == F.col(name), "left_anti")

"""Exact duplicates by digest, with a split for digests that are very frequent.

Every text is reduced to its SHA-256 where it is read. A Misra-Gries summary of
each partition names the digests that may be frequent; their exact counts and
winners are then counted, and the winners, at most `counters` rows, are
broadcast so that members of large groups are settled where they are read. All
other digests are shuffled, and none of their groups is large.

Nulls and odd input: a null text counts as empty, and empty texts equal each
other; very long texts are reduced to their digest whole; of equal texts the largest doc_id stays, a null doc_id being smaller than
any; of rows with equal text and equal doc_id, one stays for `drop_copies`, and
all count in group_size; an empty table gives no rows; other columns are
ignored, or kept by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop_ids, text_or_empty, unused_prefix, written

DIGEST = "_dedup_digest"


def digests(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id and the 32-byte SHA-256 of each text, normalised if asked."""
    text = text_or_empty()
    text = normalise(text) if normalise else text
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias(DIGEST))


class MisraGries:
    """Counts of keys that may be frequent, each too low by at most n / (counters + 1) after n keys."""

    def __init__(self, counters: int):
        self.counters, self.held = counters, {}

    def add(self, keys) -> None:
        held = self.held
        for key in keys:
            if key in held:
                held[key] += 1
            elif len(held) < self.counters:
                held[key] = 1
            else:
                self.held = held = {k: v - 1 for k, v in held.items() if v > 1}


def frequent(hashed: DataFrame, counters: int = 1024) -> DataFrame:
    """Exact winner and size of at most `counters` groups, every very frequent one among them.

    A digest of more than 2 * rows / counters members, and one more a partition,
    is always named; that others are left to the ordinary shuffle loses nothing.
    """

    def summary(batches):
        found = MisraGries(counters)
        for batch in batches:
            found.add(batch.column(0).to_pylist())
        held = {k: v for k, v in found.held.items() if v > 1}
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], [DIGEST, "n"])

    arrow_rows(hashed.sparkSession)
    named = hashed.select(DIGEST).mapInArrow(summary, f"{DIGEST} binary, n long").groupBy(DIGEST).agg(F.sum("n").alias("n"))
    named = named.orderBy(F.desc("n"), DIGEST).limit(counters).select(DIGEST)
    exact = hashed.join(F.broadcast(named), DIGEST).groupBy(DIGEST)
    return exact.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def decide(hashed: DataFrame, counters: int = 1024) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row of a written table of digests."""
    winners = written(frequent(hashed, counters), "dedup-winners")
    heavy = hashed.join(F.broadcast(winners), DIGEST)
    rest = hashed.join(F.broadcast(winners.select(DIGEST)), DIGEST, "left_anti")
    group = Window.partitionBy(DIGEST)
    rest = rest.withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count("*").over(group)})
    return heavy.unionByName(rest)


def mark_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = decide(written(digests(docs, normalise), "digests"), counters)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(DIGEST)).alias("text_sha256"))


def drop_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = 1024) -> DataFrame:
    """The documents without the rows that lose against an equal text.

    Where doc_ids tell rows apart, what must go is a table of ids, and the texts
    stay where they are read unless there are too many to broadcast. Otherwise rows go by id and digest.
    """
    pre = unused_prefix(docs)
    lost_id, lost_digest, own_digest, number = (pre + c for c in ("lost_id", "lost_digest", "digest", "number"))
    found = decide(written(digests(docs, normalise), "digests"), counters)
    found = written(found.select("doc_id", DIGEST, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "dedup-kept")
    lost = found.filter(~F.col("kept")).select(F.col("doc_id").alias(lost_id), F.col(DIGEST).alias(lost_digest))
    if found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return drop_ids(docs, lost.select(lost_id))
    text = text_or_empty()
    text = normalise(text) if normalise else text
    own = docs.withColumn(own_digest, F.unhex(F.sha2(text.cast("binary"), 256)))
    kept = own.join(lost, F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(own_digest) == F.col(lost_digest)), "left_anti")
    # Rows that agree in id and text: one of them, combined where they are read before they meet.
    twice = found.filter("kept").groupBy("doc_id", DIGEST).count().filter("count > 1").select(F.col("doc_id").alias(lost_id), F.col(DIGEST).alias(lost_digest))
    twice = written(twice, "dedup-repeated")
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(own_digest) == F.col(lost_digest))
    one = kept.join(twice, same, "left_semi").groupBy("doc_id", own_digest).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(number)).select(f"{number}.*")
    return kept.join(twice, same, "left_anti").drop(own_digest).unionByName(one)

"""Mixing sources to target weights by temperature, with Spark expressions only.

Source i holds a share p_i of all tokens; its weight is p_i^a / sum(p_j^a). The
exponent a in [0, 1] is bisected until the weights meet a target entropy, or are
as even as a limit on repetition allows. A token budget times a weight is a
source's target: whole passes over the source, and a part of one more. The
exponent needs all shares at once: they are one row's array, a few dozen bytes a
source, never a document.

Every pass over a source is a permutation of its documents by a hash. The part
pass takes documents in that order while the target holds, found without sorting
a source: sums of 1,024 ranges of the hash give the range where the target is
reached, that range is cut into 1,024 again as often as rows are many, and only
the last range, at most some thousands of rows of a source, is summed row by row.
Each output block takes the same fraction of every source's stream, so that
blocks have the target mix.

Nulls and odd input: null text is empty, null source is a source of its own; a
document's tokens are its words and one end, so empty texts count; rows that
agree in source and doc_id stand and fall together; a null doc_id is an id like
others; very long texts count whole; an empty table gives no rows; other columns are ignored, or kept by
`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, unused_prefix, written

#: Ranges that one step cuts a range of the hash into: 2 ** STEP_BITS.
STEP_BITS = 10
#: Rows of a source's last range, if hashes are even.
LAST_ROWS = 4096
ROUNDS = 60


def _source_key() -> Column:
    """A non-null text for each source, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def word_tokens() -> Column:
    """Words of the text, and one for the end."""
    return (F.regexp_count(text_or_empty(), F.lit(r"\S+")) + 1).cast("long")


def _key(seed: int, number: Column) -> Column:
    """The place of a document in a pass over its source."""
    return F.xxhash64(F.lit(seed), number.cast("int"), F.col("doc_id"))


def _range(key: Column, bits: int) -> Column:
    """The first bits of a hash, as a number."""
    return F.shiftrightunsigned(key, 64 - bits)


def weights(counted: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """key, tokens, weight, target (tokens), exponent per source.

    `entropy`: nats that the weights should have (met as far as shares allow).
    `repetition`: most passes over a source per pass over the least repeated
    one; or, with a `budget`, most passes over any source. Without a budget it is
    the smallest that uses every document once. Where even the sources' own
    shares exceed the limit under the given budget, the exponent is 1.
    """
    if (repetition is None) == (entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    by_source = counted.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    row = by_source.agg(F.array_sort(F.collect_list(F.struct("key", "tokens"))).alias("s"), F.sum("tokens").alias("total")).filter("total > 0")
    shares = F.transform("s", lambda x: x["tokens"].cast("double") / F.col("total"))
    row = row.withColumn("p", shares)

    def added(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def at(a: Column) -> Column:
        """Whether the exponent is large enough (weights uneven enough)."""
        powers = F.transform("p", lambda p: F.pow(p, a))
        total = added(powers)
        if entropy is not None:
            h = added(F.transform("p", lambda p: -(F.pow(p, a) / total) * (a * F.log(p) - F.log(total))))
            return h <= F.lit(float(entropy))
        passes = F.transform("p", lambda p: F.pow(p, a - 1.0) / total)
        least = F.lit(float(budget)) / F.col("total") if budget is not None else 1.0 / F.array_min(passes)
        return F.array_max(passes) * least <= F.lit(float(repetition) * (1 + 1e-12))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(at(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    bisected = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)
    row = row.withColumn("exponent", F.when(at(F.lit(0.0)), F.lit(0.0)).otherwise(bisected["hi"]))
    row = row.withColumn("powers", F.transform("p", lambda p: F.pow(p, F.col("exponent"))))
    row = row.withColumn("norm", added(F.col("powers")))
    need = F.array_max(F.transform("s", lambda x, i: x["tokens"].cast("double") * F.col("norm") / F.col("powers")[i]))
    row = row.withColumn("budget", F.lit(float(budget)) if budget is not None else need)
    one = row.select("exponent", "norm", "budget", F.posexplode("s").alias("i", "x"), "powers")
    weight = F.col("powers")[F.col("i")] / F.col("norm")
    return one.select(F.col("x.key").alias("key"), F.col("x.tokens").alias("tokens"), weight.alias("weight"), F.round(F.col("budget") * weight).cast("long").alias("target"), "exponent")


def cuts(counted: DataFrame, weighed: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """key, weight, whole (passes), stream (passes, with the part) and where the part pass ends: range, hash and doc_id; and the bits of a range."""
    part = weighed.select("key", "weight", (F.col("target") / F.col("tokens")).alias("stream"), F.expr("target div tokens").cast("int").alias("whole"), F.expr("target % tokens").alias("rest"))
    own = counted.join(part.filter("rest > 0").select("key", "whole", "rest"), "key").withColumn("hash", _key(seed, F.col("whole")))
    steps = max(1, math.ceil(math.log2(max(1, counted.count()) / LAST_ROWS) / STEP_BITS))
    # The range where the target is reached, cut again and again; `before` is what the ranges before it hold.
    edge = part.filter("rest > 0").select(F.col("key").alias("of"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before"))
    inside = own.join(edge, F.col("key") == F.col("of"))
    for bits in range(STEP_BITS, steps * STEP_BITS + 1, STEP_BITS):
        sums = inside.withColumn("range", _range(F.col("hash"), bits)).groupBy("key", "range", "rest", "before").agg(F.sum("tokens").alias("sum"))
        upto = F.col("before") + F.sum("sum").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        reached = sums.withColumn("upto", upto).filter("upto > rest and upto - sum <= rest")
        edge = written(reached.select(F.col("key").alias("of"), F.col("range").alias("edge"), (F.col("upto") - F.col("sum")).alias("before")), "mix-edges")
        inside = own.join(edge, (F.col("key") == F.col("of")) & (_range(F.col("hash"), bits) == F.col("edge")))
    # A frame by value: rows that agree in hash and doc_id are summed together.
    reached = F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("hash", "doc_id").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("reached", reached).filter("reached <= rest").groupBy("key").agg(F.max(F.struct("hash", "doc_id")).alias("last"))
    return part.join(edge.select(F.col("of").alias("key"), "edge"), "key", "left").join(last, "key", "left"), steps * STEP_BITS


def realised(docs: DataFrame, cut: DataFrame, bits: int, seed: int) -> tuple[DataFrame, str]:
    """`docs` (with doc_id and source) once for each pass that takes the row; helper columns pass, hash and stream have the prefix returned."""
    pre = unused_prefix(docs)
    held = {c: F.col(pre + c) for c in ("whole", "stream", "edge", "last", "pass")}
    own = docs.withColumn(pre + "key", _source_key())
    own = own.join(cut.select(*(F.col(c).alias(pre + c) for c in ("key", "whole", "stream", "edge", "last"))), pre + "key")
    hash_ = _key(seed, held["whole"])
    range_ = _range(hash_, bits)
    last = held["last"]
    before = (hash_ < last["hash"]) | ((hash_ == last["hash"]) & (F.coalesce(F.col("doc_id") <= last["doc_id"], F.col("doc_id").isNull())))
    taken = (range_ < held["edge"]) | ((range_ == held["edge"]) & F.coalesce(before, F.lit(False)))
    passes = held["whole"] + F.coalesce(taken, F.lit(False)).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(passes, F.lit(1))), lambda i: i < passes)
    own = own.withColumn(pre + "pass", F.explode(numbers)).withColumn(pre + "hash", _key(seed, held["pass"]))
    return own, pre


def _prepared(docs: DataFrame, seed: int, **target) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    counted = written(docs.select("doc_id", "source", _source_key().alias("key"), word_tokens().alias("tokens")), "mix-tokens")
    weighed = written(weights(counted, **target), "mix-weights")
    cut, bits = cuts(counted, weighed, seed)
    return counted, weighed, written(cut, "mix-cuts"), bits


def plan_mix(docs: DataFrame, seed: int = 17, block_tokens: int = 1 << 20, **target) -> DataFrame:
    """doc_id, source, pass, block, order_key, tokens of every document taken; order by block and order_key is the mixed order."""
    counted, weighed, cut, bits = _prepared(docs, seed, **target)
    budget = weighed.agg(F.sum("target")).first()[0] or 0
    blocks = max(1, math.ceil(budget / block_tokens))
    own, pre = realised(counted, cut, bits, seed)
    # The hash as a fraction of the pass, its sign bit turned so that ranges ascend.
    fraction = F.shiftrightunsigned(pre + "hash", 11).cast("double") / float(1 << 53)
    block = F.least(F.floor((F.col(pre + "pass") + fraction) / F.col(pre + "stream") * blocks), F.lit(blocks - 1)).cast("long")
    return own.select("doc_id", "source", F.col(pre + "pass").alias("pass"), block.alias("block"), F.xxhash64(F.lit(seed + 1), pre + "pass", "doc_id").alias("order_key"), "tokens")


def mix(docs: DataFrame, seed: int = 17, **target) -> DataFrame:
    """The documents' rows, each as often as the mix takes it."""
    _, _, cut, bits = _prepared(docs, seed, **target)
    return realised(docs, cut, bits, seed)[0].select(*(F.col(f"`{c}`") for c in docs.columns))

"""Exact order statistics by refining histograms.

The rank that a fraction asks for is looked for in rounds. A round counts values
by bin, within the ranges that still hold a wanted rank, and gives each bin's
least and largest value; the bin with the rank is the next range. The first bins
are powers of two, the later ones 1,024 equal parts of a range, so a double is
reached in seven rounds at most, and mostly a range is so small after two that
its values are taken as they are. A task keeps a count for each bin and never the
values, and the driver gets a bounded number of rows a round, whatever the data.

Nulls are no values; NaN is larger than any number; a column without values has
no statistics (None).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a range in a round, and values that are taken as they are.
BINS, FEW = 1024, 2048


@dataclass
class Range:
    """Values of a column between two, both in, with their number and how many come before."""

    column: str
    low: float
    high: float
    count: int
    before: int

    def holds(self, rank: int) -> bool:
        return self.before <= rank < self.before + self.count

    def settled(self) -> bool:
        return self.low == self.high or math.isnan(self.low)


def _octave(v: Column) -> Column:
    """A number that rises with the value: its power of two, negative values and zero in between; NaN last."""
    power = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0))) + 2000
    return F.when(F.isnan(v), 10_000).when(v == 0, 0).when(v > 0, power).otherwise(-power).cast("int")


def _histogram(values: DataFrame, columns: list[str], of_range: dict[str, list[Range]] | None) -> list[tuple]:
    """(column, range, bin, count, least, largest) of the bins, one job for all columns."""
    parts = []
    for name in columns:
        v = F.col(name).cast("double")
        if of_range is None:
            place, bin_ = F.when(v.isNotNull(), F.lit(0)), _octave(v)
        else:
            place, bin_ = F.lit(None).cast("int"), F.lit(0)
            for k, r in enumerate(of_range[name]):
                inside = (v >= r.low) & (v <= r.high)
                part = F.least(F.floor((v - F.lit(r.low)) / F.lit(r.high - r.low) * BINS).cast("int"), F.lit(BINS - 1))
                place, bin_ = F.when(inside, k).otherwise(place), F.when(inside, part).otherwise(bin_)
        parts.append(F.struct(F.lit(name).alias("name"), place.alias("place"), bin_.alias("bin"), v.alias("v")))
    rows = values.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("place is not null")
    found = rows.groupBy("name", "place", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return sorted(tuple(r) for r in found.collect())


def _taken(values: DataFrame, ranges: list[Range]) -> dict[int, list[float]]:
    """The values of small ranges, by their number, in order."""
    parts = [F.struct(F.lit(k).alias("k"), F.when((F.col(r.column) >= r.low) & (F.col(r.column) <= r.high), F.col(r.column).cast("double")).alias("v")) for k, r in enumerate(ranges)]
    found: dict[int, list[float]] = {}
    for row in values.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("v is not null").collect():
        found.setdefault(row.k, []).append(row.v)
    return {k: sorted(v) for k, v in found.items()}


def select_ranks(values: DataFrame, wanted: dict[str, list]) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """Numbers of values, and the value of each (column, rank); `wanted` has functions from a column's number of values to ranks (from 0).

    `values` is read several times and should be a written table.
    """
    columns = [*wanted]
    counts = dict.fromkeys(columns, 0)
    ranges: dict[str, list[Range]] = {c: [] for c in columns}
    for name, _, _, n, low, high in _histogram(values, columns, None):
        ranges[name].append(Range(name, low, high, n, counts[name]))
        counts[name] += n
    ranks = {(c, rank) for c in columns if counts[c] for f in wanted[c] for rank in f(counts[c])}
    holding = {(c, rank): next(r for r in ranges[c] if r.holds(rank)) for c, rank in ranks}
    while True:
        open_ = {id(r): r for r in holding.values() if not r.settled() and r.count > FEW}
        if not open_:
            break
        of_range = {c: [r for r in open_.values() if r.column == c] for c in columns}
        own = [c for c in columns if of_range[c]]
        finer: dict[int, list[Range]] = {k: [] for k in open_}
        for name, place, _, n, low, high in _histogram(values, own, of_range):
            r = of_range[name][place]
            before = r.before + sum(x.count for x in finer[id(r)])
            finer[id(r)].append(Range(name, low, high, n, before))
        holding = {key: next(x for x in finer[id(r)] if x.holds(key[1])) if id(r) in open_ else r for key, r in holding.items()}
    small = [*{id(r): r for r in holding.values() if not r.settled()}.values()]
    taken = _taken(values, small) if small else {}
    place = {id(r): k for k, r in enumerate(small)}
    return counts, {key: r.low if r.settled() else taken[place[id(r)]][key[1] - r.before] for key, r in holding.items()}


def percentiles(values: DataFrame, wanted: dict[str, tuple[float, ...]]) -> dict[str, list[float | None]]:
    """Each column's percentiles at the given fractions, between two values in proportion; exact, as `percentile` gives them."""

    def ranks_of(p: float):
        return lambda n: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))

    counts, found = select_ranks(values, {c: [ranks_of(p) for p in ps] for c, ps in wanted.items()})
    out: dict[str, list[float | None]] = {}
    for c, ps in wanted.items():
        out[c] = []
        for p in ps:
            if not counts[c]:
                out[c].append(None)
                continue
            at = p * (counts[c] - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out

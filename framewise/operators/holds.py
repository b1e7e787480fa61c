"""Vehicles held over short misses, and motorcycles restored after two shared one box.

Only the linking of observations to chains is sequential; its state is the open
chains, each with its last box. The rest is relational: what a chain holds is a
window over it and a sequence over its gaps; a motorcycle that comes out of a wide
box is a band join of motorcycles with earlier boxes, and another with what was
seen since; all of them go to their frames in order, where a fold over one frame's
boxes decides what is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import geometry as g
from ..schema import CONFUSED, DEFAULTS, MOTO, Params
from . import associate
from .tracking import XYXY, apart, cut_where, distance_over, in_segments, linkable, with_mark

# How much larger a box of two is; the largest share of a sibling, and of a box that is there already; least area of a remainder.
WIDER, SIBLING, TAKEN, LEAST_REST = 1.25, 0.45, 0.45, 256.0
BOX = g.Box._fields
#: Side of a cell of the grid in pixels.
CELL = 256
#: What a frame's list holds, and what may be added to it: by rank, unless a box of its class shares `least`.
ITEM = "struct<ord:int,cls:int,x1:int,y1:int,x2:int,y2:int,conf:double,held:boolean>"
RANK = ("of_split", "k1", "k2", "k3", "k4", "k5")


class Open(NamedTuple):
    """The end of a chain that may go on."""

    frame: int
    cls: int
    box: XYXY


class Linker:
    """Chains of each group of classes: an observation goes to the nearest open chain that it fits, the older among equals."""

    def __init__(self, p: Params):
        self.p = p
        self.groups: dict[int, int] = {}
        self.open: list[dict[int, Open]] = []
        self.made: list[int] = []

    def step(self, frame: int, vehicles: list[tuple[int, XYXY]]) -> Iterator[tuple[int, int]]:
        """(group, chain) of each of a frame's vehicles (class, box); groups are numbered as they appear."""
        for own in self.open:
            for chain in [c for c, end in own.items() if frame - end.frame - 1 > self.p.max_gap]:
                del own[chain]
        for cls, box in vehicles:
            group = self.groups.setdefault(MOTO if cls in CONFUSED else cls, len(self.open))
            if group == len(self.open):
                self.open.append({})
                self.made.append(0)
            own = self.open[group]
            fit = [(apart(end.box, box), c) for c, end in own.items() if linkable(end.cls, end.box, cls, box, end.box, box, frame - end.frame - 1, self.p)]
            chain = min(fit)[1] if fit else self.made[group]
            self.made[group] += not fit
            own[chain] = Open(frame, cls, box)
            yield group, chain


def hold_segments(frames: DataFrame, vehicles: DataFrame, p: Params) -> DataFrame:
    """video_id, frame, segment: a new one begins after a frame with vehicles where more than max_gap frames without any follow."""
    own = with_mark(frames.select("video_id", "frame").distinct(), vehicles, "_v")
    return cut_where(own, lambda order: F.lag("_v").over(order) & (F.coalesce(distance_over(F.col("_v"), order), F.lit(p.max_gap + 2)) > p.max_gap + 1))


def chained(cut: DataFrame, vehicles: DataFrame, p: Params) -> DataFrame:
    """The vehicles with their place in the frame (n), group and chain, by segments (video_id, frame, segment)."""
    rows = cut.join(associate.vehicle_arrays(vehicles), ["video_id", "frame"])

    def begin():
        linker = Linker(p)

        def step(frame, vehicles=()):
            if frame is None:
                return []
            links = linker.step(frame, [(cls, (x1, y1, x2, y2)) for cls, x1, y1, x2, y2, _ in vehicles])
            return [(frame, n, *v, *link) for n, (v, link) in enumerate(zip(vehicles, links, strict=True))]

        return step

    return in_segments(rows, "frame int, n int, cls int, x1 int, y1 int, x2 int, y2 int, conf double, grp int, chain int", {"vehicles": ("cls", *BOX, "conf")}, begin)


def _candidates(rows: DataFrame, cls: Column, box: g.Box, conf: Column, least: float, *rank: Column) -> DataFrame:
    return rows.select("video_id", "frame", *(r.cast("int").alias(n) for n, r in zip(RANK, rank, strict=True)), cls.cast("int").alias("cls"), *(c.alias(n) for n, c in zip(BOX, box, strict=True)), conf.alias("conf"), F.lit(least).alias("least"))


def _mixed(a: Column, b: Column, t: Column) -> Column:
    return a * (F.lit(1.0) - t) + b * t


def held_by_chains(rows: DataFrame, p: Params) -> DataFrame:
    """Candidates of chains: a chain with a motorcycle is one throughout, where sure enough; gaps are filled on the way from one box to the next."""
    chain = Window.partitionBy("video_id", "segment", "grp", "chain")
    after = F.lead(F.struct("frame", *BOX, "conf")).over(chain.orderBy("frame", "n"))
    own = rows.withColumns({"moto": F.max(F.col("cls") == MOTO).over(chain), "after": after, "at": F.col("frame")})
    zero = F.lit(0)
    again = own.filter("moto").filter((F.col("cls") != MOTO) & (F.col("conf") >= p.moto_min_conf))
    again = _candidates(again, F.lit(MOTO), g.columns(), F.col("conf"), p.min_vehicle_iou, zero, F.col("grp"), F.col("chain"), zero, F.col("at"), F.col("n"))
    gaps = own.filter("after.frame > frame + 1").withColumn("frame", F.explode(F.sequence(F.col("at") + 1, F.col("after.frame") - 1)))
    t = (F.col("frame") - F.col("at")) / (F.col("after.frame") - F.col("at"))
    cls, conf = F.when(F.col("moto"), MOTO).otherwise(F.col("cls")), _mixed(F.col("conf"), F.col("after.conf"), t)
    gaps = gaps.filter((cls != MOTO) | (conf >= p.moto_min_conf))
    gaps = _candidates(gaps, cls, g.lerp(g.columns(), g.fields(F.col("after")), t), conf, p.min_vehicle_iou, zero, F.col("grp"), F.col("chain"), F.lit(1), F.col("at"), F.col("n"))
    return again.unionByName(gaps)


def _in_buckets(rows: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    """Rows once for each bucket of frames that a range of frames touches."""
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(first / width).cast("int"), F.floor(last / width).cast("int"))))


def held_by_splits(vehicles: DataFrame, p: Params) -> DataFrame:
    """Candidates of splits: a motorcycle whose centre lay in an earlier, wider box, of which another vehicle since took one side, comes from the other side.

    A look-back reaches over max_gap + 1 frames, so rows are joined on buckets of
    that width: a motorcycle goes to the two that its look-back touches, every
    earlier box to its own, and to the cells of a grid that it covers, of which the
    motorcycle's centre lies in one. So each pair meets once.
    """
    width = p.max_gap + 1
    # Whole numbers as doubles: their arithmetic needs no checks, which keeps the joins' generated code small.
    few = vehicles.filter(F.col("cls").isin(*CONFUSED)).withColumns({c: F.col(c).cast("double") for c in BOX})
    side = lambda c, keep: few.select("video_id", *(F.col(x).alias(f"{c}_{x}") for x in ("frame", "ord", *keep)))
    moto, wide, other = (g.columns(f"{c}_") for c in "cab")
    motos = side("c", (*BOX, "conf", "cls")).filter(F.col("c_cls") == MOTO).drop("c_cls")
    cell = lambda x, y: F.struct(F.floor(x / CELL).cast("int").alias("x"), F.floor(y / CELL).cast("int").alias("y"))
    motos = motos.withColumn("cell", cell(*g.centre(moto)))
    low, high = cell(wide.x1, wide.y1), cell(wide.x2, wide.y2)
    covered = F.flatten(F.transform(F.sequence(low["x"], high["x"]), lambda x: F.transform(F.sequence(low["y"], high["y"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    proper = (F.col("a_x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("a_y2"))
    wides = side("a", (*BOX, "conf")).filter(proper).withColumns({"bucket": F.floor(F.col("a_frame") / width).cast("int"), "cell": F.explode(covered)})
    gap = F.col("c_frame") - F.col("a_frame") - 1
    plausible = lambda a: g.motion_ok(a, moto, gap, moto, p.max_disp_px, p.max_disp_frac)
    pairs = _in_buckets(motos, F.col("c_frame") - width, F.col("c_frame") - 2, width).join(wides, ["video_id", "bucket", "cell"])
    pairs = pairs.filter(gap.between(1, p.max_gap) & g.centre_in(moto, wide) & (g.area(wide) >= g.area(moto) * WIDER) & plausible(wide)).drop("bucket", "cell")
    others = side("b", BOX).withColumn("bucket", F.floor(F.col("b_frame") / width).cast("int"))
    since = _in_buckets(pairs, F.col("a_frame") + 1, F.col("c_frame"), width).join(others, ["video_id", "bucket"])
    since = since.filter(F.col("b_frame").between(F.col("a_frame") + 1, F.col("c_frame")) & (g.iou(other, moto) < SIBLING) & (g.centre_in(other, wide) | (g.iou(other, wide) >= p.min_vehicle_iou)))
    # The first of them, as one number, so that it is found by hashing; its box is looked up.
    at = F.shiftleft(F.col("b_frame").cast("long"), 32) + F.col("b_ord")
    first = since.groupBy(*pairs.columns).agg(F.min(at).alias("at"))
    first = first.join(others.select("video_id", at.alias("at"), *(f"b_{e}" for e in BOX)), ["video_id", "at"]).withColumn("rest", g.remainder(wide, other, 16.0)).filter("rest is not null")
    rest = g.fields(F.col("rest"))
    first = first.filter((g.area(rest) >= LEAST_REST) & plausible(rest))
    # The nearest box, the first of its frame.
    best = first.groupBy("video_id", "c_frame", "c_ord").agg(F.min(F.struct((-F.col("a_frame")).alias("near"), "a_ord", "a_frame", "rest", "a_conf", *(f"c_{e}" for e in BOX), "c_conf")).alias("x"))
    best = best.select("video_id", "c_frame", "c_ord", "x.*").withColumn("frame", F.explode(F.sequence(F.col("a_frame") + 1, F.col("c_frame") - 1)))
    t = (F.col("frame") - F.col("a_frame")) / (F.col("c_frame") - F.col("a_frame"))
    zero = F.lit(0)
    return _candidates(best, F.lit(MOTO), g.lerp(rest, moto, t), _mixed(F.col("a_conf"), F.col("c_conf"), t), TAKEN, F.lit(1), F.col("c_frame"), F.col("c_ord"), zero, zero, zero)


def _added(seen: Column, more: Column) -> Column:
    """A frame's list with the candidates that no box of their class is in the way of, each in turn."""

    def step(kept: Column, v: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["cls"] == v["cls"]) & (g.iou(g.fields(k), g.fields(v)) >= v["least"]))
        new = F.struct(F.size(kept).alias("ord"), v["cls"], *(v[n] for n in BOX), v["conf"], F.lit(True).alias("held")).cast(ITEM)
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(more, seen, step)


def held(frames: DataFrame, vehicles: DataFrame, p: Params = DEFAULTS, by_segment: bool = True) -> DataFrame:
    """video_id, frame, ord, cls, box, conf, held, of known frames; chains are linked by segments that none reaches over."""
    known = frames.select("video_id", "frame").distinct()
    cut = hold_segments(frames, vehicles, p) if by_segment else known.withColumn("segment", F.lit(0).cast("long"))
    numbered = vehicles.withColumn("ord", F.row_number().over(Window.partitionBy("video_id", "frame").orderBy("ord")) - 1)
    more = held_by_chains(chained(cut, vehicles, p), p).unionByName(held_by_splits(numbered.join(known, ["video_id", "frame"]), p))
    more = more.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*RANK, "cls", *BOX, "conf", "least"))).alias("more"))
    rows = known.join(associate.vehicle_arrays(vehicles), ["video_id", "frame"], "left").join(more, ["video_id", "frame"], "left")
    item = lambda v, n: F.struct(n.alias("ord"), v["cls"], *(v[c] for c in BOX), v["conf"], F.lit(False).alias("held")).cast(ITEM)
    empty = F.array().cast(f"array<{ITEM}>")
    none = F.filter("more", lambda v: F.lit(False))
    seen = F.coalesce(F.transform("vehicles", item), empty)
    every = F.when(F.col("more").isNull(), seen).otherwise(_added(seen, F.coalesce("more", none)))
    sure = lambda v: (v["cls"] != MOTO) | F.lit(p.moto_min_conf <= 0) | (v["conf"] >= p.moto_min_conf)
    is_moto = lambda v: v["cls"] == MOTO
    # One motorcycle has none to be compared with.
    several = F.size(F.filter("every", is_moto)) > 1
    thin = F.when(several, folds.nms_held(F.col("every"), MOTO)).otherwise(F.concat(F.filter("every", lambda v: ~is_moto(v)), F.filter("every", is_moto)))
    listed = rows.select("video_id", "frame", every.alias("every")).select("video_id", "frame", F.posexplode(F.filter(thin, sure)).alias("ord", "v"))
    return listed.select("video_id", "frame", "ord", *(f"v.{c}" for c in ("cls", *BOX, "conf", "held")))


def added(held_rows: DataFrame) -> DataFrame:
    return held_rows.filter(F.col("held"))

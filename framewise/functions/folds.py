"""Greedy per-frame folds over ordered arrays of boxes, inside the JVM.

Each takes an array of structs with x1, y1, x2, y2 (and ord, conf, cls where
said) and returns an array. Order is part of the meaning: sorting keys end in
the list position, and ties keep it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


def sorted_by(items: Column, *keys: Callable[[Column], Column]) -> Column:
    """Sorted ascending by several keys."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key in reversed(keys):
            x, y = key(a), key(b)
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.array_sort(items, compare)


def _none(items: Column) -> Column:
    return F.slice(items, 1, 0)


def _larger_first(items: Column, position: str) -> Column:
    return sorted_by(items, lambda v: -g.product(v["x2"] - v["x1"], v["y2"] - v["y1"]), lambda v: v[position])


def suppress_overlapping(items: Column, position: str, most_iou: float = 0.3) -> Column:
    """Larger boxes first; a box goes if it shares over `most_iou` with one that stays."""
    ordered = _larger_first(items, position)

    def step(kept: Column, v: Column) -> Column:
        hit = F.exists(kept, lambda k: g.iou(g.fields(k), g.fields(v)) > most_iou)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(ordered, _none(items), step)


def dedupe_vehicles(items: Column, least_iou: float = 0.40, least_contained: float = 0.60) -> Column:
    """Surer boxes first; a box joins the first one kept that is the same vehicle, which grows to hold both.

    Items and result: ord, cls, x1, y1, x2, y2, conf; `ord` of the first member.
    """
    ordered = sorted_by(items, lambda v: -v["conf"], lambda v: v["ord"])

    def step(kept: Column, v: Column) -> Column:
        same = F.transform(kept, lambda k: g.same_detection(v["cls"], g.fields(v), k["cls"], g.fields(k), least_iou, least_contained))
        at = F.array_position(same, True) - 1

        def grown(k: Column, i: Column) -> Column:
            both = g.union_box(g.fields(v), g.fields(k))
            joined = F.struct(k["ord"].alias("ord"), k["cls"].alias("cls"), *(c.alias(n) for n, c in zip(g.Box._fields, both, strict=True)), F.greatest(k["conf"], v["conf"]).alias("conf"))
            return F.when(i == at, joined).otherwise(k)

        return F.when(at >= 0, F.transform(kept, grown)).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(ordered, _none(items), step)


def nms_held(items: Column, cls: int = 3, least_iou: float = 0.28) -> Column:
    """Boxes of other classes as they are, then those of `cls`, larger first, without near or contained ones."""
    others = F.filter(items, lambda v: v["cls"] != cls)
    ordered = sorted_by(F.filter(items, lambda v: v["cls"] == cls), lambda v: -g.area(g.fields(v)), lambda v: v["ord"])

    def step(kept: Column, v: Column) -> Column:
        near = F.exists(kept, lambda k: (g.iou(g.fields(v), g.fields(k)) >= least_iou) | g.centre_in(g.fields(v), g.fields(k)))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(v)))

    return F.concat(others, F.aggregate(ordered, _none(items), step))


def one_plate_per_vehicle(plates: Column, vehicles: Column) -> Column:
    """Each vehicle in order claims the free plates it overlaps and keeps the surest; a struct of kept and suppressed plates.

    Kept: claimed winners in vehicle order, then plates that no vehicle claims.
    """
    start = F.struct(plates.alias("free"), _none(plates).alias("kept"), _none(plates).alias("suppressed"))

    def step(acc: Column, v: Column) -> Column:
        inside = F.filter(acc["free"], lambda p: g.overlaps(g.fields(p), g.fields(v)))
        best = sorted_by(inside, lambda p: -p["conf"], lambda p: p["pord"])
        lost = sorted_by(F.slice(best, 2, 1 << 20), lambda p: p["pord"])
        free = F.filter(acc["free"], lambda p: ~g.overlaps(g.fields(p), g.fields(v)))
        return F.struct(free.alias("free"), F.concat(acc["kept"], F.slice(best, 1, 1)).alias("kept"), F.concat(acc["suppressed"], lost).alias("suppressed"))

    return F.aggregate(vehicles, start, step, lambda a: F.struct(F.concat(a["kept"], a["free"]).alias("kept"), a["suppressed"].alias("suppressed")))


def merge_touching_last(items: Column) -> Column:
    """By x1, then y1: a box that overlaps the last result joins it, else it is a result of its own.

    Only the last is compared, so this is no transitive closure.
    """
    ordered = sorted_by(items, lambda r: r["x1"], lambda r: r["y1"])

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = g.union_box(g.fields(last), g.fields(r)).struct()
        return F.when(F.coalesce(g.overlaps(g.fields(last), g.fields(r)), F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(g.fields(r).struct())))

    return F.aggregate(ordered, F.transform(_none(items), lambda r: g.fields(r).struct()), step)

"""Plates and the vehicles they belong to.

Every join is an equi-join on (video_id, frame) with the geometry as a residual
condition, and picks one partner by an aggregate that Spark combines before the
shuffle; there is no window over a frame and no theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import CLASS_NAMES, MOTO

KEY = ["video_id", "frame"]


def per_frame(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One array of structs per frame, in list order (the first column)."""
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def vehicle_arrays(vehicles: DataFrame) -> DataFrame:
    return per_frame(vehicles, "vehicles", "ord", "cls", *g.Box._fields, "conf")


def tightest(plate: g.Box, vehicles: Column, classes: tuple[int, ...]) -> Column:
    """The smallest vehicle of these classes that holds the plate's centre; the first of equals; null if none."""
    inside = F.filter(vehicles, lambda v: v["cls"].isin(*classes) & g.centre_in(plate, g.fields(v)))
    ranked = F.transform(inside, lambda v: F.struct(F.greatest(F.lit(1.0), g.product(v["x2"] - v["x1"], v["y2"] - v["y1"])).alias("area"), v["ord"].alias("ord"), v.alias("v")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["area"], r["ord"], r["v"])))["v"]


def owner(plate: g.Box, vehicles: Column, classes: tuple[int, ...]) -> Column:
    """The tightest vehicle, else the first that the plate overlaps and that isn't a motorcycle with the centre outside."""
    near = F.filter(vehicles, lambda v: v["cls"].isin(*classes) & g.overlaps(plate, g.fields(v)) & ((v["cls"] != MOTO) | g.centre_in(plate, g.fields(v))))
    return F.coalesce(tightest(plate, vehicles, classes), F.get(near, 0))


def with_owner(plates: DataFrame, vehicles: DataFrame, classes: tuple[int, ...] = tuple(CLASS_NAMES)) -> DataFrame:
    """Plates with `v`, their vehicle's struct (null: standalone)."""
    return plates.join(vehicle_arrays(vehicles), KEY, "left").withColumn("v", owner(g.columns(), F.col("vehicles"), classes)).drop("vehicles")


def moto_or_overlapping(plate: g.Box, vehicles: Column) -> Column:
    """The tightest motorcycle, else the first that overlaps the plate."""
    near = F.filter(vehicles, lambda v: (v["cls"] == MOTO) & g.overlaps(plate, g.fields(v)))
    return F.coalesce(tightest(plate, vehicles, (MOTO,)), F.get(near, 0))


def best_zone(plates: DataFrame, zones: DataFrame) -> DataFrame:
    """Plates with `zone`, the zone that covers most of them (the first of equals), and `frac`; null and 0 where none does."""
    arrays = per_frame(zones, "zones", "zord", *g.Box._fields)
    own = g.columns()
    covers = F.transform("zones", lambda z: F.struct((-g.covered_fraction(own, g.fields(z))).alias("minus"), z["zord"].alias("zord"), z.alias("zone")))
    best = F.array_min(F.filter(covers, lambda c: c["minus"] < 0))
    out = plates.join(arrays, KEY, "left").withColumn("_b", best)
    return out.withColumn("zone", F.col("_b.zone")).withColumn("frac", F.coalesce(-F.col("_b.minus"), F.lit(0.0))).drop("_b", "zones")


def split_by_zone(observed: DataFrame, zones: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """Observed plates with `kept`: whether a zone that isn't a bridge or the own plate shares `least_iou` with them."""
    used = zones.filter(~F.col("src").isin("bridge", "own"))
    out = observed.join(per_frame(used, "zones", "zord", *g.Box._fields), KEY, "left")
    hit = F.exists("zones", lambda z: g.iou(g.columns(), g.fields(z)) >= least_iou)
    return out.withColumn("kept", F.coalesce(hit, F.lit(False))).drop("zones")


def live_vehicle(guess: g.Box, cls: Column, vehicles: Column, least_iou: float) -> Column:
    """The vehicle of the class (or of those it is confused with) that fits a guessed box best, else the guess."""
    from ..schema import CONFUSED

    allowed = F.filter(vehicles, lambda v: F.when(cls.isin(*CONFUSED), v["cls"].isin(*CONFUSED)).otherwise(v["cls"] == cls))
    ranked = F.transform(allowed, lambda v: F.struct((-g.iou(g.fields(v), guess)).alias("minus"), v["ord"].alias("ord"), g.fields(v).struct().alias("box")))
    best = F.array_min(F.filter(ranked, lambda r: r["minus"] < 0))
    return F.when(F.coalesce(-best["minus"] >= least_iou, F.lit(False)), best["box"]).otherwise(guess.struct())

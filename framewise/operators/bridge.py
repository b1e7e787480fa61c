"""Zones: observed plates of tracks, and interpolated ones in between, without Python.

A gap of a track is a pair of rows made by `lead`; its missing frames come from
`sequence`, also where the cache has no such frame. Each places the plate on the
vehicle seen then, by the plate's pose on its vehicle at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import DEFAULTS, Params
from . import associate, filters


def link_ok(a: dict[str, Column], b: dict[str, Column], gap: Column, p: Params) -> Column:
    """Whether b may follow a in a track: gap, class, vehicle, motion and size."""
    return (
        gap.between(0, p.max_gap)
        & g.class_link_ok(a["cls"], b["cls"], gap, p.max_class_flip)
        & g.identity_ok(a["veh"], b["veh"], gap, p.min_vehicle_iou, p.max_class_flip)
        & g.motion_ok(a["box"], b["box"], F.greatest(gap, F.lit(1)), b["veh"], p.max_disp_px, p.max_disp_frac)
        & g.area_ratio_ok(a["box"], b["box"], p.max_area_ratio)
    )


def ends(struct: str) -> dict[str, Column]:
    """A tracked plate's parts, from a struct column."""
    s = F.col(struct)
    return {"box": g.fields(s), "veh": g.Box(s["vx1"], s["vy1"], s["vx2"], s["vy2"]), "cls": s["vcls"], "conf": s["conf"], "frame": s["frame"]}


def filled(missing: DataFrame, p: Params) -> DataFrame:
    """Rows with the ends a and b of a gap, a missing `frame` and its `vehicles`: adds the bridge's box (struct) and conf."""
    a, b = ends("a"), ends("b")
    t = (F.col("frame") - a["frame"]) / (b["frame"] - a["frame"])
    seen = F.coalesce("vehicles", F.expr("cast(array() as array<struct<ord:int,cls:int,x1:int,y1:int,x2:int,y2:int,conf:double>>)"))
    own = missing.withColumn("veh", associate.live_vehicle(g.lerp(a["veh"], b["veh"], t), a["cls"], seen, p.min_vehicle_iou))
    at = g.lerp_pose(g.pose(a["box"], a["veh"]), g.pose(b["box"], b["veh"]), t)
    return own.withColumns({"box": g.placed(at, g.fields(F.col("veh"))).struct(), "conf": a["conf"] * (1 - t) + b["conf"] * t})


def bridged(a: dict[str, Column], b: dict[str, Column], p: Params) -> Column:
    """Whether frames are missing between two plates of a track, and the way over them is plausible."""
    gap = b["frame"] - a["frame"] - 1
    return (gap > 0) & link_ok(a, b, gap, p)


END = ("frame", *g.Box._fields, "conf", "vx1", "vy1", "vx2", "vy2", "vcls")


def bridges(tracked: DataFrame, vehicles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The missing frames of each track: video_id, frame, box, conf, src = bridge, track_id."""
    row = F.struct(*END)
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    pairs = tracked.select("video_id", "track_id", row.alias("a"), F.lead(row).over(order).alias("b")).filter("b is not null")
    pairs = pairs.filter(bridged(ends("a"), ends("b"), p))
    missing = pairs.withColumn("frame", F.explode(F.sequence(F.col("a.frame") + 1, F.col("b.frame") - 1)))
    found = filled(missing.join(associate.vehicle_arrays(vehicles), ["video_id", "frame"], "left"), p)
    return found.select("video_id", "frame", *(F.col(f"box.{n}").alias(n) for n in g.Box._fields), "conf", F.lit("bridge").alias("src"), "track_id")


def zones(tracked: DataFrame, vehicles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Observed and bridged zones; zord counts a frame's zones in order of tracks."""
    seen = filters.drop_unsure_motos(vehicles, p.moto_min_conf)
    columns = ["video_id", "frame", *g.Box._fields, "conf", "src", "track_id"]
    both = tracked.select(*columns).unionByName(bridges(tracked, seen, p))
    order = Window.partitionBy("video_id", "frame").orderBy("track_id", *g.Box._fields)
    return both.select("video_id", "frame", (F.row_number().over(order) - 1).cast("int").alias("zord"), *columns[2:])

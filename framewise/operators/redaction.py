"""What to redact in each frame, as rows: rectangles, kernels and drawings. Pixels are up to a pluggable function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..schema import DEFAULTS, MOTO, Params


def plan(frames: DataFrame, zones: DataFrame, p: Params = DEFAULTS, own_plate: tuple[int, int, int, int] | None = None, forced: DataFrame | None = None, mode: str = "blur") -> DataFrame:
    """video_id, frame, src, rectangle within the frame, kernel: zones, the own plate in every frame, and forced patches.

    Zones are cut to a fraction of the frame, padded, clipped; empty ones go.
    """
    rows = zones.select("video_id", "frame", "src", *g.Box._fields)
    if own_plate:
        fixed = [F.lit(v).alias(c) for c, v in zip(g.Box._fields, own_plate, strict=True)]
        rows = rows.unionByName(frames.select("video_id", "frame", F.lit("own").alias("src"), *fixed))
    if forced is not None:
        rows = rows.unionByName(forced.select("video_id", "frame", F.lit("forced").alias("src"), *g.Box._fields))
    rows = rows.join(frames.select("video_id", "frame"), ["video_id", "frame"], "left_semi")
    # Each step's edges come out of a generator, through which Catalyst pushes no filter and merges no projection:
    # written into one expression, an edge would appear in itself hundreds of times.
    cut = lambda b: g.clamped_size(b, p.width, p.height, p.max_box_frac)
    for step in (cut, cut, lambda b: g.padded(b, p.blur_padding, p.width, p.height)):
        rows = rows.select("video_id", "frame", "src", F.inline(F.array(step(g.columns()).struct())))
    own = g.columns()
    out = rows.filter((own.x2 > own.x1) & (own.y2 > own.y1))
    kernel = g.blur_kernel(p.blur_strength, g.width(own), g.height(own)) if mode == "blur" else F.lit(None).cast("int")
    return out.withColumns({"mode": F.lit(mode), "kernel": kernel})


def replayed(frames: DataFrame, cached: DataFrame) -> DataFrame:
    """Frames up to the first that the cache lacks, per video."""
    seen = cached.select("video_id", "frame").distinct().withColumn("_in", F.lit(True))
    own = frames.join(seen, ["video_id", "frame"], "left")
    first = own.filter("_in is null").groupBy("video_id").agg(F.min("frame").alias("_end"))
    return own.join(first, "video_id", "left").filter(F.coalesce(F.col("frame") < F.col("_end"), F.lit(True))).drop("_in", "_end")


def draw_list(vehicles: DataFrame, zones: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Boxes with label and style: vehicles by class (small motorcycles apart), zones by source."""
    small = (F.col("cls") == MOTO) & (g.max_side(g.columns()) < p.min_moto_size)
    label = F.format_string("%s %.2f", scalars.class_name(F.col("cls")), F.col("conf"))
    cars = vehicles.select("video_id", "frame", F.lit("vehicle").alias("kind"), *g.Box._fields, label.alias("label"), F.when(small, "small").otherwise("vehicle").alias("style"))
    tag = F.format_string("#%d %.2f", F.col("track_id"), F.col("conf"))
    return cars.unionByName(zones.select("video_id", "frame", F.lit("zone").alias("kind"), *g.Box._fields, tag.alias("label"), F.when(F.col("src") == "bridge", "bridge").otherwise("observed").alias("style")))


def crop_layout(vehicles: DataFrame, p: Params = DEFAULTS, crop_pad: int = 12) -> DataFrame:
    """Crops to search for plates: each vehicle padded, and before it a motorcycle's rear, with their letterbox."""
    v = g.columns()
    whole = g.Box(v.x1 - crop_pad, v.y1 - crop_pad, v.x2 + crop_pad, v.y2 + crop_pad)
    rear = g.rear_region(v, p.moto_crop_bottom, p.moto_crop_side, p.width, p.height)
    entry = lambda n, src, b, most: F.struct(F.lit(n).alias("cord"), F.lit(src).alias("src"), *(c.alias(x) for x, c in zip(g.Box._fields, b, strict=True)), F.lit(max(1.0, most)).alias("most"))
    own = entry(1, "crop", whole, p.vehicle_crop_scale)
    crops = F.when(F.col("cls") == MOTO, F.array(entry(0, "crop_moto", rear, p.moto_crop_scale), own)).otherwise(F.array(own)) if p.moto_crop_scale > 1 else F.array(own)
    rows = vehicles.filter(F.col("cls").isin(*p.classes)).select("video_id", "frame", "ord", "cls", F.explode(crops).alias("c"))
    c = g.fields(F.col("c"))
    zero = F.lit(0)
    b = g.Box(F.greatest(zero, c.x1), F.greatest(zero, c.y1), F.least(F.lit(p.width), c.x2), F.least(F.lit(p.height), c.y2))
    rows = rows.select("video_id", "frame", "ord", "cls", "c.cord", "c.src", "c.most", *(x.alias(n) for n, x in zip(g.Box._fields, b, strict=True))).filter("x2 > x1 and y2 > y1")
    w, h = g.width(g.columns()), g.height(g.columns())
    side = F.lit(float(max(32, p.crop_size)))
    scale = F.least(side / w, side / h, F.col("most"))
    pad = lambda s: (side - F.greatest(F.lit(1), g.rounded(s * scale))) / 2.0
    return rows.select("video_id", "frame", "ord", "cls", "cord", "src", *g.Box._fields, w.alias("crop_w"), h.alias("crop_h"), scale.alias("scale"), pad(w).alias("pad_x"), pad(h).alias("pad_y"))

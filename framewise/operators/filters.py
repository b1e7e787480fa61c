"""Row filters on detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import CLASS_NAMES, MOTO, Params


def known_vehicles(vehicles: DataFrame, classes: tuple[int, ...] = tuple(CLASS_NAMES)) -> DataFrame:
    return vehicles.filter(F.col("cls").isin(*classes))


def drop_unsure_motos(vehicles: DataFrame, least: float) -> DataFrame:
    """Motorcycles under the confidence go; 0 or less keeps all."""
    return vehicles if least <= 0 else vehicles.filter((F.col("cls") != MOTO) | (F.col("conf") >= least))


def trackable_plates(plates: DataFrame, p: Params) -> DataFrame:
    """Sure and large enough, and not of the old tiled source."""
    kept = plates.filter(F.col("conf") >= p.conf_floor).filter(F.coalesce("src", F.lit("crop")) != "sahi")
    return kept.filter(g.min_side(g.columns()) >= p.min_plate_side) if p.min_plate_side > 0 else kept


def split_by_confidence(plates: DataFrame, least: float) -> DataFrame:
    """Boxes with area, tagged: kept, or rejected below the confidence."""
    b = g.columns()
    return plates.filter((b.x2 > b.x1) & (b.y2 > b.y1)).withColumn("kept", F.col("conf") >= least)


def near_any_vehicle(plates: DataFrame, vehicles: DataFrame, expand: float = 0.15) -> DataFrame:
    """Adds `kept`: false for crop plates whose centre is in no motorcycle and near no vehicle."""
    v = vehicles.select("video_id", "frame", F.struct("cls", *g.Box._fields).alias("v")).groupBy("video_id", "frame").agg(F.collect_list("v").alias("_vs"))
    own = g.columns()
    in_moto = F.exists("_vs", lambda x: (x["cls"] == MOTO) & g.centre_in(own, g.fields(x)))
    near = F.exists("_vs", lambda x: g.centre_in(own, g.fields(x), expand))
    lost = F.col("src").isin("crop", "crop_moto") & ~F.coalesce(in_moto | near, F.lit(False))
    return plates.join(v, ["video_id", "frame"], "left").withColumn("kept", ~F.coalesce(lost, F.lit(False))).drop("_vs")


def not_covered(found: DataFrame, patches: DataFrame, margin: int = 8) -> DataFrame:
    """Detections that no known patch of their frame reaches."""
    p = patches.select("video_id", "frame", *(F.col(c).alias(f"_{c}") for c in g.Box._fields))
    on = (found["video_id"] == p["video_id"]) & (found["frame"] == p["frame"]) & g.overlaps(g.Box(*(found[c] for c in g.Box._fields)), g.columns("_"), margin)
    return found.join(p, on, "left_anti")


#: Side of a cell of the grid of patches, in pixels.
CELL = 128


def _cells(rows: DataFrame, margin: int = 0) -> DataFrame:
    """Rows once for each cell of the grid that their box, grown by a margin, reaches."""
    b = g.columns()
    cell = lambda v: F.floor(v / CELL).cast("int")
    over = lambda p, q: F.sequence(cell(F.least(p, q) - margin), cell(F.greatest(p, q) + margin))
    return rows.withColumn("_cx", F.explode(over(b.x1, b.x2))).withColumn("_cy", F.explode(over(b.y1, b.y2)))


def not_on_patches(found: DataFrame, patches: DataFrame, margin: int = 8) -> DataFrame:
    """Detections that no patch of their video reaches, whatever its frame: patches of parked cars or signs, any number a video.

    Boxes and patches meet in the cells of a grid, so a video with many patches
    isn't compared pair by pair. What meets is kept as distinct boxes of a frame,
    and detections with such a box go.
    """
    box = g.Box._fields
    known = _cells(patches.select("video_id", *box).distinct()).select("video_id", "_cx", "_cy", *(F.col(c).alias(f"_{c}") for c in box))
    boxes = found.select("video_id", "frame", *box).distinct()
    hit = _cells(boxes, margin).join(known, ["video_id", "_cx", "_cy"]).filter(g.overlaps(g.columns(), g.columns("_"), margin))
    return found.join(hit.select("video_id", "frame", *box).distinct(), ["video_id", "frame", *box], "left_anti").select(found.columns)


def in_range(rows: DataFrame, start: int | None, end: int | None, every: int = 1) -> DataFrame:
    """Frames of a half-open range, each n-th."""
    kept: Column = F.col("frame") % every == 0
    if start is not None:
        kept &= F.col("frame") >= start
    if end is not None:
        kept &= F.col("frame") < end
    return rows.filter(kept)

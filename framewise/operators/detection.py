"""From a plate model's boxes in crops to the plates of frames: what comes after the model, as joins and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import geometry as g
from . import associate, filters

CROP = ("video_id", "frame", "ord", "cord")


def in_frame(found: DataFrame, crops: DataFrame) -> DataFrame:
    """Boxes (crop key, n, edges in the crop's square, conf) moved into frames: pord in order of crops and boxes, src of the crop."""
    c = crops.select(*CROP, "src", *(F.col(e).alias(f"_{e}") for e in ("x1", "y1")), "crop_w", "crop_h", "scale", "pad_x", "pad_y")
    own = found.join(c, list(CROP))
    b = g.unletterbox(g.columns(), g.Letterbox(F.col("scale"), F.col("pad_x"), F.col("pad_y")), F.col("crop_w"), F.col("crop_h"))
    moved = [(F.col("_x1" if n[0] == "x" else "_y1") + e).alias(n) for n, e in zip(g.Box._fields, b, strict=True)]
    rows = own.select(*CROP, "n", *moved, "conf", "src")
    numbered = rows.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", "cord", "n", *g.Box._fields, "conf", "src"))).alias("b"))
    return numbered.select("video_id", "frame", F.posexplode("b").alias("pord", "b")).select("video_id", "frame", "pord", *(f"b.{c}" for c in (*g.Box._fields, "conf", "src")))


def plates_of_crops(found: DataFrame, crops: DataFrame, vehicles: DataFrame, least_conf: float = 0.15) -> DataFrame:
    """Plates of frames with `kept`: false below the confidence (src = rejected) or far from every vehicle; of kept ones that overlap the larger."""
    rows = filters.split_by_confidence(in_frame(found, crops), least_conf)
    unsure = rows.filter(~F.col("kept")).withColumn("src", F.lit("rejected"))
    near = filters.near_any_vehicle(rows.filter("kept").drop("kept"), vehicles)
    box = ("pord", *g.Box._fields, "conf", "src")
    thinned = associate.per_frame(near.filter("kept"), "b", *box).select("video_id", "frame", F.explode(folds.suppress_overlapping(F.col("b"), "pord")).alias("b"))
    kept = thinned.select("video_id", "frame", *(f"b.{c}" for c in box)).withColumn("kept", F.lit(True))
    columns = kept.columns
    return kept.unionByName(near.filter(~F.col("kept")).select(*columns)).unionByName(unsure.select(*columns))

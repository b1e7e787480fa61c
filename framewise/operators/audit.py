"""The audit loop: readable plates that are left, as patches to blur by force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import geometry as g
from . import filters


def findings(found: DataFrame, patches: DataFrame | None = None, least_conf: float = 0.15, least_w: int = 12, least_h: int = 6, readable: float = 150.0, margin: int = 8) -> DataFrame:
    """Detections sure and large enough and not near a known patch, with `readable`: whether `var` is over the limit."""
    b = g.columns()
    own = found.filter((F.col("conf") >= least_conf) & (g.width(b) >= least_w) & (g.height(b) >= least_h))
    own = filters.not_covered(own, patches, margin) if patches is not None else own
    return own.withColumn("readable", F.col("var") > readable)


def fixlist(own: DataFrame) -> DataFrame:
    """video_id, frame, rects: merged rectangles of frames with a readable plate."""
    rows = own.filter("readable").groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct(*g.Box._fields, "pord"))).alias("r"))
    return rows.select("video_id", "frame", folds.merge_touching_last(F.col("r")).alias("rects"))


def fixlist_json(fixes: DataFrame) -> DataFrame:
    """video_id, json: frame -> list of [x1, y1, x2, y2]."""
    rects = F.transform("rects", lambda r: F.array(*(r[c] for c in g.Box._fields)))
    entry = F.struct(F.col("frame").cast("string").alias("key"), rects.alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", entry.alias("e")))), lambda x: x["e"])
    return fixes.groupBy("video_id").agg(F.to_json(F.map_from_entries(ordered)).alias("json"))


def read_fixlist(rows: DataFrame) -> DataFrame:
    """video_id, frame, x1 ... y2 of (video_id, json) rows; a byte order mark is skipped."""
    parsed = F.from_json(F.regexp_replace("json", "^﻿", ""), "map<string,array<array<int>>>")
    own = rows.select("video_id", F.explode(parsed).alias("frame", "rects")).select("video_id", F.col("frame").cast("int").alias("frame"), F.explode("rects").alias("r"))
    return own.select("video_id", "frame", *(F.col("r")[i].alias(c) for i, c in enumerate(g.Box._fields)))

"""Recall, coverage, jitter, blinks and counts over detections and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry as g
from ..schema import MOTO
from . import associate, quantiles

# The seconds looked at, full coverage, longest blink in frames.
KEY_SECONDS = (9.0, 18.0, 24.0, 28.0)
FULL_COVER = 0.90
LONGEST_BLINK = 3


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def zone_stats(zones: DataFrame) -> DataFrame:
    bridged = F.col("src") == "bridge"
    return zones.agg(
        F.count_distinct("video_id", "frame").alias("frames_with_zones"),
        F.count_if(~bridged).alias("observed_zones"),
        F.count_if(bridged).alias("bridged_zones"),
    )


def zone_totals(zones: DataFrame, frames: DataFrame) -> DataFrame:
    """Zones in all, per frame, and tracks."""
    n = frames.agg(F.count("*").alias("frames"))
    own = zones.agg(F.count("*").alias("zones_total"), F.count_distinct("video_id", "track_id").alias("tracks"))
    return own.crossJoin(F.broadcast(n)).withColumn("zones_per_frame", _ratio(F.col("zones_total").cast("double"), F.col("frames").cast("double")))


def moto_plates(plates: DataFrame, vehicles: DataFrame, floor: float = 0.15, least_w: int = 8, least_h: int = 4) -> DataFrame:
    """Plates of motorcycles that are sure and large enough, with `geo`: whether their centre is in the box."""
    b = g.columns()
    own = plates.filter((F.col("conf") >= floor) & (g.width(b) >= least_w) & (g.height(b) >= least_h))
    own = own.join(associate.vehicle_arrays(vehicles.filter(F.col("cls") == MOTO)), ["video_id", "frame"])
    own = own.withColumn("m", associate.moto_or_overlapping(b, F.col("vehicles"))).filter("m is not null").drop("vehicles")
    return own.withColumn("geo", g.centre_in(b, g.fields(F.col("m"))))


def moto_frames(plates: DataFrame, vehicles: DataFrame, **limits) -> DataFrame:
    """video_id, frame, n_moto, n_any, n_geo of every frame with a motorcycle."""
    motos = vehicles.filter(F.col("cls") == MOTO).groupBy("video_id", "frame").agg(F.count("*").alias("n_moto"))
    own = moto_plates(plates, vehicles, **limits).groupBy("video_id", "frame").agg(F.count("*").alias("n_any"), F.count_if("geo").alias("n_geo"))
    return motos.join(own, ["video_id", "frame"], "left").fillna(0, ["n_any", "n_geo"])


def recall(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, **limits) -> DataFrame:
    own = moto_frames(plates, vehicles, **limits).agg(F.count("*").alias("moto_frames"), F.count_if(F.col("n_any") > 0).alias("moto_with_any_plate"), F.count_if(F.col("n_geo") > 0).alias("moto_with_geo_plate"))
    own = own.crossJoin(F.broadcast(frames.agg(F.count("*").alias("frames"))))
    n = F.col("moto_frames").cast("double")
    return own.withColumns({"recall_any": _ratio(F.col("moto_with_any_plate"), n), "recall_geo": _ratio(F.col("moto_with_geo_plate"), n)})


def key_seconds(plates: DataFrame, vehicles: DataFrame, fps: float, **limits) -> DataFrame:
    """Per key second: motorcycle frames within half a second, those with a plate in the box, and the first 8 confidences (3 a frame)."""
    near = F.filter(F.array(*map(F.lit, KEY_SECONDS)), lambda s: F.abs(F.col("frame") / F.lit(fps) - s) <= 0.5)
    geo = moto_plates(plates, vehicles, **limits).filter("geo").groupBy("video_id", "frame").agg(F.slice(F.array_sort(F.collect_list(F.struct("pord", "conf"))), 1, 3).alias("first"))
    own = moto_frames(plates, vehicles, **limits).join(geo, ["video_id", "frame"], "left").withColumn("second", F.explode(near))
    order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("video_id", "frame", F.coalesce("first", F.expr("cast(array() as array<struct<pord:int,conf:double>>)")).alias("first")))), lambda f: f["first"]))
    return own.groupBy("second").agg(F.count("*").alias("moto_frames"), F.count_if(F.col("n_geo") > 0).alias("geo_frames"), F.slice(F.transform(order, lambda p: p["conf"]), 1, 8).alias("sample_confs"))


def misses(plates: DataFrame, vehicles: DataFrame, fps: float, most: int = 16, **limits) -> DataFrame:
    """The first frames with a motorcycle and no plate in a box."""
    own = moto_frames(plates, vehicles, **limits).filter("n_geo = 0").orderBy("video_id", "frame").limit(most)
    return own.select("video_id", "frame", (F.col("frame") / F.lit(fps)).alias("t"), "n_moto", "n_any")


def coverage(plates: DataFrame, zones: DataFrame, floor: float = 0.15, least_w: int = 12, least_h: int = 6) -> DataFrame:
    """Plates with the part of them that the best zone covers, a verdict, and the offset in plate widths."""
    b = g.columns()
    own = associate.best_zone(plates.filter(F.col("conf") >= floor), zones)
    small = (g.width(b) < least_w) | (g.height(b) < least_h)
    verdict = F.when(small, F.when(F.col("frac") < FULL_COVER, "micro").otherwise("small")).when(F.col("frac") <= 0, "uncovered").when(F.col("frac") < FULL_COVER, "partial").otherwise("full")
    z = g.fields(F.col("zone"))
    dx, dy = ((b.x1 + b.x2) - (z.x1 + z.x2)) * 0.5, ((b.y1 + b.y2) - (z.y1 + z.y2)) * 0.5
    offset = F.when(~small & F.col("zone").isNotNull(), F.hypot(dx, dy) / F.greatest(F.lit(1.0), g.width(b).cast("double")))
    return own.select("video_id", "frame", "pord", *g.Box._fields, "conf", "frac", verdict.alias("verdict"), offset.alias("offset"))


def statistics(values: DataFrame, wanted: dict[str, tuple[float, ...]], empty: float | None = None) -> tuple[DataFrame, dict[str, list[Column]]]:
    """The values written once, and exact percentiles of their columns as constants; `empty` where a column has no values."""
    kept = shared.written(values, "values")
    found = quantiles.percentiles(kept, wanted)
    return kept, {c: [F.lit(empty if x is None else x).cast("double") for x in xs] for c, xs in found.items()}


def coverage_report(covered: DataFrame) -> DataFrame:
    is_ = lambda v: F.col("verdict") == v
    covered, found = statistics(covered.select("verdict", "offset"), {"offset": (0.5, 0.95)}, 0.0)
    middle, p95 = found["offset"]
    return covered.agg(
        F.count_if(is_("uncovered")).alias("uncovered"),
        F.count_if(is_("partial")).alias("partial"),
        F.count_if(is_("micro")).alias("micro_missed"),
        middle.alias("offset_median"),
        p95.alias("offset_p95"),
        F.coalesce(F.max("offset"), F.lit(0.0)).alias("offset_max"),
    )


def track_points(zones: DataFrame) -> DataFrame:
    """One centre and size per track and frame, the last zone's where a frame has several."""
    last = F.max(F.struct("zord", *g.Box._fields)).alias("z")
    own = zones.groupBy("video_id", "track_id", "frame").agg(last)
    z = g.fields(F.col("z"))
    cx, cy = g.centre(z)
    return own.select("video_id", "track_id", "frame", cx.alias("cx"), cy.alias("cy"), g.width(z).alias("w"))


def jitter(points: DataFrame) -> DataFrame:
    """Second differences of place and width over three consecutive frames: video_id, track_id, frame (the middle one), px, rel."""
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    near = {f"{c}{n}": f(c).over(order) for c in ("frame", "cx", "cy", "w") for n, f in (("0", F.lag), ("2", F.lead))}
    own = points.withColumns(near).filter("frame - frame0 = 1 and frame2 - frame = 1")
    second = lambda c: F.col(f"{c}2") - F.col(c) * 2 + F.col(f"{c}0")
    rel = F.abs(second("w")) / F.greatest(F.lit(1.0), F.col("w").cast("double"))
    return own.select("video_id", "track_id", "frame", F.hypot(second("cx"), second("cy")).alias("px"), rel.alias("rel"))


def jitter_report(samples: DataFrame) -> DataFrame:
    samples, found = statistics(samples.select("px", "rel"), {"px": (0.5, 0.95), "rel": (0.5, 0.95)}, 0.0)
    (px, px95), (rel, rel95) = found["px"], found["rel"]
    return samples.agg(
        px.alias("jitter_median"),
        px95.alias("jitter_p95"),
        F.coalesce(F.max("px"), F.lit(0.0)).alias("jitter_max"),
        F.count("*").alias("jitter_samples"),
        rel.alias("size_median"),
        rel95.alias("size_p95"),
    )


def blinks(points: DataFrame) -> DataFrame:
    """Short gaps of a track: video_id, track_id, frame (before the gap), gap."""
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    gap = F.lead("frame").over(order) - F.col("frame") - 1
    return points.withColumn("gap", gap).filter(F.col("gap").between(1, LONGEST_BLINK)).select("video_id", "track_id", "frame", "gap")


def stability(plates: DataFrame, zones: DataFrame, frames: DataFrame) -> DataFrame:
    """The stability report: coverage, offsets, jitter, blinks and counts, as one row."""
    points = track_points(zones)
    parts = [coverage_report(coverage(plates, zones)), jitter_report(jitter(points)), blinks(points).agg(F.count("*").alias("blinks")), zone_totals(zones, frames)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out


def zones_by_source(zones: DataFrame) -> DataFrame:
    return zones.groupBy("src").agg(F.count("*").alias("n"))


# Frames and sizes that a report lists.
LISTED_FRAMES, LISTED_SIZES = 40, 12


def _listed(rows: DataFrame, kind: str, order: list[str], value: Column, most: int) -> DataFrame:
    """The first rows of an order as (kind, place, video_id, value)."""
    first = rows.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order)).cast("int")
    return first.select(F.lit(kind).alias("kind"), place.alias("place"), "video_id", value.alias("value"))


def report_lists(covered: DataFrame, zones: DataFrame) -> DataFrame:
    """The lists of a stability report: frames with an uncovered plate, sizes of missed small ones, frames before a blink, in order.

    Blinks go by track in the order in which tracks first appear.
    """
    frames = covered.filter("verdict = 'uncovered'").select("video_id", "frame").distinct()
    missed = covered.filter("verdict = 'micro'")
    size = F.concat(F.col("x2") - F.col("x1"), F.lit("x"), F.col("y2") - F.col("y1"))
    born = zones.groupBy("video_id", "track_id").agg(F.min(F.struct("frame", "zord")).alias("born"))
    winks = blinks(track_points(zones)).join(born, ["video_id", "track_id"])
    frame = F.col("frame").cast("string")
    lists = [
        _listed(frames, "uncovered_frames", ["video_id", "frame"], frame, LISTED_FRAMES),
        _listed(missed, "micro_sizes", ["video_id", "frame", "pord"], size, LISTED_SIZES),
        _listed(winks, "blink_frames", ["video_id", "born", "frame"], frame, LISTED_FRAMES),
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def runs(flagged: DataFrame, fps: float) -> DataFrame:
    """Runs of consecutive frames: video_id, first, last, n, start and end in seconds."""
    order = Window.partitionBy("video_id").orderBy("frame")
    own = flagged.select("video_id", "frame").distinct().withColumn("_g", F.col("frame") - F.row_number().over(order))
    own = own.groupBy("video_id", "_g").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).drop("_g")
    return own.withColumns({"start": F.col("first") / F.lit(fps), "end": F.col("last") / F.lit(fps)})


def percentiles(rows: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    own, found = statistics(rows.select(column), {column: points})
    return own.agg(F.count(column).alias("n"), F.max(column).alias("max"), *(x.alias(f"p{round(100 * q)}") for x, q in zip(found[column], points, strict=True)))


def plate_sizes(moto_plates_: DataFrame) -> DataFrame:
    """Median width and height of motorcycles' plates, of all and of those with their centre in the box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    geo = lambda c: F.when(F.col("geo"), c)
    names = ("w", "h", "geo_w", "geo_h")
    sizes = moto_plates_.select(*(c.alias(n) for c, n in zip((w, h, geo(w), geo(h)), names, strict=True)))
    own, found = statistics(sizes, dict.fromkeys(names, (0.5,)))
    return own.agg(*(found[n][0].alias(n) for n in names))


def run_summary(frames: DataFrame, plates: DataFrame, seconds: float, fps: float, quads: DataFrame | None = None) -> DataFrame:
    """Frames and plates a second of work, times real time, plates a frame; of used quads (rows) their number a frame too."""
    own = frames.agg(F.count("*").alias("frames")).crossJoin(F.broadcast(plates.agg(F.count("*").alias("plates"))))
    rate = _ratio(F.col("frames").cast("double"), F.lit(float(seconds)))
    per_frame = lambda n: _ratio(F.col(n).cast("double"), F.col("frames").cast("double"))
    own = own.withColumns({"fps": rate, "realtime": rate / F.lit(float(fps)), "plates_per_frame": per_frame("plates")})
    if quads is None:
        return own
    return own.crossJoin(F.broadcast(quads.agg(F.count("*").alias("quads")))).withColumn("quads_per_frame", per_frame("quads"))


def overlay_counts(zones: DataFrame) -> DataFrame:
    """Per frame: zones by source (crop sources as one), observed ones, and the first six tracks."""
    src = F.col("src")
    is_crop, is_tiled = src.startswith("crop"), src == "sahi"
    tracks = F.slice(F.array_sort(F.collect_set("track_id")), 1, 6)
    return zones.groupBy("video_id", "frame").agg(F.count_if(is_crop).alias("crop"), F.count_if(is_tiled).alias("sahi"), F.count_if(src == "bridge").alias("bridge"), F.count_if(is_crop | is_tiled).alias("observed"), tracks.alias("tracks"))


def batch_outcome(runs_: DataFrame) -> DataFrame:
    """Of runs (name, ok): how many went well, how many didn't, and which."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    return runs_.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), failed.alias("names"))


def status_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count("*").alias("n"))

"""The registered queries of the detection engine, over tables derived from the driver's `events`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import folds, scalars
from ..functions import geometry as g
from ..operators import associate, audit, bridge, detection, filters, holds, metrics, quads, redaction, sampling, tracking
from ..schema import DEFAULTS, MOTO
from ..sources import cache, fixtures, labels

Query = Callable[[SparkSession, str], DataFrame]
P = DEFAULTS
BOX = g.Box._fields
KEY = ("video_id", "frame")


def _plates(s: SparkSession, d: str) -> DataFrame:
    return fixtures.plates(s, d)


def _vehicles(s: SparkSession, d: str) -> DataFrame:
    return fixtures.vehicles(s, d)


def _frames(s: SparkSession, d: str) -> DataFrame:
    return fixtures.frames(s, d).select(*KEY)


def _sure(s: SparkSession, d: str) -> DataFrame:
    return filters.drop_unsure_motos(_vehicles(s, d), P.moto_min_conf)


def _slot_zones(s: SparkSession, d: str) -> DataFrame:
    """Plates of slots 0 to 2 as zones: track = slot + 1, without sequential state."""
    own = _plates(s, d).filter(F.col("pord") < 3)
    return own.select(*KEY, F.col("pord").alias("zord"), *BOX, "conf", "src", (F.col("pord") + 1).alias("track_id"))


def _slot_tracks(s: SparkSession, d: str) -> DataFrame:
    """The same with their vehicle, as tracked plates."""
    own = tracking.candidates(_plates(s, d).filter(F.col("pord") < 3), _sure(s, d), P)
    return own.withColumn("track_id", F.col("pord") + 1).drop("pord")


# Projections and scalars


def geometry_pairs(s: SparkSession, d: str) -> DataFrame:
    p = _plates(s, d)
    v = _vehicles(s, d).select(*KEY, "ord", "cls", *(F.col(c).alias(f"v{c}") for c in BOX))
    a, b = g.columns(), g.columns("v")
    gap = F.col("ord")
    pose = g.pose(a, b)
    placed = g.placed(pose, b)
    lerp = g.lerp(a, b, F.lit(0.25))
    rest = g.remainder(b, a)
    cut = g.clamped_size(b, 640, 360, P.max_box_frac)
    return p.join(v, list(KEY)).select(
        *KEY, "pord", "ord",
        g.iou(a, b).alias("iou"), g.overlaps(a, b).alias("meets"), g.overlaps(a, b, 8).alias("near"), g.covered_fraction(a, b).alias("covered"),
        g.distance(a, b).alias("dist"), g.diagonal(b).alias("diag"), g.area_floored(a).alias("area1"), g.area(b).alias("area0"),
        g.min_side(a).alias("side"), g.max_side(b).alias("size"), g.relative_area(a, b).alias("rel"), g.area_ratio_ok(b, a, P.max_area_ratio).alias("ratio_ok"),
        *(c.alias(f"l{n}") for n, c in zip(BOX, lerp, strict=True)), *(c.alias(f"p{n}") for n, c in zip(("x", "y", "w", "h"), pose, strict=True)),
        *(c.alias(f"q{n}") for n, c in zip(BOX, placed, strict=True)),
        g.motion_ok(a, b, gap, b, P.max_disp_px, P.max_disp_frac).alias("motion"), g.class_link_ok(F.col("cls"), F.lit(MOTO), gap, 1).alias("class_link"),
        g.identity_ok(a, b, gap, P.min_vehicle_iou, 1).alias("identity"), g.centre_in(a, b).alias("inside"), g.centre_in(a, b, 0.15).alias("inside15"),
        *(rest[n].alias(f"r{n}") for n in BOX), *(c.alias(f"c{n}") for n, c in zip(BOX, cut, strict=True)),
    )


def scalar_functions(s: SparkSession, d: str) -> DataFrame:
    e = fixtures.frames(s, d).select(F.col("event_id").alias("id"))
    sec = F.col("id") * F.lit(1.5)
    clock = F.concat((F.col("id") % 60).cast("string"), F.lit(":"), F.lpad((F.col("id") % 59).cast("string"), 2, "0"))
    long_clock = F.concat(F.lit("1:"), clock)
    color = F.concat_ws(",", (F.col("id") % 256).cast("string"), F.lit("7"), F.lit(" 9"))
    return e.select(
        "id",
        scalars.time_to_seconds(clock).alias("mm"), scalars.time_to_seconds(long_clock).alias("hh"), scalars.time_to_seconds(sec.cast("string")).alias("ss"),
        scalars.parse_region(F.concat_ws(",", F.lit("1"), F.lit(" 2"), F.col("id").cast("string"), F.lit("4")))[2].alias("region_x2"),
        scalars.parse_color(color)[2].alias("red"),
        scalars.format_duration(F.col("id").cast("double")).alias("took"),
        scalars.in_windows(F.col("id").cast("double"), scalars.parse_windows(F.lit("0:05-0:10, 1:00-2:00"))).alias("dense"),
        scalars.class_name((F.col("id") % 8).cast("int")).alias("class_name"),
        scalars.timecode(F.col("id").cast("double") / F.lit(4.0)).alias("code"),
        scalars.crop_stem(F.col("id").cast("int"), F.lit(12), F.lit(7)).alias("stem"),
        scalars.estimated_frames(F.lit(1.0), (F.col("id") % 3 * 10).cast("double"), F.lit(40.0), F.lit(30.0)).alias("n_frames"),
    )


def crop_layout(s: SparkSession, d: str) -> DataFrame:
    return redaction.crop_layout(_vehicles(s, d))


def letterbox_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Each vehicle box in its crop's square and back."""
    own = redaction.crop_layout(_vehicles(s, d)).filter("src = 'crop'")
    v = _vehicles(s, d).select(*KEY, "ord", *(F.col(c).alias(f"v{c}") for c in BOX))
    box = g.Letterbox(F.col("scale"), F.col("pad_x"), F.col("pad_y"))
    put = g.Box(*((F.col(f"v{c}") - F.col(c[0] + "1")) * F.col("scale") + F.col(f"pad_{c[0]}") for c in BOX))
    back = g.unletterbox(put, box, F.col("crop_w"), F.col("crop_h"))
    on = g.centre_on_content(put, box, F.col("crop_w"), F.col("crop_h"))
    return own.join(v, [*KEY, "ord"]).select(*KEY, "ord", *(c.alias(n) for n, c in zip(BOX, back, strict=True)), on.alias("on_content"))


def detected_plates(s: SparkSession, d: str) -> DataFrame:
    """Plates put into their vehicle's crop, as a model would find them there, and brought back."""
    crops = redaction.crop_layout(_vehicles(s, d))
    inside = _plates(s, d).filter("pord < 3").select(*KEY, F.col("pord").alias("ord"), F.lit(1).alias("cord"), F.col("pord").alias("n"), *(F.col(c).alias(f"p{c}") for c in BOX), "conf")
    own = inside.join(crops.select(*detection.CROP, "x1", "y1", "scale", "pad_x", "pad_y"), list(detection.CROP))
    put = [((F.col(f"p{c}") - F.col(c[0] + "1")) * F.col("scale") + F.col(f"pad_{c[0]}")).alias(f"s{c}") for c in BOX]
    found = own.select(*detection.CROP, "n", *put, "conf").select(*detection.CROP, "n", *(F.col(f"s{c}").alias(c) for c in BOX), "conf")
    return detection.plates_of_crops(found, crops, _vehicles(s, d)).select(*KEY, *BOX, "conf", "src", "kept")


def yolo_labels(s: SparkSession, d: str) -> DataFrame:
    own = _plates(s, d).select(*KEY, "pord", labels.label_line(F.lit(0), g.columns(), F.lit(float(P.width)), F.lit(float(P.height))).alias("value"))
    return own


def yolo_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Labels written and parsed again, truncated to pixels."""
    parsed = labels.parse_labels(yolo_labels(s, d), F.lit(float(P.width)), F.lit(float(P.height)), True)
    return parsed.select(*KEY, "pord", "cls", *BOX)


def warped_boxes(s: SparkSession, d: str) -> DataFrame:
    w = g.warped(g.columns(), [[0.9, -0.2, 30.0], [0.1, 1.1, -40.0]], P.width, P.height)
    return _vehicles(s, d).select(*KEY, "ord", w.alias("w")).filter("w is not null").select(*KEY, "ord", *(F.col(f"w.{c}").alias(c) for c in BOX))


# Filters, joins, folds


def moto_conf_view(s: SparkSession, d: str) -> DataFrame:
    return _sure(s, d)


def trackable_plates(s: SparkSession, d: str) -> DataFrame:
    return filters.trackable_plates(_plates(s, d), P)


def plate_confidence_split(s: SparkSession, d: str) -> DataFrame:
    return filters.split_by_confidence(_plates(s, d), P.conf_floor)


def plate_geometry_filter(s: SparkSession, d: str) -> DataFrame:
    return filters.near_any_vehicle(_plates(s, d), _vehicles(s, d)).select(*KEY, "pord", "kept")


def clip_frames(s: SparkSession, d: str) -> DataFrame:
    return filters.in_range(_frames(s, d), 10, 40, 3)


def plate_vehicle_assoc(s: SparkSession, d: str) -> DataFrame:
    own = associate.with_owner(_plates(s, d), _vehicles(s, d), P.classes)
    return own.select(*KEY, "pord", F.col("v.ord").alias("ord"), F.col("v.cls").alias("cls"))


def owned_plates_by_source(s: SparkSession, d: str) -> DataFrame:
    own = tracking.candidates(_plates(s, d), _sure(s, d), P)
    return own.groupBy("video_id", "src").agg(F.count("*").alias("n"))


def plate_nms(s: SparkSession, d: str) -> DataFrame:
    own = associate.per_frame(_plates(s, d), "b", "pord", *BOX, "conf")
    kept = own.select(*KEY, F.explode(folds.suppress_overlapping(F.col("b"), "pord")).alias("b"))
    return kept.select(*KEY, "b.pord")


def vehicle_dedupe(s: SparkSession, d: str) -> DataFrame:
    own = associate.vehicle_arrays(_vehicles(s, d))
    return own.select(*KEY, F.posexplode(folds.dedupe_vehicles(F.col("vehicles"))).alias("place", "v")).select(*KEY, "place", *(f"v.{c}" for c in ("cls", *BOX, "conf")))


def held_nms(s: SparkSession, d: str) -> DataFrame:
    own = associate.vehicle_arrays(_vehicles(s, d))
    return own.select(*KEY, F.posexplode(folds.nms_held(F.col("vehicles"))).alias("place", "v")).select(*KEY, "place", "v.ord")


def one_plate_per_vehicle(s: SparkSession, d: str) -> DataFrame:
    own = associate.per_frame(_plates(s, d), "ps", "pord", *BOX, "conf").join(associate.vehicle_arrays(_vehicles(s, d)), list(KEY))
    own = own.select(*KEY, folds.one_plate_per_vehicle(F.col("ps"), F.col("vehicles")).alias("r"))
    tag = lambda c, k: own.select(*KEY, F.explode(f"r.{c}").alias("p")).select(*KEY, "p.pord", F.lit(k).alias("kept"))
    return tag("kept", True).unionByName(tag("suppressed", False))


def fixlist_merge(s: SparkSession, d: str) -> DataFrame:
    own = associate.per_frame(_plates(s, d), "b", *BOX, "pord")
    return own.select(*KEY, F.posexplode(folds.merge_touching_last(F.col("b"))).alias("place", "r")).select(*KEY, "place", *(f"r.{c}" for c in BOX))


def zone_coverage(s: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(_plates(s, d), _slot_zones(s, d)).select(*KEY, "pord", "frac", "verdict", "offset")


def observed_kept(s: SparkSession, d: str) -> DataFrame:
    return associate.split_by_zone(_plates(s, d).filter("pord >= 3"), _slot_zones(s, d)).select(*KEY, "pord", "kept")


def replay_frames(s: SparkSession, d: str) -> DataFrame:
    """Frames until the first that has no vehicle, as if those were the cached ones."""
    return redaction.replayed(_frames(s, d), _vehicles(s, d))


# Windows, aggregates


def detection_recall(s: SparkSession, d: str) -> DataFrame:
    return metrics.recall(_frames(s, d), _plates(s, d), _vehicles(s, d))


def plates_by_source(s: SparkSession, d: str) -> DataFrame:
    return metrics.moto_plates(_plates(s, d), _vehicles(s, d)).groupBy("src").agg(F.count("*").alias("n"))


def plate_size_medians(s: SparkSession, d: str) -> DataFrame:
    return metrics.plate_sizes(metrics.moto_plates(_plates(s, d), _vehicles(s, d)))


def key_second_hits(s: SparkSession, d: str) -> DataFrame:
    own = metrics.key_seconds(_plates(s, d), _vehicles(s, d), 2.0)
    return own.withColumn("sample_confs", F.array_join(F.transform("sample_confs", lambda c: F.format_string("%.3f", c)), ","))


def miss_examples(s: SparkSession, d: str) -> DataFrame:
    return metrics.misses(_plates(s, d), _vehicles(s, d), 29.97)


def gap_bridge_simple(s: SparkSession, d: str) -> DataFrame:
    return bridge.bridges(_slot_tracks(s, d), _sure(s, d)).drop("src")


def track_jitter(s: SparkSession, d: str) -> DataFrame:
    return metrics.jitter(metrics.track_points(_slot_zones(s, d)))


def jitter_summary(s: SparkSession, d: str) -> DataFrame:
    return metrics.jitter_report(track_jitter(s, d))


def track_blinks(s: SparkSession, d: str) -> DataFrame:
    return metrics.blinks(metrics.track_points(_slot_zones(s, d)))


def coverage_summary(s: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_report(metrics.coverage(_plates(s, d), _slot_zones(s, d)))


def slot_zone_stats(s: SparkSession, d: str) -> DataFrame:
    return metrics.zone_stats(_slot_zones(s, d))


def slot_zone_totals(s: SparkSession, d: str) -> DataFrame:
    return metrics.zone_totals(_slot_zones(s, d), _frames(s, d))


def fixlist_runs(s: SparkSession, d: str) -> DataFrame:
    flagged = _plates(s, d).filter("conf > 0.7")
    return metrics.runs(flagged, P.fps)


def _audited(s: SparkSession, d: str) -> DataFrame:
    """Plates with the event's value as a stand-in for the measured variance."""
    value = s.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    own = fixtures.frames(s, d).join(value, "event_id").select(*KEY, F.col("value").alias("var"))
    return _plates(s, d).join(own, list(KEY))


def audit_findings(s: SparkSession, d: str) -> DataFrame:
    known = _plates(s, d).filter("pord >= 20")
    return audit.findings(_audited(s, d), known, readable=50.0).select(*KEY, "pord", "readable")


def audit_fixlist(s: SparkSession, d: str) -> DataFrame:
    own = audit.fixlist(audit.findings(_audited(s, d), readable=50.0))
    return audit.read_fixlist(audit.fixlist_json(own))


def audit_percentiles(s: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(_audited(s, d), "var")


def run_summary(s: SparkSession, d: str) -> DataFrame:
    return metrics.run_summary(_frames(s, d), _plates(s, d), 12.5, P.fps)


def overlay_counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.overlay_counts(_slot_zones(s, d)).withColumn("tracks", F.array_join(F.transform("tracks", lambda t: t.cast("string")), ","))


def redaction_plan(s: SparkSession, d: str) -> DataFrame:
    forced = _plates(s, d).filter("pord >= 20").select(*KEY, *BOX)
    return redaction.plan(_frames(s, d), _slot_zones(s, d), P, (800, 1000, 1000, 1075), forced)


def draw_list(s: SparkSession, d: str) -> DataFrame:
    return redaction.draw_list(_vehicles(s, d), _slot_zones(s, d))


# Sampling and sets


def keep_one_in_n(s: SparkSession, d: str) -> DataFrame:
    own = sampling.crops_with_confs(_vehicles(s, d), _plates(s, d))
    return sampling.keep_one_in_n(own).select(*KEY, "ord", "stratum", "kept")


def stratum_counts(s: SparkSession, d: str) -> DataFrame:
    own = sampling.keep_one_in_n(sampling.crops_with_confs(_vehicles(s, d), _plates(s, d)))
    return own.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))


def crop_budget(s: SparkSession, d: str) -> DataFrame:
    own = sampling.keep_one_in_n(sampling.crops_with_confs(_vehicles(s, d), _plates(s, d))).filter("kept")
    dense = F.when(scalars.in_windows(F.col("frame") / F.lit(P.fps), scalars.parse_windows(F.lit("0:00-0:01"))), 0).otherwise(1)
    return sampling.within_budget(own.withColumn("phase", dense), 500, ("phase", "video_id", "frame", "ord")).select("phase", *KEY, "ord")


def export_quota(s: SparkSession, d: str) -> DataFrame:
    return sampling.moto_exports(_vehicles(s, d), _plates(s, d), 5, 3)


def best_plate_per_moto(s: SparkSession, d: str) -> DataFrame:
    own = metrics.moto_plates(_plates(s, d), _vehicles(s, d)).filter("geo")
    best = F.max_by("pord", F.struct("conf", (-F.col("pord")).alias("first")))
    return own.groupBy(*KEY, F.col("m.ord").alias("ord")).agg(best.alias("pord"), F.max("conf").alias("conf"))


def review_queue(s: SparkSession, d: str) -> DataFrame:
    """A review order over plates as entries, with made-up logs."""
    stem = F.format_string("v%d_%d_%d", F.col("video_id"), F.col("frame"), F.col("pord"))
    own = _plates(s, d).select(stem.alias("stem"), "pord")
    done = own.filter("pord % 3 = 0").select("stem", F.lit("kept").alias("status"))
    found = sampling.review_order(own, done, own.filter("pord >= 20").select("stem"))
    return found.groupBy("rank", "status").agg(F.count("*").alias("n"), F.min("stem").alias("first"))


# Caches


def cache_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Plates as cache lines and read back, numbers through their text forms."""
    lines = cache.to_lines(_frames(s, d), _plates(s, d), _vehicles(s, d), cache.meta(width=P.width, height=P.height))
    found = cache.plates(lines.withColumn("video", F.col("video_id")))
    return found.select(F.col("video").alias("video_id"), "frame", "pord", *BOX, "conf", "src")


def cache_headers(s: SparkSession, d: str) -> DataFrame:
    lines = cache.to_lines(_frames(s, d), _plates(s, d), _vehicles(s, d), cache.meta(width=P.width, height=P.height))
    found = cache.headers(lines.withColumn("video", F.col("video_id")))
    wanted = F.create_map(F.lit("width"), F.lit("1920"), F.lit("height"), F.lit("720"))
    diff = cache.meta_differences(F.map_filter("meta", lambda k, v: v.isNotNull()), wanted)
    return found.select(F.col("video").alias("video_id"), F.col("meta")["width"].alias("width"), "complete", F.array_join(diff, ",").alias("differs"))


def replay_index(s: SparkSession, d: str) -> DataFrame:
    start = F.when(F.col("video_id") % 4 != 0, F.col("video_id") * 0.5 + 0.25)
    whole = F.col("video_id") % 2 == 0
    at = cache.replay_index(F.col("frame"), start, F.lit(29.97), whole)
    fits = cache.range_compatible(F.when(F.col("frame") % 2 == 0, 0.0), F.when(F.col("frame") % 3 == 0, 5.0), start, F.lit(5.0))
    return _frames(s, d).select(*KEY, at.alias("at"), fits.alias("fits"))


# Sequential operators


class Tables:
    """The derived tables, written once for a query that reads them several times, as real detections would be."""

    def __init__(self, s: SparkSession, d: str):
        self.frames = shared.written(_frames(s, d), "fx-frames")
        self.vehicles = shared.written(_vehicles(s, d), "fx-vehicles")
        self.plates = shared.written(_plates(s, d), "fx-plates")

    def selected(self) -> DataFrame:
        return tracking.selected(self.frames, self.plates, self.vehicles)

    def zones(self) -> DataFrame:
        """Tracking is sequential Python: its result is written, and bridged from there."""
        return bridge.zones(shared.written(self.selected(), "selected"), self.vehicles)


def moto_gate(s: SparkSession, d: str) -> DataFrame:
    return tracking.gate_states(_frames(s, d), _vehicles(s, d))


def selected_dets(s: SparkSession, d: str) -> DataFrame:
    return Tables(s, d).selected()


def tracklets(s: SparkSession, d: str) -> DataFrame:
    own = selected_dets(s, d)
    return own.groupBy("video_id", "track_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


def zones(s: SparkSession, d: str) -> DataFrame:
    return Tables(s, d).zones()


def zone_stats(s: SparkSession, d: str) -> DataFrame:
    return metrics.zone_stats(zones(s, d))


def stability_report(s: SparkSession, d: str) -> DataFrame:
    own = Tables(s, d)
    return metrics.stability(own.plates, shared.written(own.zones(), "zones"), own.frames)


def held_vehicles(s: SparkSession, d: str) -> DataFrame:
    return holds.held(_frames(s, d), shared.written(_vehicles(s, d), "vehicles"))


def quad_states(s: SparkSession, d: str) -> DataFrame:
    """Quads followed over slot zones; every third estimate is missing."""
    inset = F.array(F.col("x1") + 2, F.col("y1") + 4, F.col("x2") - 2, F.col("y1") + 1, F.col("x2") - 1, F.col("y2") - 3, F.col("x1") + 1, F.col("y2") - 1).cast("array<double>")
    own = _slot_zones(s, d).withColumn("quad", F.when(F.col("frame") % 3 != 0, inset))
    found = quads.quad_states(own)
    return found.withColumn("points", F.array_join(F.transform("points", lambda v: v.cast("string")), " "))


def segments_of_videos(s: SparkSession, d: str) -> DataFrame:
    own = tracking.segments(_frames(s, d), _plates(s, d), _sure(s, d), P)
    return own.groupBy("video_id", "segment").agg(F.min("frame").alias("first"), F.count("*").alias("n"))


NAMES = (
    geometry_pairs, scalar_functions, crop_layout, letterbox_roundtrip, detected_plates, yolo_labels, yolo_roundtrip, warped_boxes,
    moto_conf_view, trackable_plates, plate_confidence_split, plate_geometry_filter, clip_frames, plate_vehicle_assoc, owned_plates_by_source,
    plate_nms, vehicle_dedupe, held_nms, one_plate_per_vehicle, fixlist_merge, zone_coverage, observed_kept, replay_frames,
    detection_recall, plates_by_source, plate_size_medians, key_second_hits, miss_examples, gap_bridge_simple, track_jitter, jitter_summary,
    track_blinks, coverage_summary, slot_zone_stats, slot_zone_totals, fixlist_runs, audit_findings, audit_fixlist, audit_percentiles, run_summary,
    overlay_counts, redaction_plan, draw_list, keep_one_in_n, stratum_counts, crop_budget, export_quota, best_plate_per_moto, review_queue,
    cache_roundtrip, cache_headers, replay_index,
    moto_gate, selected_dets, tracklets, zones, zone_stats, stability_report, held_vehicles, quad_states, segments_of_videos,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}



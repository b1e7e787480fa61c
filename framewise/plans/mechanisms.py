"""Queries of files that Spark writes and reads by formats of its own, and of plans for large tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import sql
from ..operators import filters, sampling, table_functions
from ..sources import cache, cache_sink, fixtures, frames_source
from .oracles import geometry_pairs, meets, q
from .queries import BOX, KEY, P, _frames, _plates, _vehicles

Query = Callable[[SparkSession, str], DataFrame]


def frames_of_clip(s: SparkSession, d: str) -> DataFrame:
    """A picture for each event, written as raw videos; of these, a clip is read by pushed bounds on frame and time."""
    pixel = F.expr("unhex(lpad(hex(event_id % 251), 2, '0'))")
    own = fixtures.frames(s, d).select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video"), "frame", F.lit(2).alias("height"), F.lit(3).alias("width"), F.concat(*[pixel] * 6).alias("content"))
    path = shared.new_dir(s, "videos")
    frames_source.write_frames(own, path)
    found = s.read.format("framewise_frames").option("span", "16").load(path).filter("frame >= 5 and frame < 40 and t > 0.25")
    return found.select(F.regexp_extract("video", r"v(\d+)\.y4m$", 1).cast("long").alias("video_id"), "frame", "t", "height", "width", F.hex("content").alias("content"))


def frames_sampled(s: SparkSession, d: str) -> DataFrame:
    """The same videos at seven pictures a second, from half a second on for one second: each with the time it is for."""
    pixel = F.expr("unhex(lpad(hex(event_id % 251), 2, '0'))")
    own = fixtures.frames(s, d).select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video"), "frame", F.lit(1).alias("height"), F.lit(1).alias("width"), pixel.alias("content"))
    path = shared.new_dir(s, "videos")
    frames_source.write_frames(own, path)
    found = s.read.format("framewise_frames").option("rate", "7").option("start", "0.5").option("end", "1.5").load(path)
    return found.select(F.regexp_extract("video", r"v(\d+)\.y4m$", 1).cast("long").alias("video_id"), "frame", "t", F.hex("content").alias("content"))


def committed_cache(s: SparkSession, d: str) -> DataFrame:
    """Detections written as caches by a job that commits, and read back with their headers."""
    path = shared.new_dir(s, "caches")
    cache_sink.write_cache(_frames(s, d), _plates(s, d), _vehicles(s, d), path, cache.meta(width=P.width, height=P.height))
    lines = cache_sink.read_lines(s, path)
    heads = cache.headers(lines).select("video", F.col("meta")["width"].alias("width"), "complete")
    return cache.plates(lines).join(heads, "video").select(F.col("video").alias("video_id"), "frame", "pord", *BOX, "conf", "src", "width", "complete")


def off_patches(s: SparkSession, d: str) -> DataFrame:
    """Plates away from all patches of their video: those where plates of its first frames were."""
    patches = _plates(s, d).filter("frame < 3 and pord < 20").select("video_id", *BOX)
    return filters.not_on_patches(_plates(s, d), patches).select(*KEY, "pord")


def pixels_within_budget(s: SparkSession, d: str) -> DataFrame:
    """The surest plates, as many as fit a budget of a third of all pixels, in one global order."""
    pixels = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long")
    own = _plates(s, d).withColumn("minus", -F.col("conf"))
    total = own.agg(F.sum(pixels)).first()[0] or 0
    return sampling.global_prefix(own, ("minus", *KEY, "pord"), total // 3, pixels).select(*KEY, "pord", "conf")


def geometry_in_sql(s: SparkSession, d: str) -> DataFrame:
    """All plates with all vehicles of their frame, as `geometry_pairs`, written by a user of SQL."""
    sql.register(s)
    box = lambda t: f"named_struct('x1', {t}.x1, 'y1', {t}.y1, 'x2', {t}.x2, 'y2', {t}.y2)"
    return s.sql(
        f"""with pairs as (select p.video_id, p.frame, p.pord, v.ord, v.cls, {box("p")} as a, {box("v")} as b from {{plates}} p join {{vehicles}} v using (video_id, frame)),
parts as (select *, fw_lerp(a, b, 0.25D) as l, fw_pose(a, b) as p, fw_placed(a, b) as q, fw_remainder(b, a) as r from pairs)
select video_id, frame, pord, ord, fw_iou(a, b) as iou, fw_overlaps(a, b, 8) as near, fw_covered_fraction(a, b) as covered, fw_distance(a, b) as dist,
  fw_area_floored(b) / fw_area_floored(a) <= {P.max_area_ratio}D as ratio_ok, l.x1 as lx1, p.x as px, q.x2 as qx2,
  fw_motion_ok(a, b, ord, b, {P.max_disp_px}D, {P.max_disp_frac}D) as motion, fw_class_link_ok(cls, 3, ord, 1) as class_link,
  fw_same_vehicle(a, b, {P.min_vehicle_iou}D) or ord between 0 and 1 as identity, fw_centre_in(a, b) as inside, r.x1 as rx1
from parts""",
        plates=_plates(s, d),
        vehicles=_vehicles(s, d),
    )


def _stand_in(rows):
    """In place of a model: as many boxes as the picture's brightness allows, each 20 pixels on."""
    out = []
    for row in rows:
        level = sum(bytes(row.content)) // len(row.content)
        out.append([(2 if k % 2 else 3, level + 20 * k, level, level + 20 * k + 15, level + 10, (level % 90 + 10) / 100) for k in range(level % 3)])
    return out


def detected_by_table_function(s: SparkSession, d: str) -> DataFrame:
    """A picture for each event through a detector called from SQL, video by video."""
    table_functions.register(s, _stand_in, "fw_detect", 8)
    pixel = F.expr("unhex(lpad(hex(event_id % 251), 2, '0'))")
    frames = fixtures.frames(s, d).select("video_id", "frame", F.concat(*[pixel] * 4).alias("content"))
    return s.sql("select video_id, frame, ord, cls, x1, y1, x2, y2, conf from fw_detect(table({frames}) partition by video_id order by frame)", frames=frames)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (frames_of_clip, frames_sampled, committed_cache, off_patches, pixels_within_budget, geometry_in_sql, detected_by_table_function)}


def oracle_sql() -> dict[str, str]:
    box = ", ".join(BOX)
    byte = "upper(printf('%02x', event_id % 251))"
    return {
        "detected_by_table_function": q("""select video_id, frame, cast(k as int) as ord, case when k % 2 = 1 then 2 else 3 end as cls, cast(b + 20 * k as int) as x1, cast(b as int) as y1, cast(b + 20 * k + 15 as int) as x2, cast(b + 10 as int) as y2,
  (b % 90 + 10) / cast(100 as double) as conf from (select video_id, frame, event_id % 251 as b from fx_frames) join range(2) r(k) on k < b % 3"""),
        "geometry_in_sql": f"select video_id, frame, pord, ord, iou, near, covered, dist, ratio_ok, lx1, px, qx2, motion, class_link, identity, inside, rx1 from ({geometry_pairs()})",
        "frames_of_clip": q(f"select video_id, frame, frame / cast(30 as double) as t, 2 as height, 3 as width, repeat({byte}, 6) as content from fx_frames where frame between 5 and 39 and frame / cast(30 as double) > cast(0.25 as double)"),
        # Row i shows the last frame k of those from 15 on with k * 7 / 30 < i + 1/2, in whole numbers 14 k < 60 i + 30 (14 = 2 * 7, 60 = 2 * 30).
        "frames_sampled": q(f"""select f.video_id, cast(i as int) as frame, cast(0.5 as double) + i / cast(7 as double) as t, {byte} as content
  from fx_frames f join range(7) r(i) on f.frame = 15 + (60 * i + 30 + 13) // 14 - 1"""),
        "off_patches": q(f"select video_id, frame, pord from fx_plates a where not exists (select 1 from fx_plates p where p.frame < 3 and p.pord < 20 and p.video_id = a.video_id and {meets('a.', 'p.', 8)})"),
        "pixels_within_budget": q("""select video_id, frame, pord, conf from (
    select *, sum((x2 - x1) * (y2 - y1)) over (order by conf desc, video_id, frame, pord rows unbounded preceding) as upto, sum((x2 - x1) * (y2 - y1)) over () as total from fx_plates)
  where upto <= total // 3"""),
        "committed_cache": q(f"select video_id, frame, cast(row_number() over (partition by video_id, frame order by pord) - 1 as int) as pord, {box}, conf, src, '{P.width}' as width, true as complete from fx_plates"),
    }

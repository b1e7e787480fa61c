"""Queries of media, labels, reviews and reports, each with its SQL below."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..operators import metrics, sampling
from ..schema import FILTERS
from ..sources import cache, fixtures, labels, media
from .oracles import MF, SLOTS, STRATA, E, cover_of, num, q
from .queries import BOX, KEY, P, _frames, _plates, _slot_zones, _vehicles

Query = Callable[[SparkSession, str], DataFrame]


def _ids(s: SparkSession, d: str) -> DataFrame:
    return fixtures.frames(s, d).select(F.col("event_id").alias("id"))


def _stem() -> Column:
    """Stems of made-up pictures, every fifth an augmented copy."""
    return F.concat(F.lit("p"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, labels.AUGMENTED).otherwise(""))


# Media


def video_probes(s: SparkSession, d: str) -> DataFrame:
    """Probes made from event ids: odd sizes, turned pictures, missing parts."""
    i = F.col("id")
    text = F.concat(
        F.lit('{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc", "width": '), (i % 100 + 1001).cast("string"), F.lit(', "height": '), (i % 70 + 501).cast("string"),
        F.lit(', "r_frame_rate": "'), (i % 3 * 30000 + 30000).cast("string"), F.lit('/1001"'),
        F.when(i % 2 == 0, F.concat(F.lit(', "duration": "'), (i % 50).cast("string"), F.lit('.5"'))).otherwise(""),
        F.when(i % 3 == 0, F.lit(', "pix_fmt": "yuv422p10le"')).otherwise(""),
        F.when(i % 4 == 0, F.lit(', "side_data_list": [{"side_data_type": "Display Matrix", "rotation": -90}]')).when(i % 4 == 1, F.lit(', "tags": {"rotate": "180"}')).otherwise(""),
        F.lit('}], "format": {"duration": "'), (i % 60).cast("string"), F.lit('.25"}}'),
    )
    return _ids(s, d).select("id", media.video_info(text).alias("v")).select("id", "v.*")


def color_flags(s: SparkSession, d: str) -> DataFrame:
    """Colour lines made from event ids; unknown and missing ones are left out."""
    i = F.col("id")
    lines = F.concat_ws("\n", F.lit("codec=hevc"), F.when(i % 2 == 0, F.lit("color_range=tv")), F.when(i % 3 == 0, F.lit("color_primaries=bt709")).otherwise(F.lit("color_primaries=unknown")), F.when(i % 5 != 0, F.concat(F.lit("color_space=s"), i % 7)))
    return _ids(s, d).select("id", F.array_join(media.color_flags(lines), " ").alias("flags"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, (".mp4", ".MOV", ".txt", ".jpg", ".mkv", "", ".png", ".JPG"))), (F.col("id") % 8).cast("int"))
    return _ids(s, d).select(F.concat(F.lit("/videos/v"), F.col("id").cast("string"), F.when(F.col("id") % 9 == 0, "_blurred").otherwise(""), ending).alias("path"))


def media_listing(s: SparkSession, d: str) -> DataFrame:
    """Videos of a made-up folder without the blurred ones; names with 77 go first."""
    return media.wanted(_paths(s, d), without="_blurred", first="77")


def stills_listing(s: SparkSession, d: str) -> DataFrame:
    return media.wanted(_paths(s, d), media.STILL_ENDINGS).select("path", "name")


def frame_times(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    times = media.frame_times((i % 7).cast("double"), (i % 7 + i % 3).cast("double"), F.lit(4.0))
    return _ids(s, d).select("id", F.posexplode(times).alias("n", "t"))


def frame_indices(s: SparkSession, d: str) -> DataFrame:
    """The frames that written caches hold."""
    lines = cache.to_lines(_frames(s, d), _plates(s, d), _vehicles(s, d), cache.meta(width=P.width, height=P.height))
    return cache.frames(lines.withColumn("video", F.col("video_id"))).select(F.col("video").alias("video_id"), "frame")


def vehicle_filters(s: SparkSession, d: str) -> DataFrame:
    """Vehicles that each filter lets through; an unknown filter lets all through."""
    vehicles = _vehicles(s, d)
    counted = [F.count_if(F.col("cls").isin(*scalars.filter_classes(name))).alias(f"n_{name}") for name in (*FILTERS, "unknown")]
    return vehicles.groupBy("video_id").agg(*counted)


def aligned_quads(s: SparkSession, d: str) -> DataFrame:
    """Vehicles' corners in another order against themselves, moved a little."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = [point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y1")), point(F.col("x2"), F.col("y2")), point(F.col("x1"), F.col("y2"))]
    shuffled = [F.struct((c["x"] + F.col("ord") * 7 - F.col("frame") % 5).alias("x"), (c["y"] + F.col("frame") % 3).alias("y")) for c in corners]
    turned = F.when(F.col("frame") % 2 == 0, F.array(*shuffled[2:], *shuffled[:2])).otherwise(F.array(*shuffled[::-1]))
    own = _vehicles(s, d).select(*KEY, "ord", F.array(*corners).alias("corners"), turned.alias("turned"))
    found = own.select(*KEY, "ord", g.aligned_quad(F.col("corners"), F.col("turned")).alias("quad"))
    points = [F.get("quad", i) for i in range(4)]
    return found.select(*KEY, "ord", F.concat_ws(",", *(F.concat(p["x"], F.lit(" "), p["y"]) for p in points)).alias("quad"))


# Labels and reviews


def _images(s: SparkSession, d: str) -> DataFrame:
    return _ids(s, d).select(sampling.split_of(_stem()).alias("split"), _stem().alias("stem"), "id")


def _label_lines(s: SparkSession, d: str) -> DataFrame:
    """Labels of three pictures in four; some are empty."""
    return _images(s, d).filter("id % 4 <> 0").select("split", "stem", F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("0 0.5 0.5 0.1 0."), F.col("id") % 9)).alias("value"))


def source_labels(s: SparkSession, d: str) -> DataFrame:
    """Source pictures with their labels."""
    return labels.with_labels(labels.source_images(_images(s, d)), _label_lines(s, d)).select("split", "stem", "value")


def review_entries(s: SparkSession, d: str) -> DataFrame:
    """Source pictures with a label that an editor touched."""
    edited = _images(s, d).filter("id % 2 = 0").select("stem")
    return sampling.review_entries(_images(s, d), _label_lines(s, d), edited, source_only=True, edited_only=True, labelled_only=True).select("split", "stem")


def review_status(s: SparkSession, d: str) -> DataFrame:
    """Review logs read, and counted by status."""
    status = F.get(F.array(*map(F.lit, ("kept", "edited", "skipped"))), (F.col("id") % 3).cast("int"))
    logs = _ids(s, d).select(F.to_json(F.create_map(_stem(), status)).alias("json"))
    return metrics.status_counts(labels.progress(logs))


def batch_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Made-up runs over videos: every seventh fails."""
    runs = _frames(s, d).select("video_id").distinct().select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("name"), (F.col("video_id") % 7 != 0).alias("ok"))
    return metrics.batch_outcome(runs).withColumn("names", F.array_join("names", ","))


def split_counts(s: SparkSession, d: str) -> DataFrame:
    stem = scalars.crop_stem(F.col("frame"), F.col("x1"), F.col("y1"))
    return sampling.split_counts(_vehicles(s, d).withColumn("split", sampling.split_of(stem)))


def keep_with_force(s: SparkSession, d: str) -> DataFrame:
    """One in n where nested vehicles are forced."""
    own = sampling.crops_with_confs(_vehicles(s, d), _plates(s, d))
    return sampling.keep_one_in_n(own, force=F.col("ord") >= 3).select(*KEY, "ord", "stratum", "kept")


def clicked_boxes(s: SparkSession, d: str) -> DataFrame:
    """A click per frame on a picture at half its size: around boxes, beside them, and far away."""
    boxes = _plates(s, d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pord", *BOX))).alias("b"))
    x, y = F.get("b", 0)["x1"] / 2 - F.col("frame") % 40 + 20, F.get("b", 0)["y1"] / 2 + F.col("frame") % 9
    at = sampling.hit(F.col("b"), x.cast("int"), y.cast("int"), F.lit(2.0), F.lit(2.0))
    return boxes.select(*KEY, F.get("b", at)["pord"].alias("pord"))


def label_texts(s: SparkSession, d: str) -> DataFrame:
    """The description of a training set and its manifest, as one row."""
    n = _ids(s, d).agg(F.count("*").alias("n"))
    return n.select(F.lit(labels.dataset_yaml("/data/set", 640)).alias("yaml"), F.lit(labels.manifest(kept=3, lost=1)).alias("manifest"), "n")


# Reports


def zones_by_source(s: SparkSession, d: str) -> DataFrame:
    return metrics.zones_by_source(_slot_zones(s, d))


def report_lists(s: SparkSession, d: str) -> DataFrame:
    return metrics.report_lists(metrics.coverage(_plates(s, d), _slot_zones(s, d)), _slot_zones(s, d))


def run_summary_quads(s: SparkSession, d: str) -> DataFrame:
    """The run summary where nested plates stand in for quads in use."""
    return metrics.run_summary(_frames(s, d), _plates(s, d), 12.5, P.fps, _plates(s, d).filter("pord >= 20"))


def metrics_json(s: SparkSession, d: str) -> DataFrame:
    """A report as JSON and read again."""
    text = labels.to_json(metrics.recall(_frames(s, d), _plates(s, d), _vehicles(s, d)))
    return text.select(F.from_json("json", "moto_frames long, frames long, recall_any double").alias("r")).select("r.*")


NAMES = (
    video_probes, color_flags, media_listing, stills_listing, frame_times, frame_indices, vehicle_filters, aligned_quads, source_labels, review_entries, review_status,
    batch_outcomes, split_counts, keep_with_force, clicked_boxes, label_texts, zones_by_source, report_lists, run_summary_quads, metrics_json,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}


IDS = "ids as (select event_id as id, 'p' || event_id || case when event_id % 5 = 0 then '_aug' else '' end as stem from fx_frames)"
PATHS = "paths as (select '/videos/v' || id || case when id % 9 = 0 then '_blurred' else '' end || (['.mp4', '.MOV', '.txt', '.jpg', '.mkv', '', '.png', '.JPG'])[cast(id % 8 as int) + 1] as path from ids)"


def split(stem: str) -> str:
    return f"case when cast('0x' || substr(md5({stem}), 1, 8) as bigint) % 100 < 15 then 'val' else 'train' end"


LINES = f"img as (select {split('stem')} as split, stem, id from ids), lin as (select split, stem, id, case when id % 3 = 0 then ' ' else '0 0.5 0.5 0.1 0.' || (id % 9) end as value from img where id % 4 <> 0)"


def quads_sql() -> str:
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    moved = [(f"({x} + ord * 7 - frame % 5)", f"({y} + frame % 3)") for x, y in corners]
    text = lambda ps: "concat_ws(',', " + ", ".join(f"{x} || ' ' || {y}" for x, y in ps) + ")"
    turns = lambda ps: [ps[-k:] + ps[:-k] for k in range(4)]
    cases = []
    for given in (moved[2:] + moved[:2], moved[::-1]):
        options = turns(given) + turns(given[::-1])
        errors = [" + ".join(f"({x} - {a}) * ({x} - {a}) + ({y} - {b}) * ({y} - {b})" for (x, y), (a, b) in zip(o, corners, strict=True)) for o in options]
        cases.append("(list_sort([" + ", ".join(f"{{e: {e}, n: {n}, t: {text(o)}}}" for n, (e, o) in enumerate(zip(errors, options, strict=True))) + "]))[1].t")
    return q(f"select video_id, frame, ord, case when frame % 2 = 0 then {cases[0]} else {cases[1]} end as quad from fx_vehicles")


def lists_sql() -> str:
    some = lambda kind, rows, order, value, most: f"select '{kind}' as kind, cast(place as int) as place, video_id, cast({value} as varchar) as value from (select *, row_number() over (order by {order}) as place from {rows}) where place <= {most}"
    wink = "(select p.video_id, p.frame, born_frame, born_zord from (select *, lead(frame) over (partition by video_id, track_id order by frame) - frame - 1 as gap from zs) p join (select video_id, track_id, min(row(frame, zord))[1] as born_frame, min(row(frame, zord))[2] as born_zord from zs group by all) using (video_id, track_id) where gap between 1 and 3)"
    return q(
        " union all ".join(
            (
                some("uncovered_frames", "(select distinct video_id, frame from cover where verdict = 'uncovered')", "video_id, frame", "frame", 40),
                some("micro_sizes", "(select * from cover where verdict = 'micro')", "video_id, frame, pord", "(x2 - x1) || 'x' || (y2 - y1)", 12),
                some("blink_frames", wink, "video_id, born_frame, born_zord, frame", "frame", 40),
            )
        ),
        f"zs as ({SLOTS})",
        cover_of("zs"),
    )


def oracle_sql() -> dict[str, str]:
    known = lambda key, flag: f"case when {key} in ('', 'unknown') then null else '{flag} ' || {key} end"
    w_, h_ = "(id % 100 + 1001) // 2 * 2", "(id % 70 + 501) // 2 * 2"
    x, y = "cast(trunc(x1 / cast(2 as double) - frame % 40 + 20) as int)", "cast(trunc(y1 / cast(2 as double) + frame % 9) as int)"
    box = ", ".join(f"p.{e} // 2 as {e}" for e in E)
    away = "sqrt(cast(power(greatest(x1, least(x2, x)) - x, 2) + power(greatest(y1, least(y2, y)) - y, 2) as double))"
    return {
        "video_probes": q(f"""select id, cast(case when id % 4 = 0 then {h_} else {w_} end as int) as width, cast(case when id % 4 = 0 then {w_} else {h_} end as int) as height, (id % 3 * 30000 + 30000) / cast(1001 as double) as fps, 'hevc' as codec,
  case when id % 3 = 0 then 'yuv422p10le' else 'yuv420p' end as pix_fmt, case when id % 2 = 0 then id % 50 + cast(0.5 as double) else id % 60 + cast(0.25 as double) end as duration from ids""", IDS),
        "color_flags": q(f"select id, concat_ws(' ', {known('prim', '-color_primaries')}, {known('spc', '-colorspace')}, {known('rng', '-color_range')}) as flags from (select id, case when id % 3 = 0 then 'bt709' else 'unknown' end as prim, case when id % 5 <> 0 then 's' || (id % 7) else '' end as spc, case when id % 2 = 0 then 'tv' else '' end as rng from ids)", IDS),
        "media_listing": q("select path, parse_filename(path) as name, case when contains(parse_filename(path), '77') then 0 else 1 end as priority from paths where regexp_matches(lower(path), '\\.(mp4|mov|avi|mkv|m4v)$') and not contains(path, '_blurred')", IDS, PATHS),
        "stills_listing": q("select path, parse_filename(path) as name from paths where regexp_matches(lower(path), '\\.(jpg|png)$')", IDS, PATHS),
        "frame_times": q("select id, cast(n as int) as n, id % 7 + n / cast(4 as double) as t from (select id, unnest(range(0, id % 3 * 4)) as n from ids)", IDS),
        "frame_indices": q("select distinct video_id, frame from fx_frames"),
        "vehicle_filters": q("select video_id, count(*) as n_all, count(*) filter (where cls = 3) as n_motorbike, count(*) filter (where cls = 2) as n_car, count(*) filter (where cls = 5) as n_bus, count(*) filter (where cls = 7) as n_truck, count(*) as n_unknown from fx_vehicles group by 1"),
        "aligned_quads": quads_sql(),
        "source_labels": q("select split, stem, value from lin where id % 5 <> 0", IDS, LINES),
        "review_entries": q("select split, stem from lin where id % 5 <> 0 and id % 2 = 0 and trim(value) <> ''", IDS, LINES),
        "review_status": q("select (['kept', 'edited', 'skipped'])[cast(id % 3 as int) + 1] as status, count(*) as n from ids group by 1", IDS),
        "batch_outcomes": q("select count(*) filter (where video_id % 7 <> 0) as succeeded, count(*) filter (where video_id % 7 = 0) as failed, coalesce(string_agg('v' || video_id, ',' order by 'v' || video_id) filter (where video_id % 7 = 0), '') as names from (select distinct video_id from fx_frames)"),
        "split_counts": q(f"select split, count(*) as crops, count(*) filter (where cls = 3) as motos from (select cls, {split('stem')} as split from (select cls, printf('f%06d_m%d_%d', frame, x1, y1) as stem from fx_vehicles)) group by 1"),
        "keep_with_force": q("select video_id, frame, ord, stratum, ord >= 3 or stratum = 'unsure' or row_number() over (partition by video_id, stratum, ord >= 3 order by frame, ord) % case stratum when 'moto_ok' then 4 when 'moto_empty' then 3 when 'car_ok' then 4 else 8 end = 0 as kept from strata", STRATA),
        "clicked_boxes": q(
            "select video_id, frame, cast(case when min(case when hit then row((x2 - x1) * (y2 - y1), i) end) is not null then arg_min(pord, row((x2 - x1) * (y2 - y1), i)) filter (where hit) else arg_min(pord, row(away, i)) filter (where away <= 18) end as int) as pord from bx group by video_id, frame",
            f"first_ as (select video_id, frame, {x} as x, {y} as y from (select *, row_number() over (partition by video_id, frame order by pord) as nth from fx_plates) where nth = 1)",
            f"bx as (select *, x between x1 and x2 and y between y1 and y2 as hit, {away} as away from (select p.video_id, p.frame, p.pord, row_number() over (partition by p.video_id, p.frame order by p.pord) as i, f.x, f.y, {box} from fx_plates p join first_ f using (video_id, frame)))",
        ),
        "label_texts": q("select 'path: /data/set' || chr(10) || 'train: images/train' || chr(10) || 'val: images/val' || chr(10) || 'nc: 1' || chr(10) || 'names:' || chr(10) || '  0: plate' || chr(10) || 'imgsz: 640' || chr(10) as yaml, '{' || chr(10) || '  \"kept\": 3,' || chr(10) || '  \"lost\": 1' || chr(10) || '}' as manifest, count(*) as n from fx_frames"),
        "zones_by_source": q(f"select src, count(*) as n from ({SLOTS}) group by 1"),
        "report_lists": lists_sql(),
        "run_summary_quads": q(f"select f as frames, p as plates, n as quads, f / {num(12.5)} as fps, f / {num(12.5)} / 30 as realtime, p / cast(f as double) as plates_per_frame, n / cast(f as double) as quads_per_frame from (select (select count(*) from fx_frames) as f, (select count(*) from fx_plates) as p, (select count(*) from fx_plates where pord >= 20) as n)"),
        "metrics_json": q("select count(*) as moto_frames, (select count(*) from fx_frames) as frames, count(*) filter (where n_any > 0) / cast(count(*) as double) as recall_any from mf", MF),
    }

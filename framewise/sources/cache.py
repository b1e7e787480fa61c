"""Detection caches: JSON lines in, tables out, and back.

A cache file is a header object, a line {"f": frame, "p": plates, "v": vehicles}
per frame, and a trailer {"eof": n} if it was completed. One file is one video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CACHE_VERSION, META_KEYS

#: Arrays of mixed types come as text and are cast.
LINE = "f int, p array<array<string>>, v array<array<double>>, eof long, version int"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """video (the file), value: the lines of caches, without blank ones."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("video"), "value")
    return rows.filter(F.trim("value") != "")


def frame_lines(lines: DataFrame) -> DataFrame:
    """video, frame, p, v; of lines with the same frame the last stays (by `at`, the line's place in the file, where given)."""
    own = lines.select("video", *(["at"] if "at" in lines.columns else [F.monotonically_increasing_id().alias("at")]), F.from_json("value", LINE).alias("r")).filter("r.f is not null")
    last = own.groupBy("video", F.col("r.f").alias("frame")).agg(F.max_by("r", "at").alias("r"))
    return last.select("video", "frame", "r.p", "r.v")


def frames(lines: DataFrame) -> DataFrame:
    """The frames that caches hold, also those without any box."""
    return frame_lines(lines).select("video", "frame")


def plates(lines: DataFrame) -> DataFrame:
    """video, frame, pord, box, conf (1 where missing), src (null where missing)."""
    own = frame_lines(lines).select("video", "frame", F.posexplode("p").alias("pord", "b"))
    edge = lambda i: F.col("b")[i].cast("double").cast("int")
    return own.select("video", "frame", "pord", *(edge(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.coalesce(F.get("b", 4).cast("double"), F.lit(1.0)).alias("conf"), F.get("b", 5).alias("src"))


def vehicles(lines: DataFrame) -> DataFrame:
    """video, frame, ord, cls, box, conf."""
    own = frame_lines(lines).select("video", "frame", F.posexplode("v").alias("ord", "b"))
    return own.select("video", "frame", "ord", F.col("b")[0].cast("int").alias("cls"), *(F.col("b")[i + 1].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.get("b", 5).alias("conf"))


def headers(lines: DataFrame) -> DataFrame:
    """video, meta (text values by key), complete: whether the trailer is there."""
    # Only lines with one of the two keys are parsed; a key may be escaped.
    head = F.when(F.col("value").rlike(r"version|eof|\\u"), F.from_json("value", "map<string,string>"))
    own = lines.select("video", head.alias("m"))
    return own.groupBy("video").agg(F.first(F.when(F.map_contains_key("m", "version"), F.col("m")), True).alias("meta"), F.count_if(F.map_contains_key("m", "eof")).alias("n")).select("video", "meta", (F.col("n") > 0).alias("complete"))


def is_open_bound(v: Column) -> Column:
    """No bound, or zero."""
    return v.isNull() | (v.cast("double") == 0)


def range_compatible(stored_start: Column, stored_end: Column, start: Column, end: Column) -> Column:
    """Equal ranges, or the stored one is the whole video."""
    return (stored_start.eqNullSafe(start) & stored_end.eqNullSafe(end)) | (is_open_bound(stored_start) & stored_end.isNull())


def meta_differences(stored: Column, wanted: Column) -> Column:
    """Keys on which two headers (maps) differ, ranges aside, in the format's order."""
    keys = F.array(*(F.lit(k) for k in META_KEYS if k not in ("start", "end")))
    return F.filter(keys, lambda k: ~F.try_element_at(stored, k).eqNullSafe(F.try_element_at(wanted, k)))


def meta(**values) -> dict:
    """The header for these parameters: known keys only, numbers rounded to six places."""
    return {"version": CACHE_VERSION} | {k: round(v, 6) if isinstance(v := values.get(k), float) else v for k in META_KEYS}


class CacheMismatch(RuntimeError):
    """A cache was made with other parameters."""


def check_headers(found: DataFrame, wanted: dict) -> None:
    """Raise CacheMismatch if any cache's version, parameters or range don't fit; one row a file is looked at."""
    text = F.create_map(*(x for k, v in wanted.items() for x in (F.lit(k), F.lit(None if v is None else str(v)).cast("string"))))
    bound = lambda m, k: F.try_element_at(m, F.lit(k)).cast("double")
    own = found.select("video", F.col("meta.version").alias("version"), meta_differences(F.col("meta"), text).alias("keys"), range_compatible(bound(F.col("meta"), "start"), bound(F.col("meta"), "end"), bound(text, "start"), bound(text, "end")).alias("fits"))
    bad = own.filter(~F.col("version").eqNullSafe(str(wanted["version"])) | (F.size("keys") > 0) | ~F.col("fits")).limit(5).collect()
    if bad:
        raise CacheMismatch("; ".join(f"{r.video}: version {r.version}, differs in {', '.join(r['keys']) or 'range'}" for r in bad))


def replay_index(clip_frame: Column, start: Column, fps: Column, stored_whole: Column) -> Column:
    """The cache's frame of a clip's frame: moved on by the start where the whole video was stored."""
    return F.when(stored_whole & (F.coalesce(start, F.lit(0.0)) > 0), clip_frame + F.rint(start * fps).cast("int")).otherwise(clip_frame)


def body_lines(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, key: str = "video_id") -> DataFrame:
    """key, at (the frame), value: a cache line for each frame."""
    p = plates.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct("pord", *_plate_json().values()))).alias("ps"))
    v = vehicles.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct("ord", _vehicle_json().alias("j")))).alias("vs"))
    rows = frames.select(key, "frame").distinct().join(p, [key, "frame"], "left").join(v, [key, "frame"], "left")
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["j"]), ", "), F.lit(""))
    line = F.concat(F.lit('{"f": '), F.col("frame").cast("string"), F.lit(', "p": ['), joined("ps"), F.lit('], "v": ['), joined("vs"), F.lit("]}"))
    return rows.select(key, F.col("frame").cast("long").alias("at"), line.alias("value"))


def to_lines(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, header: dict, key: str = "video_id") -> DataFrame:
    """key, at, value: cache lines of each video in file order, with header and trailer."""
    import json

    body = body_lines(frames, plates, vehicles, key)
    ends = frames.groupBy(key).agg(F.count_distinct("frame").alias("n"))
    top = ends.select(key, F.lit(-1).cast("long").alias("at"), F.lit(json.dumps(header)).alias("value"))
    tail = ends.select(key, F.lit(1 << 40).alias("at"), F.concat(F.lit('{"eof": '), F.col("n").cast("string"), F.lit("}")).alias("value"))
    return top.unionByName(body).unionByName(tail)


def _plate_json() -> dict[str, Column]:
    parts = [F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2", "conf")]
    src = F.when(F.col("src").isNotNull(), F.concat(F.lit(', "'), F.col("src"), F.lit('"'))).otherwise("")
    return {"j": F.concat(F.lit("["), F.concat_ws(", ", *parts), src, F.lit("]")).alias("j")}


def _vehicle_json() -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *(F.col(c).cast("string") for c in ("cls", "x1", "y1", "x2", "y2", "conf"))), F.lit("]"))


def write_lines(lines: DataFrame, path: str, key: str = "video_id") -> None:
    """A folder per video with its lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "at").select(key, "value").write.partitionBy(key).mode("errorifexists").text(path)


def write_tables(rows: DataFrame, path: str, key: str = "video_id") -> None:
    """The native form: Parquet, rows of a video together and in frame order."""
    rows.repartition(key).sortWithinPartitions(key, "frame").write.parquet(path)


def frame_order(rows: DataFrame) -> DataFrame:
    """Adds the place of a row's frame among its video's frames."""
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("video_id").orderBy("frame")) - 1)

"""Videos, pictures and folders: probe output, listings, stills, and pluggable decoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,duration:string,pix_fmt:string,"
    "tags:struct<rotate:string>,side_data_list:array<struct<side_data_type:string,rotation:double>>>>, format struct<duration:string>"
)
#: Endings of video files. Fixed values.
VIDEO_ENDINGS = (".mp4", ".mov", ".avi", ".mkv", ".m4v")
#: Probe field -> encoder flag. Fixed values.
COLOR_FLAGS = (("color_primaries", "-color_primaries"), ("color_transfer", "-color_trc"), ("color_space", "-colorspace"), ("color_range", "-color_range"))


def video_info(probe: Column) -> Column:
    """Width, height (as displayed, even), fps, codec, pix_fmt and duration of a probe's JSON."""
    r = F.from_json(probe, PROBE)
    v = F.filter(r["streams"], lambda s: s["codec_type"] == "video")[0]
    rate = F.split(v["r_frame_rate"], "/")
    matrix = F.filter(v["side_data_list"], lambda s: s["side_data_type"] == "Display Matrix")
    turn = F.coalesce(-F.get(matrix, 0)["rotation"].cast("int"), v["tags"]["rotate"].cast("int"), F.lit(0))
    upright = ~F.abs(turn).isin(90, 270)
    even = lambda n: (F.floor(n / 2) * 2).cast("int")
    return F.struct(
        even(F.when(upright, v["width"]).otherwise(v["height"])).alias("width"),
        even(F.when(upright, v["height"]).otherwise(v["width"])).alias("height"),
        (rate[0].cast("double") / rate[1].cast("double")).alias("fps"),
        v["codec_name"].alias("codec"),
        F.coalesce(v["pix_fmt"], F.lit("yuv420p")).alias("pix_fmt"),
        F.coalesce(F.when(v["duration"] != "", v["duration"]), r["format"]["duration"]).cast("double").alias("duration"),
    )


def color_flags(probe: Column) -> Column:
    """Encoder flags that keep a source's colours, from `key=value` lines; unknown ones are left out."""
    lines = F.filter(F.split(probe, r"\r?\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))
    known = lambda k: F.coalesce(F.try_element_at(pairs, F.lit(k)), F.lit(""))
    return F.flatten(F.array(*(F.when(known(k).isin("", "unknown"), F.array().cast("array<string>")).otherwise(F.array(F.lit(flag), known(k))) for k, flag in COLOR_FLAGS)))


#: Endings of pictures. Fixed values.
STILL_ENDINGS = (".jpg", ".png")


def wanted(paths: DataFrame, endings: tuple[str, ...] = VIDEO_ENDINGS, without: str | None = None, first: str | None = None) -> DataFrame:
    """`path` rows with these endings, whatever their case, with `name` and `priority`: 0 for names that hold `first`, else 1."""
    own = paths.withColumn("name", F.element_at(F.split("path", "/"), -1))
    own = own.filter(F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(*endings))
    own = own.filter(~F.contains("name", F.lit(without))) if without else own
    return own.withColumn("priority", F.when(F.contains("name", F.lit(first)), 0).otherwise(1) if first else F.lit(1))


def list_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = VIDEO_ENDINGS, without: str | None = None, first: str | None = None) -> DataFrame:
    """path, name and priority of a folder's files, in order of priority and name; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path")
    return wanted(found, endings, without, first).orderBy("priority", "name")


def stills(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of pictures, one row each; .jpg and .png."""
    return spark.read.format("binaryFile").load(folder).filter(F.lower(F.regexp_extract("path", r"\.[^.]*$", 0)).isin(*STILL_ENDINGS)).select("path", "content")


def frame_times(start: Column, end: Column, rate: Column) -> Column:
    """Times of frames that are sampled at a rate."""
    n = F.greatest(F.lit(0), F.ceil((end - start) * rate).cast("int"))
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: i < n), lambda i: start + i / rate)


def decoded(videos: DataFrame, decode: Callable[[str], Iterable[tuple[int, bytes, int, int]]]) -> DataFrame:
    """video, frame, content, height, width by a given decoder, one frame in memory at a time."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for frame, content, height, width in decode(path):
                    yield pa.RecordBatch.from_pydict({"video": [path], "frame": pa.array([frame], pa.int32()), "content": [content], "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32())})

    return videos.select("path").mapInArrow(run, "video string, frame int, content binary, height int, width int")


# Command lines as data for whoever runs them; flags and numbers are fixed values.


def extract_command(path: str, start: float | None, end: float | None, codec: str | None = None) -> list[str]:
    """The decoder's command line for a clip as raw frames."""
    seek = ["-ss", f"{start:.3f}"] if start else []
    length = ["-t", f"{end - (start or 0):.3f}"] if end else []
    return ["ffmpeg", "-v", "error", *(["-c:v", codec] if codec else []), *seek, "-i", path, *length, "-vf", "scale=trunc(iw/2)*2:trunc(ih/2)*2", "-f", "rawvideo", "-pix_fmt", "bgr24", "-"]


def encode_command(width: int, height: int, fps: float, path: str) -> list[str]:
    """The lossless encoder's command line."""
    return ["ffmpeg", "-y", "-f", "rawvideo", "-pix_fmt", "bgr24", "-s", f"{width}x{height}", "-r", f"{fps}", "-i", "-", "-c:v", "ffv1", path]


def audio_command(path: str, out: str, start: float | None, end: float | None) -> list[str]:
    """The command line that takes a clip's sound as it is, its times beginning at 0."""
    seek = [] if start is None else ["-ss", f"{start:.6f}"]
    length = [] if end is None else ["-t", f"{end - (start or 0.0):.6f}"]
    return ["ffmpeg", "-y", *seek, "-i", path, *length, "-vn", "-c:a", "copy", "-reset_timestamps", "1", out]


def mux_commands(video: str, sound: str, out: str, gpu: bool, quality: int = 18, preset: str = "medium", colors: list[str] | tuple[str, ...] = ()) -> list[list[str]]:
    """What to try in turn: the final encoding with sound, then without. `gpu`: whether the hardware encoder works there."""
    encoder = ["-c:v", "hevc_nvenc", "-rc", "vbr", "-cq", str(quality), "-preset", "p4", "-bf", "0"] if gpu else ["-c:v", "libx265", "-crf", str(quality), "-preset", preset]
    encoder += ["-tag:v", "hvc1", "-pix_fmt", "yuv420p", *colors]
    end = ["-movflags", "+faststart", out]
    return [
        ["ffmpeg", "-y", "-i", video, "-i", sound, "-map", "0:v:0", "-map", "1:a:0", *encoder, "-c:a", "copy", *end],
        ["ffmpeg", "-y", "-i", video, *encoder, *end],
    ]


def decoder_for(codec: str, gpu: bool) -> str | None:
    """The hardware decoder of a codec where there is one, else none (the default)."""
    return {"h264": "h264_cuvid", "hevc": "hevc_cuvid", "av1": "av1_cuvid", "vp9": "vp9_cuvid"}.get(codec) if gpu else None


# Pictures as files


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG (grey, RGB, with alpha or not, no interlace) as an array in B, G, R(, A) order; raises ValueError for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("a kind of PNG that isn't read here")
    width, height = head[:2]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, channels).astype(np.int64)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + above) & 255
        elif kind == 1:
            now = np.cumsum(line, 0) & 255
        else:
            now = np.zeros_like(line)
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    far = np.abs(np.stack([p - left, p - up, p - corner]))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                left, corner = (line[x] + guess) & 255, up
                now[x] = left
        out[y], above = now, now
    return out if channels < 3 else out[..., [2, 1, 0, *range(3, channels)]]


def write_png(picture: np.ndarray) -> bytes:
    """A picture in B, G, R(, A) order, or grey, as a PNG."""
    picture = picture if picture.ndim == 3 else picture[..., None]
    height, width, channels = picture.shape
    rgb = picture if channels < 3 else picture[..., [2, 1, 0, *range(3, channels)]]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def overlay_image(spark: SparkSession, path: str) -> np.ndarray:
    """A cover picture with its alpha, by Spark's reader, so that any file system works; an error if it can't be read."""
    return read_png(bytes(spark.read.format("binaryFile").load(path).first().content))

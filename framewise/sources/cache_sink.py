"""Caches written by tasks side by side, complete only when the job commits: `df.write.format("framewise_cache")`.

A video is a folder `video_id=<id>` of files of JSON lines. Each task writes its
frames of a video as one file, beginning with the header, under a hidden name;
the file gets its name when the task has written all of it. The trailer with the
number of frames, a file of its own, comes last, when every task has reported.

So an attempt that fails leaves no line that a reader sees; a job that ends early
leaves videos without a trailer, which read as partial (`cache.headers`); and the
same job once more replaces what was there, and the video reads as whole. Only
files that the commit's messages name stay, so a task that ran twice counts once.

Rows: video_id, at (order within the video), value (a frame's line). Options:
`header`, the header's JSON line. A null video_id or value is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..shipping import ship
from . import cache, files

SCHEMA = "video_id long, at long, value string"
TRAILER = "eof.jsonl"
#: Bytes of a file that one task reads in a row, and bytes and lines of one batch.
RANGE_BYTES, BATCH_BYTES, BATCH_LINES = 64 << 20, 4 << 20, 10_000


class CacheWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.files, self.header = files.AttemptFiles(options["path"]), options["header"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), []
        video, stream, end, n = None, None, None, 0
        for own, value in (row for batch in iterator for row in zip(*(batch.column(c).to_pylist() for c in ("video_id", "value")), strict=True)):
            if own is None or value is None:
                raise ValueError("a line without a video or a value")
            if own != video:
                if video is not None:
                    end()
                    done.append((name, n))
                video, n, name = own, 0, f"video_id={own}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.jsonl"
                stream, end = self.files.begin(name)
                stream.write(self.header.encode() + b"\n")
            stream.write(value.encode() + b"\n")
            n += 1
        if video is not None:
            end()
            done.append((name, n))
        return self.files.done(done)

    def commit(self, messages) -> None:
        """A video's trailer last: a commit that breaks off leaves partial videos, never a whole one with missing lines."""
        self.files.commit(messages, (TRAILER, lambda n: json.dumps({"eof": n}).encode() + b"\n"))

    def abort(self, messages) -> None:
        self.files.clear()


class CacheSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "framewise_cache"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> CacheWriter:
        return CacheWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CacheSink)


def write(lines: DataFrame, path: str, header: dict) -> None:
    """Frames' lines (video_id, at, value) as caches. A long video is written by several tasks."""
    register(lines.sparkSession)
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lines.select("video_id", F.col("at").cast("long").alias("at"), "value").repartitionByRange(parts, "video_id", "at").sortWithinPartitions("video_id", "at")
    own.write.format("framewise_cache").option("header", json.dumps(header)).mode("append").save(path)


def write_cache(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, path: str, header: dict) -> None:
    """Tables as caches; header and trailer come from the writer."""
    write(cache.body_lines(frames, plates, vehicles), path, header)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """video (its video_id), value: the lines of written caches, also of partial ones.

    The driver lists nothing: one task lists the videos' folders, others their files, and
    others read these, long ones in ranges.
    """
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(path,)], "root string").mapInArrow(_folders, "root string, video long")
    ranges = folders.repartition(parts, "video").mapInArrow(_ranges, "path string, video long, low long, high long")
    lines = ranges.repartition(parts, "path", "low").mapInArrow(_lines, "video long, value string")
    return lines.filter(F.trim("value") != "")


def _folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The videos' folders."""
    for root in (r for batch in batches for r in batch.column("root").to_pylist()):
        system, path = files.opened(root)
        names = (f.base_name for f in system.get_file_info(files.fs.FileSelector(path)) if f.type == files.fs.FileType.Directory)
        videos = [int(found[1]) for name in names if (found := re.fullmatch(r"video_id=(-?\d+)", name))]
        for i in range(0, len(videos), BATCH_LINES):
            own = pa.array(videos[i : i + BATCH_LINES], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([root] * len(own), pa.string()), own], ["root", "video"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of the folders' files."""
    for batch in batches:
        found = []
        for root, video in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            uri = f"{root.rstrip('/')}/video_id={video}"
            system, path = files.opened(uri)
            for f in system.get_file_info(files.fs.FileSelector(path)):
                if f.type == files.fs.FileType.File and f.base_name.endswith(".jsonl") and f.base_name[0] not in "_.":
                    found += [(f"{uri}/{f.base_name}", video, k, min(k + RANGE_BYTES, f.size)) for k in range(0, f.size, RANGE_BYTES)]
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "video", "low", "high"), r, strict=True)) for r in found], pa.schema([("path", pa.string()), ("video", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the ranges."""
    videos, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(videos, pa.int64()), pa.array(values, pa.string())], ["video", "value"])

    for path, video, low, high in (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "video", "low", "high")), strict=True)):
        for line in _lines_of(path, low, high):
            videos.append(video)
            values.append(line.decode("utf-8", "replace"))
            size += len(line)
            if size >= BATCH_BYTES or len(videos) >= BATCH_LINES:
                yield batch()
                videos, values, size = [], [], 0
    if videos:
        yield batch()


def _lines_of(path: str, low: int, high: int) -> Iterator[bytes]:
    """A file's lines that begin from low to high - 1."""
    system, where = files.opened(path)
    at = max(0, low - 1)
    with system.open_input_file(where) as stream:
        stream.seek(at)
        rest, begun = b"", low == 0
        while data := stream.read(1 << 20):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                if begun and at >= high:
                    return
                if begun:
                    yield line.removesuffix(b"\r")
                begun = True
                at += len(line) + 1
        if begun and rest and at < high:
            yield rest.removesuffix(b"\r")

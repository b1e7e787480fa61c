"""Tasks on detection caches from the command line: `python -m framewise TASK CACHE... [options]`.

Each task reads caches with Spark and writes a table as Parquet, or prints it
as JSON lines. Videos are numbered by the hash of their cache's path.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import geometry as g
from .functions import scalars
from .operators import audit, bridge, filters, holds, metrics, redaction, sampling, tracking
from .schema import DEFAULTS, Params
from .sources import cache, labels


class Caches:
    """The tables of caches, cut to a range of frames."""

    def __init__(self, spark: SparkSession, paths: list[str], p: Params, start: int | None = None, end: int | None = None):
        lines = cache.read_lines(spark, paths)
        own = lambda rows: filters.in_range(rows.withColumn("video_id", F.xxhash64("video")).drop("video"), start, end)
        self.p, self.lines = p, lines
        self.frames, self.plates, self.vehicles = own(cache.frames(lines)), own(cache.plates(lines)), own(cache.vehicles(lines))

    def names(self) -> DataFrame:
        """video_id and stem, the name of each cache's file without its ending."""
        return self.lines.select("video").distinct().select(F.xxhash64("video").alias("video_id"), labels.stem(F.col("video")).alias("stem"))

    def fixes(self, path: str) -> DataFrame:
        """The patches of fixlists (a JSON file or a folder of them), each for the video whose cache is named like it."""
        texts = self.frames.sparkSession.read.text(path, wholetext=True)
        named = texts.select(labels.stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("json"))
        return audit.read_fixlist(self.names().join(named, "stem").select("video_id", "json"))

    def selected(self) -> DataFrame:
        return tracking.selected(self.frames, self.plates, self.vehicles, self.p)

    def zones(self) -> DataFrame:
        return bridge.zones(shared.written(self.selected(), "selected"), self.vehicles, self.p)


def plan(c: Caches, args: argparse.Namespace) -> DataFrame:
    """What to redact: zones, the own plate, and each video's fixlist."""
    own = tuple(int(v) for v in args.own_plate.split(",")) if args.own_plate else None
    return redaction.plan(c.frames, c.zones(), c.p, own, c.fixes(args.fixlist) if args.fixlist else None, args.mode)


def audited(c: Caches, args: argparse.Namespace) -> DataFrame:
    """Plates that a redacted video still shows, away from known patches; readable if the measured sharpness says so.

    Sharpness comes as Parquet: stem, frame, pord, var.
    """
    found = c.plates.withColumn("var", F.lit(None).cast("double"))
    if args.measured:
        measured = c.names().join(c.frames.sparkSession.read.parquet(args.measured), "stem").select("video_id", "frame", "pord", "var")
        found = c.plates.join(measured, ["video_id", "frame", "pord"], "left")
    return audit.findings(found, c.fixes(args.fixlist) if args.fixlist else None, readable=args.readable)


def fixlists(c: Caches, args: argparse.Namespace) -> DataFrame:
    """stem and JSON of each video's new fixlist."""
    return audit.fixlist_json(audit.fixlist(audited(c, args))).join(c.names(), "video_id").select("stem", "json")


def exports(c: Caches, args: argparse.Namespace) -> DataFrame:
    """Rear crops of motorcycles with stem, split and label line; label files are written where asked."""
    crops = sampling.moto_exports(c.vehicles, c.plates, args.positives, args.negatives, c.p).join(c.names().withColumnRenamed("stem", "_video"), "video_id")
    stem = F.concat_ws("_", "_video", F.col("frame").cast("string"), F.col("ord").cast("string"))
    line = labels.label_line(F.lit(0), g.columns("l"), (F.col("rx2") - F.col("rx1")).cast("double"), (F.col("ry2") - F.col("ry1")).cast("double"))
    found = crops.withColumns({"stem": stem, "split": sampling.split_of(stem), "value": F.when(F.col("positive"), line).otherwise("")}).drop("_video")
    if args.labels:
        for split in ("train", "val"):
            labels.write_labels(found.filter(F.col("split") == split).withColumn("line_no", F.lit(0)), f"{args.labels}/{split}")
    return found


#: Task -> what it gives.
TASKS = {
    "tracks": lambda c, a: c.selected(),
    "zones": lambda c, a: c.zones(),
    "held": lambda c, a: holds.held(c.frames, c.vehicles, c.p),
    "plan": plan,
    "stability": lambda c, a: metrics.stability(c.plates, shared.written(c.zones(), "zones"), c.frames),
    "recall": lambda c, a: metrics.recall(c.frames, c.plates, c.vehicles),
    "misses": lambda c, a: metrics.misses(c.plates, c.vehicles, a.fps),
    "crops": lambda c, a: sampling.keep_one_in_n(sampling.crops_with_confs(c.vehicles.filter(F.col("cls").isin(*scalars.filter_classes(a.vehicles))), c.plates)),
    "exports": exports,
    "audit": audited,
    "fixlists": fixlists,
    "seconds": lambda c, a: metrics.key_seconds(c.plates, c.vehicles, a.fps),
    "headers": lambda c, a: cache.headers(c.lines),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="framewise", description=__doc__)
    out.add_argument("task", choices=TASKS)
    out.add_argument("caches", nargs="+", help="files or folders of JSON lines")
    out.add_argument("--out", help="folder for the result as Parquet; else it is printed")
    out.add_argument("--config", help="TOML file with parameters")
    out.add_argument("--start", type=int, help="first frame")
    out.add_argument("--end", type=int, help="frame after the last")
    out.add_argument("--fps", type=float, default=DEFAULTS.fps)
    out.add_argument("--vehicles", default="all", help="filter of vehicle classes")
    out.add_argument("--mode", default="blur", choices=("blur", "color", "image"))
    out.add_argument("--own-plate", help="x1,y1,x2,y2 to redact in every frame")
    out.add_argument("--fixlist", help="JSON file of patches, or a folder of such files, named like the caches")
    out.add_argument("--measured", help="Parquet with the sharpness of plates: stem, frame, pord, var")
    out.add_argument("--readable", type=float, default=150.0, help="sharpness from which a plate is readable")
    out.add_argument("--labels", help="folder for label files of exports")
    out.add_argument("--positives", type=int, default=400)
    out.add_argument("--negatives", type=int, default=200)
    return out


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    """The result of a command line; written where asked."""
    args = parser().parse_args(argv)
    p = labels.load_config(Path(args.config).read_text()) if args.config else DEFAULTS
    found = TASKS[args.task](Caches(spark, args.caches, p, args.start, args.end), args)
    if args.out:
        found.write.mode("error").parquet(args.out)
    return found


def main() -> None:
    spark = SparkSession.builder.appName("framewise").getOrCreate()
    found = run(spark)
    if not parser().parse_args().out:
        for row in labels.to_json(found).toLocalIterator():
            print(row.json)
    shared.discard_all(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""YOLO labels, review logs, configuration, manifests."""

from __future__ import annotations

import json
import tomllib
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import DEFAULTS, Params

AUGMENTED = "_aug"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """stem, value: label lines with the stem of their file."""
    return spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("stem"), "value")


def parse_labels(lines: DataFrame, width: Column, height: Column, truncate: bool = False) -> DataFrame:
    """Adds cls and pixel edges to lines `cls cx cy w h`; shorter ones go. Truncated to ints on request."""
    parts = F.split(F.trim("value"), r"\s+")
    own = lines.withColumn("_p", parts).filter(F.size("_p") >= 5)
    y = g.Yolo(*(F.col("_p")[i].cast("double") for i in range(1, 5)))
    box = g.from_yolo(y, width, height)
    edges = {n: (c.cast("int") if truncate else c) for n, c in zip(g.Box._fields, box, strict=True)}
    return own.withColumns({"cls": F.col("_p")[0].cast("int"), **edges}).drop("_p")


def label_line(cls: Column, b: g.Box, width: Column, height: Column) -> Column:
    """`cls cx cy w h` with six decimals (halves go up), kept within the picture."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, *g.to_yolo(b, width, height))


def write_labels(rows: DataFrame, path: str) -> None:
    """A folder per stem with its lines in order."""
    rows.repartition("stem").sortWithinPartitions("stem", "line_no").select("stem", "value").write.partitionBy("stem").text(path)


def progress(rows: DataFrame) -> DataFrame:
    """stem, status of review logs (JSON maps in `json`)."""
    return rows.select(F.explode(F.from_json("json", "map<string,string>")).alias("stem", "status"))


def with_labels(images: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Pictures and their labels by split and stem."""
    return images.join(labels, ["split", "stem"], how)


def source_images(images: DataFrame) -> DataFrame:
    """Pictures that aren't augmented copies."""
    return images.filter(~F.contains("stem", F.lit(AUGMENTED)))


#: Configuration key -> parameter. Fixed values.
CONFIG_KEYS = {
    ("detection", "moto_min_conf"): "moto_min_conf",
    ("blur", "strength"): "blur_strength",
    ("blur", "padding"): "blur_padding",
    ("blur", "max_box_frac"): "max_box_frac",
    ("zones", "max_gap_frames"): "max_gap",
    ("zones", "max_disp_px"): "max_disp_px",
    ("zones", "max_disp_frac"): "max_disp_frac",
    ("zones", "min_vehicle_iou"): "min_vehicle_iou",
    ("zones", "conf_floor"): "conf_floor",
    ("zones", "min_plate_side_px"): "min_plate_side",
    ("zones", "max_area_ratio"): "max_area_ratio",
    ("zones", "max_class_flip_frames"): "max_class_flip",
    ("zones", "moto_min_blur_box_h_frac"): "moto_min_h_frac",
    ("zones", "moto_size_enter_frac"): "size_enter",
    ("zones", "moto_size_exit_frac"): "size_exit",
    ("preprocessing", "plate_crop_imgsz"): "crop_size",
    ("preprocessing", "vehicle_crop_scale"): "vehicle_crop_scale",
    ("preprocessing", "moto_crop_scale"): "moto_crop_scale",
    ("preprocessing", "moto_crop_bottom_frac"): "moto_crop_bottom",
    ("preprocessing", "moto_crop_side_pad_frac"): "moto_crop_side",
}


def load_config(text: str, base: Params = DEFAULTS) -> Params:
    """Parameters of a TOML text over the defaults."""
    found = tomllib.loads(text)
    types = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    given = {name: types[name](found[section][key]) for (section, key), name in CONFIG_KEYS.items() if key in found.get(section, {})}
    return replace(base, **given)


def dataset_yaml(root: str, size: int, names: tuple[str, ...] = ("plate",)) -> str:
    """A training set's description."""
    lines = [f"path: {root}", "train: images/train", "val: images/val", f"nc: {len(names)}", "names:", *(f"  {i}: {n}" for i, n in enumerate(names)), f"imgsz: {size}"]
    return "\n".join(lines) + "\n"


def manifest(**counts) -> str:
    return json.dumps(counts, indent=2)


def to_json(report: DataFrame) -> DataFrame:
    """A report's rows as JSON texts."""
    return report.select(F.to_json(F.struct("*")).alias("json"))

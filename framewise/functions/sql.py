"""The geometry as SQL functions: `register(spark)`, then `select fw_iou(a, b) ...`.

Each is a temporary SQL function made from the same Column expression that the
operators use, so plans stay free of Python and both forms agree. Boxes are
structs of x1, y1, x2, y2; results with several parts are structs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry as g

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
#: Kinds of parameters.
KINDS = {"box": BOX, "int": "int", "double": "double"}


def _pose(p: g.Pose) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip(g.Pose._fields, p, strict=True)))


#: Name -> parameters and the expression of them; boxes come as `Box`.
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "fw_iou": ({"a": "box", "b": "box"}, g.iou),
    "fw_overlaps": ({"a": "box", "b": "box", "margin": "int"}, lambda a, b, margin: g.overlaps(a, b, margin)),
    "fw_covered_fraction": ({"a": "box", "b": "box"}, g.covered_fraction),
    "fw_distance": ({"a": "box", "b": "box"}, g.distance),
    "fw_diagonal": ({"a": "box"}, g.diagonal),
    "fw_area": ({"a": "box"}, g.area),
    "fw_area_floored": ({"a": "box"}, g.area_floored),
    "fw_min_side": ({"a": "box"}, g.min_side),
    "fw_max_side": ({"a": "box"}, g.max_side),
    "fw_relative_area": ({"a": "box", "b": "box"}, g.relative_area),
    "fw_lerp": ({"a": "box", "b": "box", "t": "double"}, lambda a, b, t: g.lerp(a, b, t).struct()),
    "fw_pose": ({"a": "box", "b": "box"}, lambda a, b: _pose(g.pose(a, b))),
    "fw_placed": ({"a": "box", "b": "box"}, lambda a, b: g.placed(g.pose(a, b), b).struct()),
    "fw_motion_ok": ({"a": "box", "b": "box", "gap": "int", "v": "box", "px": "double", "frac": "double"}, lambda a, b, gap, v, px, frac: (gap <= 0) | (g.distance(a, b) <= F.greatest(px, g.diagonal(v) * frac) * gap * 1.15)),
    "fw_class_link_ok": ({"x": "int", "y": "int", "gap": "int", "flip": "int"}, g.class_link_ok),
    "fw_same_vehicle": ({"a": "box", "b": "box", "least": "double"}, lambda a, b, least: (g.iou(a, b) >= least) | g.overlaps(a, b)),
    "fw_centre_in": ({"a": "box", "b": "box"}, g.centre_in),
    "fw_remainder": ({"a": "box", "b": "box"}, g.remainder),
}


def text_of(spark: SparkSession, name: str) -> str:
    """The statement that makes a function."""
    kinds, made = FUNCTIONS[name]
    own: DataFrame = spark.createDataFrame([], ", ".join(f"{p} {KINDS[k]}" for p, k in kinds.items()))
    found = own.select(made(*(g.fields(F.col(p)) if k == "box" else F.col(p) for p, k in kinds.items())).alias("value"))
    # The analysed expression in Spark's own SQL.
    body = found._jdf.queryExecution().analyzed().expressions().head().child().sql()
    params = ", ".join(f"{p} {KINDS[k]}" for p, k in kinds.items())
    return f"create or replace temporary function {name}({params}) returns {found.schema['value'].dataType.simpleString()} return {body}"


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session; their names."""
    for name in FUNCTIONS:
        spark.sql(text_of(spark, name))
    return [*FUNCTIONS]

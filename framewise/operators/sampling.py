"""Choosing crops for training sets: one in n, budgets, quotas, splits, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry as g
from ..schema import DEFAULTS, MOTO, Params
from ..sources import labels
from . import associate

# The band of unsure confidences, and one crop in how many is kept of each kind.
UNSURE = (0.05, 0.25)
ONE_IN = {"moto_ok": 4, "moto_empty": 3, "car_ok": 4, "car_empty": 8}


def strata(crops: DataFrame) -> DataFrame:
    """Adds `stratum` to crops with `cls` and `confs` (their plates' confidences): unsure, or kind and whether a plate is sure."""
    unsure = F.exists("confs", lambda c: (c >= UNSURE[0]) & (c < UNSURE[1]))
    sure = F.exists("confs", lambda c: c >= UNSURE[1])
    kind = F.when(F.col("cls") == MOTO, F.when(sure, "moto_ok").otherwise("moto_empty")).otherwise(F.when(sure, "car_ok").otherwise("car_empty"))
    return crops.withColumn("stratum", F.when(unsure, "unsure").otherwise(kind))


def keep_one_in_n(crops: DataFrame, by: tuple[str, ...] = ("video_id",), order: tuple[str, ...] = ("frame", "ord"), force: Column | None = None) -> DataFrame:
    """Crops with `kept`: unsure and forced ones always, of the others each n-th of its stratum; forced ones aren't counted."""
    own = strata(crops).withColumn("_forced", F.lit(False) if force is None else F.coalesce(force, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*by, "stratum", "_forced").orderBy(*order))
    every = F.create_map(*(F.lit(x) for pair in ONE_IN.items() for x in pair))
    sampled = F.coalesce(nth % F.try_element_at(every, F.col("stratum")) == 0, F.lit(False))
    return own.withColumn("kept", F.col("_forced") | (F.col("stratum") == "unsure") | sampled).drop("_forced")


def crops_with_confs(vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    """Vehicles with the confidences of the plates whose centre they hold, in list order."""
    arrays = associate.per_frame(plates, "plates", "pord", *g.Box._fields, "conf")
    own = vehicles.join(arrays, ["video_id", "frame"], "left")
    inside = F.filter(F.coalesce("plates", F.expr("cast(array() as array<struct<pord:int,x1:int,y1:int,x2:int,y2:int,conf:double>>)")), lambda q: g.centre_in(g.fields(q), g.columns()))
    return own.withColumn("confs", F.transform(inside, lambda q: q["conf"])).drop("plates")


#: Up to so many rows Spark finds the first of an order by keeping each task's first ones.
TOP = 10_000


def within_budget(crops: DataFrame, budget: int, order: tuple[str, ...]) -> DataFrame:
    """The first `budget` crops of a global order."""
    return crops.orderBy(*order).limit(budget) if budget <= TOP else global_prefix(crops, order, budget)


def global_prefix(rows: DataFrame, order: tuple[str, ...], budget: float, weight: Column | None = None) -> DataFrame:
    """The first rows of a global order whose weights (one each by default) add up to at most `budget`.

    Rows are dealt by ranges of the order; a sum for each range tells which ranges
    stay whole and which one the budget ends in, and only in that one weights are
    summed row by row. Ties of the whole order are ordered by nothing else, so an
    order should end in a key. Null weights count as 0; negative ones are refused.
    """
    own = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    own = F.when(own < 0, F.raise_error(F.lit("a negative weight")).cast("double")).otherwise(own)
    dealt = rows.withColumn("_w", own).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = shared.written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranges")
    # A row for each range.
    parts = dealt.groupBy("_part").agg(F.sum("_w").alias("_own"))
    before = F.coalesce(F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shared.written(parts.select("_part", "_own", before.alias("_before")).filter(F.col("_before") <= budget), "range-sums")
    fits = F.col("_before") + F.col("_own") <= budget
    whole = dealt.join(parts.filter(fits).select("_part"), "_part", "left_semi")
    cut = dealt.join(parts.filter(~fits).orderBy("_part").limit(1), "_part")
    running = F.col("_before") + F.sum("_w").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_sum", running).filter(F.col("_sum") <= budget)
    return whole.select(rows.columns).unionByName(cut.select(rows.columns))


def moto_exports(vehicles: DataFrame, plates: DataFrame, most_pos: int, most_neg: int, p: Params = DEFAULTS) -> DataFrame:
    """Rear crops of motorcycles: positive ones with their surest plate's label, and negative ones, up to the quotas of each video."""
    moto = vehicles.filter(F.col("cls") == MOTO)
    rear = g.rear_region(g.columns(), p.moto_crop_bottom, p.moto_crop_side, p.width, p.height)
    crops = moto.select("video_id", "frame", "ord", g.columns().struct().alias("v"), *(c.alias(f"r{n}") for n, c in zip(g.Box._fields, rear, strict=True))).filter("rx2 > rx1 and ry2 > ry1")
    owned = plates.join(associate.vehicle_arrays(moto), ["video_id", "frame"]).withColumn("m", associate.tightest(g.columns(), F.col("vehicles"), (MOTO,))).filter("m is not null")
    owned = owned.groupBy("video_id", "frame", g.fields(F.col("m")).struct().alias("v")).agg(F.array_sort(F.collect_list(F.struct("pord", *g.Box._fields, "conf"))).alias("plates"))
    own = crops.join(owned, ["video_id", "frame", "v"], "left")
    r = g.columns("r")
    zero = F.lit(0)

    def local(q):
        return F.struct((-q["conf"]).alias("minus"), q["pord"].alias("pord"), F.greatest(zero, q["x1"] - r.x1).alias("x1"), F.greatest(zero, q["y1"] - r.y1).alias("y1"), F.least(r.x2 - r.x1, q["x2"] - r.x1).alias("x2"), F.least(r.y2 - r.y1, q["y2"] - r.y1).alias("y2"))

    best = F.array_min(F.filter(F.transform("plates", local), lambda q: (q["x2"] > q["x1"]) & (q["y2"] > q["y1"])))
    own = own.withColumn("best", best).withColumn("positive", F.col("best").isNotNull())
    nth = F.row_number().over(Window.partitionBy("video_id", "positive").orderBy("frame", "ord"))
    kept = own.withColumn("_n", nth).filter(F.col("_n") <= F.when(F.col("positive"), most_pos).otherwise(most_neg))
    return kept.select("video_id", "frame", "ord", "positive", F.col("v.x1").alias("vx1"), F.col("v.y1").alias("vy1"), *(F.col(f"r{n}") for n in g.Box._fields), *(F.col(f"best.{n}").alias(f"l{n}") for n in g.Box._fields))


def split_of(stem: Column, percent: int = 15) -> Column:
    """`val` for a fixed part of stems by the first eight hexadecimal digits of their MD5, else `train`."""
    number = F.conv(F.substring(F.md5(stem), 1, 8), 16, 10).cast("long")
    return F.when(number % 100 < percent, "val").otherwise("train")


def split_counts(crops: DataFrame) -> DataFrame:
    """Crops (with `split` and `cls`) and motorcycles among them, by split."""
    return crops.groupBy("split").agg(F.count("*").alias("crops"), F.count_if(F.col("cls") == MOTO).alias("motos"))


def review_entries(images: DataFrame, label_lines: DataFrame, edited: DataFrame, augmented_only: bool = False, source_only: bool = False, edited_only: bool = False, labelled_only: bool = False) -> DataFrame:
    """Pictures (split, stem) to review: augmented or source ones, those an editor touched, those with a label, as asked."""
    augmented = F.contains("stem", F.lit(labels.AUGMENTED))
    own = images
    if augmented_only:
        own = own.filter(augmented)
    if source_only:
        own = own.filter(~augmented)
    if edited_only:
        own = own.join(edited.select("stem").distinct(), "stem", "left_semi")
    if labelled_only:
        own = own.join(label_lines.filter(F.trim("value") != "").select("split", "stem").distinct(), ["split", "stem"], "left_semi")
    return own


def hit(boxes: Column, x: Column, y: Column, zoom_x: Column, zoom_y: Column, tolerance: float = 18.0) -> Column:
    """The place (from 0) of the box that a click on a shrunk picture means: the smallest around it, else the nearest within the tolerance; null if none."""
    shown = F.transform(boxes, lambda b, i: F.struct(i.alias("i"), *((b[c] / (zoom_x if c[0] == "x" else zoom_y)).cast("int").alias(c) for c in g.Box._fields)))
    around = F.filter(shown, lambda b: x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"]))
    smallest = F.array_min(F.transform(around, lambda b: F.struct(((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).cast("double").alias("by"), b["i"].alias("i"))))

    def away(b: Column) -> Column:
        dx = F.greatest(b["x1"], F.least(b["x2"], x)) - x
        dy = F.greatest(b["y1"], F.least(b["y2"], y)) - y
        return F.sqrt((dx * dx + dy * dy).cast("double"))

    nearest = F.array_min(F.filter(F.transform(shown, lambda b: F.struct(away(b).alias("by"), b["i"].alias("i"))), lambda r: r["by"] <= tolerance))
    return F.coalesce(smallest["i"], nearest["i"])


def review_order(labels: DataFrame, progress: DataFrame, edited: DataFrame) -> DataFrame:
    """Entries: edited ones first, then those not seen, then the rest; by stem."""
    own = labels.join(progress, "stem", "left").join(edited.select("stem").distinct().withColumn("edited", F.lit(True)), "stem", "left")
    rank = F.when(F.coalesce("edited", F.lit(False)), 0).when(F.col("status").isNull(), 1).otherwise(2)
    return own.withColumn("rank", rank).orderBy("rank", "stem")


def drawn(seed: int, what: str, *key: str, low: float = 0.0, high: float = 1.0):
    """A number in [low, high) that depends on the row's key alone, not on the order of rows."""
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *key), 11).cast("double") / float(1 << 53)
    return part * (high - low) + low


def augmentation_draws(images: DataFrame, seed: int = 42, lean: float = 0.0, geometric: float = 0.5, hsv: float = 0.5, motion: float = 0.3, max_lean: float = 30.0, max_rotate: float = 12.0, max_blur: int = 15) -> DataFrame:
    """What to do to each picture copy (stem, copy): lean or an everyday turn, colour shifts, motion blur; null where not done."""
    draw = lambda what, low=0.0, high=1.0: drawn(seed, what, "stem", "copy", low=low, high=high)
    leans = draw("lean") < lean
    turns = ~leans & (draw("geometric") < geometric)
    size = (F.floor(draw("blur_size", 0, (max_blur - 7) // 2 + 1)) * 2 + 7).cast("int")
    return images.withColumns(
        {
            "angle": F.when(leans, draw("angle", -max_lean, max_lean)).when(turns, draw("angle", -max_rotate, max_rotate)),
            "saturation": F.when(draw("hsv") < hsv, F.floor(draw("saturation", -25, 26)).cast("int")),
            "value": F.when(draw("hsv") < hsv, F.floor(draw("value", -30, 31)).cast("int")),
            "blur_size": F.when(draw("motion") < motion, size),
            "blur_angle": F.when(draw("motion") < motion, draw("blur_angle", -90, 90)),
        }
    )

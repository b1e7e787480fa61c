"""Times, durations, colours, regions, labels and frame counts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASS_NAMES, FILTERS


def time_to_seconds(text: Column) -> Column:
    """`MM:SS[.f]`, `HH:MM:SS[.f]` or plain seconds, as a double."""
    parts = F.split(text, ":")
    n = F.size(parts)
    minutes = parts[0].cast("int") * 60 + parts[1].cast("double")
    hours = parts[0].cast("int") * 3600 + F.get(parts, 1).cast("int") * 60 + F.get(parts, 2).cast("double")
    return F.when(n == 2, minutes).when(n == 3, hours).otherwise(F.when((n != 2) & (n != 3), text).cast("double"))


def _numbers(text: Column, count: int, what: str) -> Column:
    parts = F.transform(F.split(text, ","), lambda v: F.trim(v).cast("int"))
    return F.when(F.size(parts) == count, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {what} but got "), text)))


def parse_region(text: Column) -> Column:
    """`x1,y1,x2,y2` as an array; anything else is an error."""
    return _numbers(text, 4, "x1,y1,x2,y2")


def parse_color(text: Column) -> Column:
    """`R,G,B` as an array in the order B, G, R; parts outside 0 to 255 are an error."""
    parts = _numbers(text, 3, "R,G,B")
    return F.when(F.forall(parts, lambda v: v.between(0, 255)), F.reverse(parts)).otherwise(F.raise_error(F.concat(F.lit("color parts must be 0-255: "), text)))


def format_duration(seconds: Column) -> Column:
    """`12.3s`, `5m23s` or `1h12m05s`."""
    whole = F.rint(seconds).cast("long")
    minutes = F.format_string("%dm%02ds", F.floor(whole / 60).cast("long"), whole % 60)
    hours = F.format_string("%dh%02dm%02ds", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, minutes).otherwise(hours)


def parse_windows(text: Column) -> Column:
    """`a-b,c-d` as an array of (start, end) seconds."""
    spans = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.transform(spans, lambda v: F.struct(time_to_seconds(F.split(v, "-")[0]).alias("start"), time_to_seconds(F.split(v, "-")[1]).alias("end")))


def in_windows(at: Column, windows: Column) -> Column:
    """Whether a time lies in any window, ends included."""
    return F.exists(windows, lambda w: at.between(w["start"], w["end"]))


def class_name(cls: Column) -> Column:
    """The class's name, or its number as text."""
    names = F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, cls), cls.cast("string"))


def filter_classes(name: str) -> tuple[int, ...]:
    """The classes of a vehicle filter; unknown filters take all."""
    return FILTERS.get(name, FILTERS["all"])


def timecode(seconds: Column, decimals: int = 2) -> Column:
    """`MM:SS.ff`."""
    minutes = F.floor(seconds / 60).cast("long")
    return F.format_string(f"%02d:%0{decimals + 3}.{decimals}f", minutes, seconds - minutes * 60)


def crop_stem(frame: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("f%06d_m%d_%d", frame, x1, y1)


def estimated_frames(start: Column, end: Column, duration: Column, fps: Column) -> Column:
    """Frames of a clip, 1 at least; a missing or zero end means the whole duration."""
    begin = F.coalesce(start, F.lit(0.0))
    stop = F.when(F.coalesce(end, F.lit(0.0)) == 0, duration).otherwise(end)
    return F.greatest(F.lit(1), ((stop - begin) * fps).cast("int"))

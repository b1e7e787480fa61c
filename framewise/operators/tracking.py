"""Selection and chaining of plates, frame after frame: the only sequential operators.

Everything that needs one frame only (filters, association) is done by Catalyst
beforehand. A video is cut where no state can cross. Segments are dealt over all
partitions and sorted there, and one pass over a partition begins anew with each
segment; a segment's tracks are numbered on after those before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import CONFUSED, DEFAULTS, MOTO, Params
from ..shipping import ship
from . import associate, filters

XYXY = tuple[int, int, int, int]


# Plain geometry of tuples; the Column versions are in `functions.geometry`.


def meet(a: XYXY, b: XYXY) -> tuple[float, float]:
    """Sides of the common part, negative where apart."""
    return min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])


def share(a: XYXY, b: XYXY) -> float:
    """Intersection over union."""
    w, h = meet(a, b)
    if w <= 0 or h <= 0:
        return 0.0
    common = w * h
    return common / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common)


def touches(a: XYXY, b: XYXY) -> bool:
    return min(meet(a, b)) > 0


def middle(b: XYXY) -> tuple[float, float]:
    return (b[0] + b[2]) * 0.5, (b[1] + b[3]) * 0.5


def apart(a: XYXY, b: XYXY) -> float:
    return math.dist(middle(a), middle(b))


def size(b: XYXY) -> float:
    return max(1.0, max(0, b[2] - b[0]) * max(0, b[3] - b[1]))


def holds_middle(inner: XYXY, outer: XYXY) -> bool:
    x, y = middle(inner)
    return outer[0] <= x <= outer[2] and outer[1] <= y <= outer[3]


def one_to_one(scores: Iterable[tuple[float, Hashable, Hashable]]) -> dict:
    """Greedy assignment, best score first, earlier pairs first among equals: right key -> left key."""
    taken, out = set(), {}
    for _, left, right in sorted(scores, key=lambda s: -s[0]):
        if left not in taken and right not in out:
            taken.add(left)
            out[right] = left
    return out


class Det(NamedTuple):
    """A plate on a vehicle."""

    frame: int
    box: XYXY
    conf: float
    src: str
    veh: XYXY
    cls: int


class Memory(NamedTuple):
    """What is remembered of a vehicle: its box, its last plate, the largest share of it a plate had, when."""

    veh: XYXY
    plate: XYXY
    peak: float
    frame: int


class SizeGate:
    """Which motorcycles are large: a higher bar to become so than to stay so, followed by overlap from frame to frame."""

    def __init__(self, p: Params):
        self.p = p
        self.before: list[tuple[XYXY, bool]] = []

    def large(self, side: float, before: bool | None) -> bool:
        bar = self.p.min_moto_size
        if bar <= 0:
            return True
        return side >= bar * {None: 1.0, True: self.p.size_exit, False: self.p.size_enter}[before]

    def advance(self, motos: Sequence[XYXY]) -> list[bool]:
        """Take the next frame's boxes; whether each is large."""
        pairs = [(s, i, j) for i, (old, _) in enumerate(self.before) for j, new in enumerate(motos) if (s := share(old, new)) >= self.p.min_vehicle_iou]
        of = one_to_one(pairs)
        now = [self.large(max(b[2] - b[0], b[3] - b[1]), self.before[of[j]][1] if j in of else None) for j, b in enumerate(motos)]
        self.before = [*zip(motos, now, strict=True)]
        return now


class Selector:
    """One plate per vehicle and frame, by memory of each vehicle."""

    def __init__(self, p: Params):
        self.p = p
        self.keep = max(1, int(p.max_gap))
        self.memories: list[Memory] = []

    def better(self, new: Det, old: Det, last: XYXY | None) -> bool:
        """Nested hits: the larger. Others: the nearer to the last plate, then the larger, then the surer."""
        rank: list[tuple[float, float]] = []
        if share(new.box, old.box) < 0.3 and last is not None:
            rank.append((-apart(new.box, last), -apart(old.box, last)))
        rank += [(size(new.box), size(old.box)), (new.conf, old.conf)]
        a, b = zip(*rank, strict=True)
        return a > b

    def choose(self, frame: int, dets: list[Det]) -> list[Det]:
        by_vehicle: dict[XYXY, list[Det]] = {}
        for d in dets:
            by_vehicle.setdefault(d.veh, []).append(d)
        fresh = [(i, m) for i, m in enumerate(self.memories) if frame - m.frame <= self.keep]
        of = one_to_one((s, i, veh) for veh in by_vehicle for i, m in fresh if (s := share(veh, m.veh)) >= self.p.min_vehicle_iou)
        chosen, memories, used = [], [], set()
        for veh, own in by_vehicle.items():
            memory = self.memories[of[veh]] if veh in of else None
            if memory and memory.peak > 0:
                own = [d for d in own if size(d.box) / size(veh) * self.p.max_area_ratio >= memory.peak]
            if not own:
                continue
            best = own[0]
            for d in own[1:]:
                if self.better(d, best, memory.plate if memory else None):
                    best = d
            chosen.append(best)
            peak = size(best.box) / size(veh)
            if memory:
                used.add(of[veh])
                peak = max(memory.peak, peak)
            memories.append(Memory(veh, best.box, peak, frame))
        self.memories = memories + [m for i, m in fresh if i not in used]
        return chosen


def class_linked(a: int, b: int, gap: int, flip: int) -> bool:
    return a == b or (0 <= gap <= flip and a in CONFUSED and b in CONFUSED)


def plausible(a: XYXY, b: XYXY, gap: int, veh: XYXY | None, p: Params) -> bool:
    """Whether the way from a to b fits the missing frames."""
    reach = max(p.max_disp_px, math.hypot(veh[2] - veh[0], veh[3] - veh[1]) * p.max_disp_frac if veh else 0.0)
    return gap <= 0 or apart(a, b) <= reach * gap * 1.15


def linkable(a_cls: int, a_veh: XYXY, b_cls: int, b_veh: XYXY, a: XYXY, b: XYXY, gap: int, p: Params) -> bool:
    """Whether b may follow a: gap, class, vehicle and motion."""
    if not 0 <= gap <= p.max_gap or not class_linked(a_cls, b_cls, gap, p.max_class_flip):
        return False
    same = gap <= p.max_class_flip or touches(a_veh, b_veh) or share(a_veh, b_veh) >= p.min_vehicle_iou
    return same and plausible(a, b, max(gap, 1), b_veh, p)


class Chainer:
    """Chains of chosen plates; those too old to be continued are forgotten."""

    def __init__(self, p: Params):
        self.p = p
        self.open: dict[int, Det] = {}
        self.made = 0

    def shrinks(self, a: Det, b: Det) -> bool:
        return self.p.max_area_ratio > 0 and size(a.box) / size(b.box) > self.p.max_area_ratio

    def chain(self, frame: int, dets: list[Det]) -> Iterator[tuple[int, Det]]:
        """(track, det) for each det that continues a chain or begins one; a det that only shrank too much does neither."""
        self.open = {t: d for t, d in self.open.items() if frame - d.frame - 1 <= self.p.max_gap}
        free = dict(self.open)
        for d in dets:
            near = [(apart(o.box, d.box), t, o) for t, o in free.items() if linkable(o.cls, o.veh, d.cls, d.veh, o.box, d.box, frame - o.frame - 1, self.p)]
            fit = [(cost, t) for cost, t, o in near if not self.shrinks(o, d)]
            if fit:
                track = min(fit)[1]
            elif near:
                continue
            else:
                self.made += 1
                track = self.made
            free.pop(track, None)
            self.open[track] = d
            yield track, d


class Tracker:
    """Gate, selection and chaining of one run of frames."""

    def __init__(self, p: Params):
        self.gate, self.selector, self.chainer = SizeGate(p), Selector(p), Chainer(p)

    def step(self, frame: int, motos: Sequence[XYXY], dets: list[Det]) -> Iterator[tuple[int, int, Det]]:
        """(track, place in the frame, det) of the next frame, given its motorcycles' boxes and its candidates."""
        large = {b for b, is_large in zip(motos, self.gate.advance(motos), strict=True) if is_large}
        chosen = self.selector.choose(frame, [d for d in dets if d.cls != MOTO or d.veh in large])
        for track, d in self.chainer.chain(frame, chosen):
            yield track, chosen.index(d), d


# Spark


CANDIDATE = ("pord", *g.Box._fields, "conf", "src", "vx1", "vy1", "vx2", "vy2", "vcls")


def candidates(plates: DataFrame, vehicles: DataFrame, p: Params) -> DataFrame:
    """Trackable plates with their vehicle; standalone ones go."""
    own = associate.with_owner(filters.trackable_plates(plates, p), vehicles, p.classes).filter("v is not null")
    return own.select("video_id", "frame", "pord", *g.Box._fields, "conf", F.coalesce("src", F.lit("crop")).alias("src"), *(F.col(f"v.{c}").alias(f"v{c}") for c in (*g.Box._fields, "cls")))


def cut_where(frames: DataFrame, fresh: Callable[[WindowSpec], Column]) -> DataFrame:
    """video_id, frame, segment: a new segment begins at each frame for which `fresh(frames of the video in order)` holds."""
    order = Window.partitionBy("video_id").orderBy("frame")
    marked = frames.withColumn("_cut", F.coalesce(fresh(order), F.lit(False)).cast("int"))
    return marked.select("video_id", "frame", F.sum("_cut").over(order).alias("segment"))


def distance_over(mark: Column, order: WindowSpec) -> Column:
    """Frames from the last marked one before a frame to the next marked one from it on; null if one is missing."""
    at = F.when(mark, F.col("frame"))
    before = F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.first(at, True).over(order.rowsBetween(0, Window.unboundedFollowing)) - before


def with_mark(frames: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The frames with a column that tells which of them `rows` has."""
    own = rows.select("video_id", "frame").distinct().withColumn(name, F.lit(True))
    return frames.join(own, ["video_id", "frame"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def segments(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, p: Params) -> DataFrame:
    """video_id, frame, segment: a new one begins where neither memory nor chains nor the size gate can reach over.

    That is a frame before which no motorcycle was in the frame before, and
    around which more than max_gap + 1 frames lie between plates.
    """
    own = with_mark(with_mark(frames.select("video_id", "frame").distinct(), plates, "_p"), vehicles.filter(F.col("cls") == MOTO), "_m")
    return cut_where(own, lambda order: F.lag("frame").over(order).isNotNull() & ~F.lag("_m").over(order) & F.coalesce(distance_over(F.col("_p"), order) > max(1, p.max_gap) + 1, F.lit(True)))


def gate_segments(frames: DataFrame, motos: DataFrame) -> DataFrame:
    """video_id, frame, segment: a new one begins after each frame without a motorcycle."""
    return cut_where(with_mark(frames.select("video_id", "frame").distinct(), motos, "_m"), lambda order: ~F.lag("_m").over(order))


def struct_lists(column: pa.ListArray, names: Sequence[str]) -> list[list[tuple]]:
    """A column of lists of structs as lists of tuples of these fields; null is an empty list."""
    items = column.flatten()
    rows = [*zip(*(items.field(n).to_pylist() for n in names), strict=True)]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [rows[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def in_segments(rows: DataFrame, schema: str, lists: dict[str, Sequence[str]], begin: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Run a state over the frames of each segment, in order.

    `rows`: video_id, segment, frame and the named lists of structs. `begin()`
    gives a function of (frame, *lists as tuples) that returns the frame's rows,
    which come after the columns video_id and segment; with None for the frame it
    is told that the segment has ended.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [("video_id", "long"), ("segment", "long"), *(x.split() for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)] if out else [[]] * len(fields)
            found = pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])
            out.clear()
            return found

        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("video_id", "segment", "frame")]
            more = [struct_lists(batch.column(batch.schema.get_field_index(c)), names) for c, names in lists.items()]
            for video, segment, frame, *values in zip(*(c.to_pylist() for c in own), *more, strict=True):
                if (video, segment) != key:
                    if step:
                        out += [(*key, *r) for r in step(None)]
                    key, step = (video, segment), begin()
                out += [(*key, *r) for r in step(frame, *values)]
            if len(out) >= 10_000:
                yield flush()
        if step:
            out += [(*key, *r) for r in step(None)]
        yield flush()

    # A given number of partitions: the work lies in Python, and few bytes mustn't make few tasks of it.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id", "segment").sortWithinPartitions("video_id", "segment", "frame")
    return dealt.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def selected(frames: DataFrame, plates: DataFrame, vehicles: DataFrame, p: Params = DEFAULTS, by_segment: bool = True) -> DataFrame:
    """The chosen plate of each vehicle and frame with its track: video_id, frame, dord, box, conf, src, vehicle, track_id."""
    seen = filters.drop_unsure_motos(vehicles, p.moto_min_conf)
    cut = segments(frames, plates, seen, p) if by_segment else frames.select("video_id", "frame").distinct().withColumn("segment", F.lit(0).cast("long"))
    motos = associate.per_frame(seen.filter(F.col("cls") == MOTO), "motos", "ord", *g.Box._fields)
    dets = associate.per_frame(candidates(plates, seen, p), "dets", *CANDIDATE)
    rows = cut.join(motos, ["video_id", "frame"], "left").join(dets, ["video_id", "frame"], "left")
    schema = "frame int, dord int, x1 int, y1 int, x2 int, y2 int, conf double, src string, vx1 int, vy1 int, vx2 int, vy2 int, vcls int, track int"
    names = [f.split()[0] for f in schema.split(", ")]

    def begin():
        tracker = Tracker(p)

        def step(frame, motos=(), dets=()):
            if frame is None:
                return ()
            own = [Det(frame, (x1, y1, x2, y2), conf, src, (vx1, vy1, vx2, vy2), cls) for x1, y1, x2, y2, conf, src, vx1, vy1, vx2, vy2, cls in dets]
            return [(frame, place, *d.box, d.conf, d.src, *d.veh, d.cls, track) for track, place, d in tracker.step(frame, motos, own)]

        return step

    found = in_segments(rows, schema, {"motos": g.Box._fields, "dets": CANDIDATE[1:]}, begin)
    made = found.groupBy("video_id", "segment").agg(F.max("track").alias("made"))
    earlier = Window.partitionBy("video_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    made = made.select("video_id", "segment", F.coalesce(F.sum("made").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(made, ["video_id", "segment"])
    return numbered.select("video_id", *(c for c in names if c != "track"), (F.col("track") + F.col("before")).cast("int").alias("track_id"))


def gate_states(frames: DataFrame, vehicles: DataFrame, p: Params = DEFAULTS, by_segment: bool = True) -> DataFrame:
    """video_id, frame, ord, large of every motorcycle that is sure enough."""
    seen = filters.drop_unsure_motos(vehicles, p.moto_min_conf).filter(F.col("cls") == MOTO)
    cut = gate_segments(frames, seen) if by_segment else frames.select("video_id", "frame").distinct().withColumn("segment", F.lit(0).cast("long"))
    rows = cut.join(associate.per_frame(seen, "motos", "ord", *g.Box._fields), ["video_id", "frame"], "left")

    def begin():
        gate = SizeGate(p)
        return lambda frame, motos=(): () if frame is None else [(frame, m[0], large) for m, large in zip(motos, gate.advance([m[1:] for m in motos]), strict=True)]

    return in_segments(rows, "frame int, ord int, large boolean", {"motos": ("ord", *g.Box._fields)}, begin).drop("segment")

"""Live tracking: frame records arrive in order, and each micro-batch gives the plates chosen in it.

A record holds a frame's plates and vehicles as arrays, so that filters and
association need no join between streams; only gate, memories, open chains and
the vehicles of the last frames are state, one small value a video. What is
forgotten with age bounds it: nothing older than max_gap + 1 frames is kept.

Frames of a video have to arrive in order. Frames at or before the last one seen
are late; tracking can't take them in any more, so they come out with a null
track and the mark `late`, and nothing is lost unseen.

A bridge needs what comes after its gap: `live_zones` gives it with the plate that
ends the gap, so a frame's zones are complete max_gap + 1 frames later.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import associate, bridge
from ..operators.bridge import END
from ..operators.tracking import Det, Tracker
from ..schema import DEFAULTS, MOTO, Params
from ..shipping import ship

RECORD = "video_id long, frame int, plates array<struct<pord:int,x1:int,y1:int,x2:int,y2:int,conf:double,src:string>>, vehicles array<struct<ord:int,cls:int,x1:int,y1:int,x2:int,y2:int,conf:double>>"
OUT = "video_id long, frame int, x1 int, y1 int, x2 int, y2 int, conf double, src string, track_id int, late boolean"
STATE = "frame int, value binary"
#: A chosen plate with its vehicle, the track's plate before it, and the vehicles of the frames between, both as JSON.
CHOSEN = OUT + ", vx1 int, vy1 int, vx2 int, vy2 int, vcls int, before string, between string"
END_JSON = "struct<frame:int,x1:int,y1:int,x2:int,y2:int,conf:double,vx1:int,vy1:int,vx2:int,vy2:int,vcls:int>"


def records(frames: DataFrame, plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Tables as frame records."""
    p = associate.per_frame(plates, "plates", "pord", *g.Box._fields, "conf", "src")
    own = frames.select("video_id", "frame").distinct().join(p, ["video_id", "frame"], "left").join(associate.vehicle_arrays(vehicles), ["video_id", "frame"], "left")
    empty = {n: F.from_json(F.lit("[]"), t) for n, t in (f.split(" ", 1) for f in ("plates " + RECORD.split("plates ")[1].split(", vehicles")[0], "vehicles " + RECORD.split("vehicles ")[1]))}
    return own.select("video_id", "frame", *(F.coalesce(n, e).alias(n) for n, e in empty.items()))


def prepared(rows: DataFrame, p: Params, *more: Column) -> DataFrame:
    """video_id, frame, motos and candidates as JSON: all that needs one frame only, in the JVM; and `more`."""
    seen = F.filter("vehicles", lambda v: (v["cls"] != MOTO) | (v["conf"] >= p.moto_min_conf))
    own = rows.withColumn("vehicles", seen)
    fine = F.filter("plates", lambda q: (q["conf"] >= p.conf_floor) & (F.coalesce(q["src"], F.lit("crop")) != "sahi") & ((F.lit(p.min_plate_side) <= 0) | (g.min_side(g.fields(q)) >= p.min_plate_side)))
    owned = F.transform(fine, lambda q: F.struct(q.alias("p"), associate.owner(g.fields(q), F.col("vehicles"), p.classes).alias("v")))
    dets = F.filter(owned, lambda o: o["v"].isNotNull())
    motos = F.filter("vehicles", lambda v: v["cls"] == MOTO)
    return own.select("video_id", "frame", F.to_json(motos).alias("motos"), F.to_json(dets).alias("dets"), F.to_json("vehicles").alias("vehicles"), *more)


class LiveState:
    """A video's tracker, each open track's last plate, and the vehicles of the last frames (as JSON)."""

    def __init__(self, p: Params):
        self.p, self.tracker = p, Tracker(p)
        self.last: dict[int, Det] = {}
        self.vehicles: dict[int, str] = {}

    def step(self, frame: int, motos: list, dets: list[Det], vehicles: str) -> Iterator[tuple[int, Det, str | None, str | None]]:
        """(track, det, the plate before as JSON, vehicles of the frames between as JSON) of the next frame."""
        oldest = frame - self.p.max_gap - 1
        self.last = {t: d for t, d in self.last.items() if d.frame >= oldest}
        self.vehicles = {f: v for f, v in self.vehicles.items() if f >= oldest}
        for track, _, d in self.tracker.step(frame, motos, dets):
            before = self.last.get(track)
            if before is None or before.frame + 1 >= frame:
                yield track, d, None, None
            else:
                end = dict(zip(END, (before.frame, *before.box, before.conf, *before.veh, before.cls), strict=True))
                gap = ", ".join(f'{{"frame": {f}, "vehicles": {self.vehicles.get(f, "[]")}}}' for f in range(before.frame + 1, frame))
                yield track, d, json.dumps(end), f"[{gap}]"
            self.last[track] = d
        self.vehicles[frame] = vehicles


def chosen(rows: DataFrame, p: Params) -> DataFrame:
    """The chosen plates of a stream (or table) of frame records, as `CHOSEN`."""
    ship(rows.sparkSession)
    names = [f.split()[0] for f in CHOSEN.split(", ")]
    edges = lambda b: tuple(b[c] for c in g.Box._fields)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, parts = state.get
            own = pickle.loads(bytes(parts))
        else:
            last, own = None, LiveState(p)
        out = []
        for r in pd.concat([*batches]).sort_values("frame").itertuples():
            dets = [Det(r.frame, edges(d["p"]), d["p"]["conf"], d["p"].get("src") or "crop", edges(d["v"]), d["v"]["cls"]) for d in json.loads(r.dets)]
            if last is not None and r.frame <= last:
                out += [(*key, r.frame, *d.box, d.conf, d.src, None, True, *d.veh, d.cls, None, None) for d in dets]
                continue
            last = int(r.frame)
            motos = [edges(m) for m in json.loads(r.motos)]
            out += [(*key, last, *d.box, d.conf, d.src, track, False, *d.veh, d.cls, *gap) for track, d, *gap in own.step(last, motos, dets, r.vehicles)]
        if last is not None:
            state.update((last, pickle.dumps(own)))
        yield pd.DataFrame(out, columns=names).astype({"track_id": "Int32"})

    return prepared(rows, p).groupBy("video_id").applyInPandasWithState(run, CHOSEN, STATE, "append", "NoTimeout")


def live_tracks(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The chosen plates of a stream (or table) of frame records with their tracks."""
    return chosen(rows, p).select(*(f.split()[0] for f in OUT.split(", ")))


def live_zones(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Observed zones as they come, and bridges when their gap has ended: video_id, frame, box, conf, src, track_id, late."""
    record = RECORD.split("vehicles ")[1]
    own = chosen(rows, p).withColumns({"a": F.from_json("before", END_JSON), "b": F.struct(*END), "between": F.from_json("between", f"array<struct<frame:int,vehicles:{record}>>")})
    none = F.expr(f"array(named_struct('frame', cast(null as int), 'vehicles', cast(array() as {record})))")
    gap = F.when(F.coalesce(bridge.bridged(bridge.ends("a"), bridge.ends("b"), p), F.lit(False)), F.concat(none, F.col("between"))).otherwise(none)
    seen = [F.col(c).alias(f"o_{c}") for c in ("frame", *g.Box._fields, "conf", "src")]
    rows_ = own.select("video_id", "track_id", "late", "a", "b", *seen, F.explode(gap).alias("m")).withColumns({"frame": F.col("m.frame"), "vehicles": F.col("m.vehicles")})
    found = bridge.filled(rows_, p)
    observed = F.col("m.frame").isNull()
    box = [F.when(observed, F.col(f"o_{n}")).otherwise(F.col(f"box.{n}")).alias(n) for n in g.Box._fields]
    pick = lambda n, other: F.when(observed, F.col(f"o_{n}")).otherwise(other).alias(n)
    return found.select("video_id", pick("frame", F.col("frame")), *box, pick("conf", F.col("conf")), pick("src", F.lit("bridge")), "track_id", "late")

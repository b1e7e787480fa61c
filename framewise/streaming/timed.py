"""Live zones, frame by frame: each comes once, when nothing can be added to it any more.

A plate bridges at most max_gap missing frames, so a frame is complete when a
frame max_gap + 1 later has arrived, or when the stream's watermark has passed
its time by as much: an event timer closes the last frames of a video that goes
on without plates, pauses or ends. After `idle` seconds a video's state is
removed; should it come again, it is a new one.

State is a few small tables for each video, none older than max_gap + 1 frames:
the size gate's boxes and the vehicles' memories as lists, open tracks, vehicles
of the last frames and zones of frames not yet complete as maps.

Input: frame records (`live.records`) with `at`, their time, on which the stream has a
watermark; a video's frames in order. Frames at or before the last one seen come
out as they are, marked late and without a track.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import geometry as g
from ..operators import bridge
from ..operators.bridge import END
from ..operators.tracking import Det, Memory, Tracker
from ..schema import DEFAULTS, Params
from ..shipping import ship
from . import live

#: A zone, or the ends of a gap with the vehicles of one frame in it.
OUT = "video_id long, frame int, track_id int, late boolean, observed boolean, x1 int, y1 int, x2 int, y2 int, conf double, src string, a string, b string, vehicles string"
NAMES = [f.split()[0] for f in OUT.split(", ")]
BOX = "x1 int, y1 int, x2 int, y2 int"
VEH = "vx1 int, vy1 int, vx2 int, vy2 int"


def _end(d: Det) -> str:
    return json.dumps(dict(zip(END, (d.frame, *d.box, d.conf, *d.veh, d.cls), strict=True)))


class ZoneProcessor(StatefulProcessor):
    """One video's tracker over its records; `Tracker` is built from the state for each batch and put back after it."""

    def __init__(self, p: Params, fps: float, idle: float):
        self.p, self.step_ms, self.idle_ms = p, 1000.0 / fps, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last int, made int, at long")
        self.gate = handle.getListState("gate", f"{BOX}, large boolean")
        self.memories = handle.getListState("memories", f"{VEH}, {BOX}, peak double, frame int")
        self.tracks = handle.getMapState("tracks", "track int", f"frame int, {BOX}, conf double, src string, {VEH}, vcls int")
        self.seen = handle.getMapState("seen", "frame int", "vehicles string")
        self.pending = handle.getMapState("pending", "frame int", "close long, zones string")

    def _load(self) -> tuple[Tracker, int | None]:
        tracker = Tracker(self.p)
        if not self.clock.exists():
            return tracker, None
        last, tracker.chainer.made, _ = self.clock.get()
        tracker.gate.before = [((*r[:4],), r[4]) for r in self.gate.get()]
        tracker.selector.memories = [Memory((*r[:4],), (*r[4:8],), r[8], r[9]) for r in self.memories.get()]
        tracker.chainer.open = {k[0]: Det(v[0], (*v[1:5],), v[5], v[6], (*v[7:11],), v[11]) for k, v in sorted((tuple(k), tuple(v)) for k, v in self.tracks.iterator())}
        return tracker, last

    def _store(self, tracker: Tracker, last: int, at: int) -> None:
        self.clock.update((last, tracker.chainer.made, at))
        for state, rows in ((self.gate, [(*b, bool(large)) for b, large in tracker.gate.before]), (self.memories, [(*m.veh, *m.plate, float(m.peak), m.frame) for m in tracker.selector.memories])):
            state.clear()
            if rows:
                state.put(rows)
        for (track,) in [*self.tracks.keys()]:
            if track not in tracker.chainer.open:
                self.tracks.removeKey((track,))
        for track, d in tracker.chainer.open.items():
            self.tracks.updateValue((track,), (d.frame, *d.box, d.conf, d.src, *d.veh, d.cls))
        for (frame,) in [*self.seen.keys()]:
            if frame < last - self.p.max_gap - 1:
                self.seen.removeKey((frame,))

    def _keep(self, frame: int, at: float, zone: tuple) -> None:
        """Put a zone with those of its frame, which has a time to be closed at."""
        close, zones = self.pending.getValue((frame,)) if self.pending.containsKey((frame,)) else (None, "[]")
        if close is None:
            close = math.ceil(at + (self.p.max_gap + 1) * self.step_ms)
            self.handle.registerTimer(close)
        self.pending.updateValue((frame,), (close, json.dumps([*json.loads(zones), zone])))

    def _closed(self, video: int, due) -> list[tuple]:
        """The zones of the frames that are due, which leave the state."""
        out = []
        for (frame,), (close, zones) in sorted((tuple(k), tuple(v)) for k, v in self.pending.iterator()):
            if due(frame, close):
                out += [(video, frame, *z) for z in json.loads(zones)]
                self.pending.removeKey((frame,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker, last = self._load()
        edges = lambda b: tuple(b[c] for c in g.Box._fields)
        out, at = [], self.clock.get()[2] if last is not None else 0
        for r in pd.concat([*rows]).sort_values("frame").itertuples():
            dets = [Det(int(r.frame), edges(d["p"]), d["p"]["conf"], d["p"].get("src") or "crop", edges(d["v"]), d["v"]["cls"]) for d in json.loads(r.dets)]
            if last is not None and r.frame <= last:
                out += [(key[0], int(r.frame), None, True, True, *d.box, d.conf, d.src, None, None, None) for d in dets]
                continue
            last, at = int(r.frame), int(r.at)
            before = dict(tracker.chainer.open)
            for track, _, d in tracker.step(last, [edges(m) for m in json.loads(r.motos)], dets):
                self._keep(last, at, (track, False, True, *d.box, d.conf, d.src, None, None, None))
                begun = before.get(track)
                for missing in range(begun.frame + 1, last) if begun else ():
                    seen = self.seen.getValue((missing,))[0] if self.seen.containsKey((missing,)) else "[]"
                    self._keep(missing, at - (last - missing) * self.step_ms, (track, False, False, None, None, None, None, None, "bridge", _end(begun), _end(d), seen))
            self.seen.updateValue((last,), (r.vehicles,))
            out += self._closed(key[0], lambda frame, _: frame <= last - self.p.max_gap - 1)  # noqa: B023
        self._store(tracker, last, at)
        self.handle.registerTimer(at + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = self._closed(key[0], lambda _, close: close <= now)
        if self.clock.exists() and now >= self.clock.get()[2] + self.idle_ms:
            out += self._closed(key[0], lambda *_: True)
            for state in (self.clock, self.gate, self.memories, self.tracks, self.seen, self.pending):
                state.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = {"int": "Int32", "long": "Int64", "boolean": "boolean", "double": "Float64", "string": "object"}
        return pd.DataFrame(rows, columns=NAMES).astype({n: kinds[k] for n, k in (f.split() for f in OUT.split(", "))})


def closed_zones(rows: DataFrame, p: Params = DEFAULTS, fps: float | None = None, idle: float = 600.0) -> DataFrame:
    """video_id, frame, box, conf, src, track_id, late of a stream of records: a frame's zones together, once it is complete.

    `rows` has a watermark on `at`; `idle` is in seconds of it. The stream's state
    store has to be RocksDB's, as timers and maps need it.
    """
    ship(rows.sparkSession)
    ready = live.prepared(rows, p, F.unix_millis("at").alias("at"))
    processor = ZoneProcessor(p, fps or p.fps, idle)
    found = ready.groupBy("video_id").transformWithStateInPandas(processor, OUT, "append", "EventTime")
    record = live.RECORD.split("vehicles ")[1]
    own = found.withColumns({"a": F.from_json("a", live.END_JSON), "b": F.from_json("b", live.END_JSON), "vehicles": F.from_json("vehicles", record)})
    own = own.filter(F.col("observed") | F.coalesce(bridge.bridged(bridge.ends("a"), bridge.ends("b"), p), F.lit(False)))
    seen = [F.col(c).alias(f"o_{c}") for c in (*g.Box._fields, "conf")]
    own = bridge.filled(own.select("video_id", "frame", "track_id", "late", "observed", "src", "a", "b", "vehicles", *seen), p)
    pick = lambda n, other: F.when(F.col("observed"), F.col(f"o_{n}")).otherwise(other).alias(n)
    return own.select("video_id", "frame", *(pick(n, F.col(f"box.{n}")) for n in g.Box._fields), pick("conf", F.col("conf")), "src", "track_id", "late")

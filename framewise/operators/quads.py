"""Rotated plates over time: a quad glides with its zone, blends with new estimates and gives up slowly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import QUAD_ORDERS
from . import associate
from .tracking import cut_where, in_segments

# Ratios to enter and to hold, frames held, steps of giving up.
ENTER, HOLD, PATIENCE, STEPS = 0.75, 0.40, 10, 4
# How far points move to an estimate (found again, moving, still), and the pixels from which a zone moves.
FOUND_AGAIN, MOVING, STILL, MOVE = 0.8, 0.65, 0.5, 8.0
# How far an estimate may lie from the quad (of its sides) and from the zone's middle (of its side), and how much smaller it may be.
NEAR_QUAD, NEAR_ZONE, SHRINK = 0.4, 0.30, 0.5


def quad_area(q: np.ndarray) -> float:
    x, y = q[:, 0].astype(np.float64), q[:, 1].astype(np.float64)
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def align(reference: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quad's points in the order nearest to the reference's."""
    options = [np.asarray(quad, np.float64)[o] for o in QUAD_ORDERS]
    return options[int(np.argmin([((o - reference) ** 2).sum() for o in options]))]


@dataclass
class Quad:
    """A followed quad: last zone, points, share of the zone, whether in use, weak frames, steps of giving up."""

    zone: tuple[float, float, float, float]
    points: np.ndarray
    ratio: float = 0.0
    active: bool = False
    weak: int = 0
    leaving: int = 0

    def offset(self, zone) -> tuple[float, float]:
        return tuple((zone[i] + zone[i + 2] - self.zone[i] - self.zone[i + 2]) * 0.5 for i in (0, 1))

    def weight(self, new: np.ndarray, glided: np.ndarray, zone, area: float) -> float:
        """How far the points move to a new estimate: 0 if it isn't trusted."""
        at, now = new.mean(0), glided.mean(0)
        ratio = quad_area(new) / area
        span = np.maximum(glided.max(0) - glided.min(0), 1.0)
        agrees = ratio >= SHRINK * self.ratio and bool((np.abs(at - now) <= NEAR_QUAD * span).all())
        if agrees:
            return MOVING if max(map(abs, self.offset(zone))) >= MOVE else STILL
        side = max(zone[2] - zone[0], zone[3] - zone[1], 1.0)
        off = math.hypot(at[0] - (zone[0] + zone[2]) * 0.5, at[1] - (zone[1] + zone[3]) * 0.5)
        return FOUND_AGAIN if off <= NEAR_ZONE * side and ratio >= max(HOLD, self.ratio) else 0.0

    def step(self, zone, estimate, area: float) -> bool:
        """Take the next frame's zone and estimate (or None); whether the quad is to be used."""
        glided = self.points + np.array(self.offset(zone))
        points, ratio, fresh = glided.astype(np.int32), 0.0, False
        if estimate is not None and area > 0:
            new = align(self.points, np.asarray(estimate))
            a = self.weight(new, glided, zone, area)
            if a:
                points, fresh = ((1.0 - a) * self.points + a * new).astype(np.int32), True
            ratio = quad_area(points if fresh else glided) / area
        if self.leaving:
            strong = fresh and ratio >= ENTER
        else:
            strong = ratio >= (HOLD if self.active else ENTER) and (fresh or self.active)
        if strong:
            self.weak = self.leaving = 0
            use = True
        elif not self.active:
            use = False
        else:
            use = self.weak < PATIENCE
            if use:
                self.weak += 1
                points = glided.astype(np.int32)
            else:
                self.leaving += 1
                points = self.widened(glided, zone).astype(np.int32)
                use = self.leaving < STEPS
            ratio = quad_area(points) / area if area > 0 else 0.0
        self.zone, self.points, self.ratio, self.active = zone, points, ratio, use
        return use

    def widened(self, glided: np.ndarray, zone) -> np.ndarray:
        """A step from the quad's frame to the zone's size about the quad's middle."""
        low, high = glided.min(0), glided.max(0)
        middle, t = (low + high) * 0.5, self.leaving / (STEPS + 1.0)
        own = high - low
        target = own + (np.array([zone[2] - zone[0], zone[3] - zone[1]]) - own) * t
        return middle + (glided - middle) * (target / np.maximum(own, 1e-9))


def nearest(quads: list[Quad], zone, reach: float = 0.5) -> int:
    """The followed quad whose zone is nearest, within a part of the zone's longer side; -1 if none."""
    middle = lambda z: ((z[0] + z[2]) * 0.5, (z[1] + z[3]) * 0.5)
    far = [math.dist(middle(q.zone), middle(zone)) for q in quads]
    best = min(range(len(far)), key=far.__getitem__, default=-1)
    return best if best >= 0 and far[best] <= reach * max(zone[2] - zone[0], zone[3] - zone[1], 1.0) else -1


class QuadFollower:
    """The quads of one run of frames; one that no zone takes up in the next frame is forgotten."""

    def __init__(self):
        self.frame: int | None = None
        self.before: list[Quad] = []
        self.now: list[Quad] = []

    def step(self, frame: int, zones) -> list[tuple[int, list[int], float, bool]]:
        """(zord, points, ratio, used) of the frame's zones (zord, x1, y1, x2, y2, quad or None) that have a quad."""
        self.before = self.now if self.frame is not None and frame == self.frame + 1 else []
        self.frame, self.now, out = frame, [], []
        for zord, x1, y1, x2, y2, points in zones:
            zone = (x1, y1, x2, y2)
            estimate = np.array(points, float).reshape(4, 2) if points else None
            n = nearest(self.before, zone)
            if n < 0 and estimate is None:
                continue
            quad = self.before[n] if n >= 0 else Quad(zone, estimate.astype(np.int32))
            used = quad.step(zone, estimate, float((x2 - x1) * (y2 - y1)))
            if not any(q is quad for q in self.now):
                self.now.append(quad)
            out.append((zord, [int(v) for v in quad.points.ravel()], quad.ratio, used))
        return out


def quad_states(rows: DataFrame, by_segment: bool = True) -> DataFrame:
    """Follow quads: rows with video_id, frame, zord, zone edges and `quad` (8 numbers or null); gives points, ratio and used.

    Nothing is remembered over a frame without zones, so videos are cut there.
    """
    zones = associate.per_frame(rows, "zones", "zord", *g.Box._fields, "quad")
    own = zones.select("video_id", "frame")
    cut = cut_where(own, lambda order: F.col("frame") - F.lag("frame").over(order) > 1) if by_segment else own.withColumn("segment", F.lit(0).cast("long"))

    def begin():
        follower = QuadFollower()
        return lambda frame, zones=(): () if frame is None else [(frame, *r) for r in follower.step(frame, zones)]

    return in_segments(cut.join(zones, ["video_id", "frame"]), "frame int, zord int, points array<int>, ratio double, used boolean", {"zones": ("zord", *g.Box._fields, "quad")}, begin).drop("segment")

"""Selection, chaining and bridging: behaviour on small hand-made caches."""

import random

import pytest
from compare import rows

from framewise.operators import bridge, holds, metrics, quads, tracking
from framewise.schema import MOTO, PLATES, VEHICLES, Params

BIKE = (400, 300, 560, 640)


def cached(spark, frames):
    """Frames, plates and vehicles of {frame: (plates, vehicles)}; plates (box, conf[, src]), vehicles (cls, box, conf)."""
    plates = [(1, f, n, *p[0], p[1], p[2] if len(p) > 2 else "crop") for f, (ps, _) in frames.items() for n, p in enumerate(ps)]
    vehicles = [(1, f, n, c, *b, conf) for f, (_, vs) in frames.items() for n, (c, b, conf) in enumerate(vs)]
    return spark.createDataFrame([(1, f) for f in frames], "video_id long, frame int"), spark.createDataFrame(plates, PLATES), spark.createDataFrame(vehicles, VEHICLES)


def zones(spark, frames, **changes):
    p = Params(**changes)
    f, plates, vehicles = cached(spark, frames)
    return bridge.zones(tracking.selected(f, plates, vehicles, p), vehicles, p)


def bike(*plates, conf=0.9, box=BIKE):
    return [*plates], [(MOTO, box, conf)]


def test_missing_frames_are_bridged_by_pose(spark):
    """Centre and size go in thirds: centre (475, 535) to (484, 547), size 50 x 30 to 56 x 36."""
    found = zones(spark, {20: bike(((450, 520, 500, 550), 0.6)), 23: bike(((456, 529, 512, 565), 0.9))})
    assert rows(found, "frame", "x1", "y1", "x2", "y2", "src") == [
        (20, 450, 520, 500, 550, "crop"), (21, 452, 523, 504, 555, "bridge"), (22, 454, 526, 508, 560, "bridge"), (23, 456, 529, 512, 565, "crop"),
    ]
    assert [round(c, 6) for _, c in rows(found, "frame", "conf")] == [0.6, 0.7, 0.8, 0.9]
    assert metrics.zone_stats(found).first().asDict() == {"frames_with_zones": 4, "observed_zones": 2, "bridged_zones": 2}


def test_gaps_and_jumps_are_not_bridged(spark):
    a = ((450, 520, 500, 550), 0.6)
    assert zones(spark, {5: bike(a), 30: bike(a)}, max_gap=20).count() == 2
    assert zones(spark, {5: bike(a), 30: bike(a)}, max_gap=24).count() == 26
    far = bike(((950, 520, 1000, 550), 0.6), box=(900, 300, 1060, 640))
    assert zones(spark, {5: bike(a), 8: far}, max_disp_px=30.0, max_disp_frac=0.05).count() == 2


@pytest.mark.parametrize("plate", [((1200, 60, 1260, 90), 0.6), ((450, 520, 459, 529), 0.6), ((450, 520, 500, 550), 0.6, "sahi"), ((450, 520, 500, 550), 0.12)])
def test_standalone_tiny_tiled_and_unsure_plates_make_no_zone(spark, plate):
    assert zones(spark, {7: bike(plate)}).count() == 0


def test_the_larger_wins_without_history_and_the_nearer_with_it(spark):
    real, blob = ((455, 520, 505, 560), 0.3), ((430, 330, 450, 346), 0.9)
    assert rows(zones(spark, {20: bike(blob, real)}), "x1") == [(455,)]
    big = ((410, 310, 490, 380), 0.9)
    assert rows(zones(spark, {20: bike(real), 21: bike(big, real)}), "frame", "x1") == [(20, 455), (21, 455)]


def test_a_blob_is_bridged_and_the_peak_does_not_fall(spark):
    """With a ratio of 2.5, a plate of side s lasts beside one of side 90 from s = 57 on."""
    at = lambda s: ((450, 500, 450 + s, 500 + s), 0.5)
    found = zones(spark, {20: bike(at(44)), 21: bike(((450, 500, 468, 514), 0.5)), 22: bike(at(44))})
    assert rows(found, "frame", "src") == [(20, "crop"), (21, "bridge"), (22, "crop")]
    sizes = {20: 90, 21: 75, 22: 60, 23: 50, 24: 35, 25: 88}
    found = zones(spark, {f: bike(at(s)) for f, s in sizes.items()})
    assert [s for _, s in rows(found, "frame", "src")] == ["crop", "crop", "crop", "bridge", "bridge", "crop"]


def test_size_gate_has_two_bars():
    """A bar of 200: 230 to become large, 170 to stay so."""
    gate = tracking.SizeGate(Params(moto_min_h_frac=200 / 1080))
    cases = [(210, None, True), (190, None, False), (180, True, True), (160, True, False), (220, False, False), (240, False, True)]
    assert [gate.large(side, before) for side, before, _ in cases] == [want for *_, want in cases]


def random_cache(seed, n=120):
    r = random.Random(seed)
    frames, x = {}, 200
    for f in sorted(r.sample(range(400), n)):
        x += r.randint(-6, 10)
        vs = [(r.choice((2, 3, 3, 7)), (x + 300 * k, 200, x + 300 * k + 160, 460 + r.randint(-20, 20)), r.uniform(0.2, 0.9)) for k in range(r.randint(0, 2))]
        ps = [((b[0] + 50 + r.randint(-15, 15), b[1] + 130, b[0] + 90 + r.randint(0, 20), b[1] + 165), r.uniform(0.1, 0.9)) for _, b, _ in vs if r.random() < 0.7]
        frames[f] = (ps, vs)
    return frames


@pytest.mark.parametrize("gap", [0, 3, 8])
def test_segments_change_nothing_and_neither_does_row_order(spark, gap):
    p = Params(max_gap=gap, moto_min_h_frac=0.15)
    f, plates, vehicles = cached(spark, random_cache(gap))
    assert tracking.segments(f, plates, vehicles, p).agg({"segment": "max"}).first()[0] > 0
    whole = rows(tracking.selected(f, plates, vehicles, p, by_segment=False))
    assert rows(tracking.selected(f, plates, vehicles, p)) == whole
    from pyspark.sql import functions as F

    mixed = [d.orderBy(F.rand(3)) for d in (f, plates, vehicles)]
    assert rows(tracking.selected(*mixed, p)) == whole


@pytest.mark.parametrize("gap", [0, 2, 6])
def test_segments_change_neither_gate_nor_holds(spark, gap):
    p = Params(max_gap=gap, moto_min_h_frac=0.22)
    f, _, vehicles = cached(spark, random_cache(gap + 20, 90))
    for run, cut in ((tracking.gate_states, tracking.gate_segments(f, vehicles.filter("cls = 3"))), (holds.held, holds.hold_segments(f, vehicles, p))):
        assert cut.agg({"segment": "max"}).first()[0] > 0
        whole = rows(run(f, vehicles, p, by_segment=False))
        assert whole and rows(run(f, vehicles, p)) == whole
    assert holds.held(f.filter("frame < 0"), vehicles.filter("frame < 0"), p).count() == 0


def plain_splits(vehicles, p):
    """Boxes that splits restore, before any is in the way of another: motorcycle by motorcycle over all earlier boxes."""
    few = {}
    for r in sorted(vehicles, key=lambda r: (r.frame, r.ord)):
        if r.cls in (2, 3, 7):
            few.setdefault(r.frame, []).append(((r.x1, r.y1, r.x2, r.y2), r.cls, r.conf))
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    out = []
    for at, seen in few.items():
        for box, cls, conf in seen:
            ways = []
            for before in range(at - p.max_gap - 1, at - 1):
                gap = at - before - 1
                for wide, _, wide_conf in few.get(before, ()) if cls == 3 else ():
                    near = lambda b: tracking.apart(b, box) <= max(p.max_disp_px, p.max_disp_frac * ((box[2] - box[0]) ** 2 + (box[3] - box[1]) ** 2) ** 0.5) * gap * 1.15  # noqa: B023, E731
                    since = [b for f in range(before + 1, at + 1) for b, _, _ in few.get(f, ())]
                    side = [b for b in since if tracking.share(b, box) < 0.45 and (tracking.holds_middle(b, wide) or tracking.share(b, wide) >= p.min_vehicle_iou)]
                    if not (side and tracking.holds_middle(box, wide) and area(wide) >= 1.25 * area(box) and near(wide)):
                        continue
                    left, right = side[0][0] - wide[0], wide[2] - side[0][2]
                    if max(left, right) >= 16:
                        rest = (side[0][2], wide[1], wide[2], wide[3]) if right >= left else (wide[0], wide[1], side[0][0], wide[3])
                        if area(rest) >= 256 and near(rest):
                            ways.append((gap, rest, wide_conf, before))
            if ways:
                gap, rest, wide_conf, before = min(ways, key=lambda w: w[0])
                for k in range(1, gap + 1):
                    t = k / (gap + 1)
                    out.append((before + k, *(round(a + (b - a) * t) for a, b in zip(rest, box, strict=True)), round(wide_conf * (1 - t) + conf * t, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_of_a_dense_video_equal_those_found_one_by_one(spark, seed):
    rnd = random.Random(seed)
    p = Params(max_gap=5)
    data = []
    for frame in range(60):
        for n in range(rnd.randint(4, 14)):
            x, y, w, h = rnd.randint(-40, 500), rnd.randint(0, 300), rnd.randint(10, 220), rnd.randint(10, 200)
            data.append((1, frame, n, rnd.choice([2, 3, 3, 5, 7]), x, y, x + w, y + h, rnd.randint(1, 99) / 100))
    vehicles = spark.createDataFrame(data, "video_id long, frame int, ord int, cls int, x1 int, y1 int, x2 int, y2 int, conf double")
    found = holds.held_by_splits(vehicles, p)
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & {*found._jdf.queryExecution().executedPlan().toString().replace("(", " ").split()}
    got = sorted((r.frame, r.x1, r.y1, r.x2, r.y2, round(r.conf, 9)) for r in found.collect())
    assert got == plain_splits(vehicles.collect(), p) and len(got) > 100


def test_a_missed_motorcycle_is_held(spark):
    frames = {3: ([], [(MOTO, (300, 180, 420, 420), 0.7)]), 4: ([], []), 5: ([], []), 6: ([], []), 7: ([], [(MOTO, (316, 180, 436, 420), 0.9)])}
    f, _, vehicles = cached(spark, {k: ([((0, 0, 1, 1), 0.5)], v[1]) for k, v in frames.items()})
    assert rows(holds.held(f, vehicles), "frame", "x1", "held") == [(3, 300, False), (4, 304, True), (5, 308, True), (6, 312, True), (7, 316, False)]


def test_a_motorcycle_out_of_a_wide_box_is_restored(spark):
    """At 0 one box holds two; at 1 and 2 only the left one is seen; at 3 both are."""
    wide, left, right = (100, 100, 400, 300), (100, 100, 240, 300), (250, 100, 400, 300)
    seen = {0: [(MOTO, wide, 0.6)], 1: [(MOTO, left, 0.8)], 2: [(MOTO, left, 0.8)], 3: [(MOTO, left, 0.8), (MOTO, right, 0.9)]}
    f, _, vehicles = cached(spark, {k: ([((0, 0, 1, 1), 0.5)], v) for k, v in seen.items()})
    found = holds.added(holds.held(f, vehicles))
    assert rows(found, "frame", "x1", "y1", "x2", "y2") == [(1, 243, 100, 400, 300), (2, 247, 100, 400, 300)]
    assert [round(c, 6) for _, c in rows(found, "frame", "conf")] == [0.7, 0.8]


QUAD = [104.0, 104.0, 196.0, 102.0, 198.0, 156.0, 102.0, 158.0]


def quad_rows(spark, estimates, move=4):
    """A zone that moves on by some pixels a frame; frames without an entry have no zone."""
    data = [(1, f, 0, 100 + move * f, 100, 200 + move * f, 160, [v + (move * f if k % 2 == 0 else 0) for k, v in enumerate(QUAD)] if seen else None) for f, seen in estimates.items()]
    return spark.createDataFrame(data, "video_id long, frame int, zord int, x1 int, y1 int, x2 int, y2 int, quad array<double>")


def test_a_quad_glides_and_gives_up_slowly(spark):
    """One good estimate, then none: ten frames held, three more while it widens, then no more."""
    found = {r.frame: r for r in quads.quad_states(quad_rows(spark, {0: True} | dict.fromkeys(range(1, 18), False))).collect()}
    assert [f for f in sorted(found) if found[f].used] == [*range(14)]
    assert [found[f].points[0] for f in range(11)] == [104 + 4 * f for f in range(11)]
    spread = lambda f: max(found[f].points[::2]) - min(found[f].points[::2])
    assert spread(10) == 96 and spread(10) <= spread(11) <= spread(12) <= spread(13)


def test_a_quad_is_forgotten_without_its_zone(spark):
    estimates = {0: True, 1: False, 3: False, 4: True, 5: False, 20: False}
    found = quads.quad_states(quad_rows(spark, estimates))
    assert rows(found, "frame", "used") == [(0, True), (1, True), (4, True), (5, True)]
    assert rows(quads.quad_states(quad_rows(spark, estimates), by_segment=False)) == rows(found)


def test_draws_depend_on_the_row_alone(spark):
    from framewise.operators import sampling

    images = spark.createDataFrame([(f"s{i}", c) for i in range(200) for c in (0, 1)], "stem string, copy int")
    first = rows(sampling.augmentation_draws(images, motion=0.5))
    assert rows(sampling.augmentation_draws(images.repartition(7), motion=0.5)) == first
    sizes = [r[5] for r in first if r[5] is not None]
    assert 100 < len(sizes) < 300 and set(sizes) <= {7, 9, 11, 13, 15}


def test_outcome_of_a_batch(spark):
    from framewise.operators import metrics

    runs = spark.createDataFrame([("a", True), ("c", False), ("b", False)], "name string, ok boolean")
    assert metrics.batch_outcome(runs).first() == (1, 2, ["b", "c"])

"""Column geometry against plain Python on boxes from a seeded generator."""

import os
import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from framewise.functions import folds, scalars
from framewise.functions import geometry as g
from framewise.operators import quads, tracking
from framewise.plans import reports


def boxes(n, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 60), r.randint(0, 60)
        out.append((i, x, y, x + r.randint(0, 50), y + r.randint(0, 50)))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    a, b = boxes(300), boxes(300, 6)
    data = [(*p, *q[1:]) for p, q in zip(a, b, strict=True)]
    return data, spark.createDataFrame(data, "i int, x1 int, y1 int, x2 int, y2 int, vx1 int, vy1 int, vx2 int, vy2 int")


def test_shares_and_distances_agree_with_plain_code(pairs):
    data, df = pairs
    a, b = g.columns(), g.columns("v")
    got = df.select("i", g.iou(a, b), g.overlaps(a, b), g.distance(a, b), g.area_floored(a), g.centre_in(a, b)).orderBy("i").collect()
    for (_, *v), r in zip(data, got, strict=True):
        p, q = tuple(v[:4]), tuple(v[4:])
        assert r[1] == pytest.approx(tracking.share(p, q))
        assert r[2] == (p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1])
        assert r[3] == pytest.approx(tracking.apart(p, q))
        assert r[4] == tracking.size(p)
        assert r[5] == tracking.holds_middle(p, q)


def test_touching_boxes_do_not_overlap(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 10, 0, 20, 10)], "x1 int, y1 int, x2 int, y2 int, vx1 int, vy1 int, vx2 int, vy2 int")
    assert df.select(g.overlaps(g.columns(), g.columns("v")), g.overlaps(g.columns(), g.columns("v"), 1), g.iou(g.columns(), g.columns("v"))).first() == (False, True, 0.0)


def test_halves_round_to_even_and_clamping_truncates(spark):
    one = spark.range(1)
    assert one.select(g.rounded(F.lit(2.5)), g.rounded(F.lit(3.5)), g.rounded(F.lit(-0.5))).first() == (2, 4, 0)
    cut = g.clamped_size(g.values(0, 0, 1001, 100), 1920, 1080, 0.2)
    assert one.select(*cut).first() == (308, 30, 692, 69)


def test_rear_region_and_remainder(spark):
    one = spark.range(1)
    assert one.select(*g.rear_region(g.values(100, 200, 200, 400), 0.28, 0.05, 1920, 1080)).first() == (95, 256, 205, 400)
    assert one.select(g.remainder(g.values(0, 0, 100, 50), g.values(0, 0, 60, 50))).first()[0] == (60, 0, 100, 50)
    assert one.select(g.remainder(g.values(0, 0, 100, 50), g.values(10, 0, 90, 50))).first()[0] is None


def test_letterbox_round_trip(spark):
    w, h = F.lit(333), F.lit(120)
    box = g.letterbox(w, h, 640, 2.0)
    put = g.Box(*(v * box.scale + p for v, p in zip(g.values(10, 20, 110, 70), (box.pad_x, box.pad_y) * 2, strict=True)))
    assert spark.range(1).select(*g.unletterbox(put, box, w, h)).first() == (10, 20, 110, 70)


def test_quad_takes_the_nearest_order(spark):
    quad = lambda *p: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p))
    got = spark.range(1).select(g.aligned_quad(quad((0, 0), (9, 0), (9, 4), (0, 4)), quad((9, 4), (9, 0), (0, 0), (0, 4)))).first()[0]
    assert [tuple(p) for p in got] == [(0, 0), (9, 0), (9, 4), (0, 4)]


def test_quads_take_orders_as_one_by_one_and_nothing_is_interpreted(spark):
    r = random.Random(3)
    point = lambda top, whole: (r.randint(0, top),) * 2 if r.random() < 0.1 else tuple(r.randint(0, top) if whole else r.uniform(0, top) for _ in "xy")
    data = [(n, *([tuple(map(float, point(top, top < 5))) for _ in range(4)] for _ in "ab")) for n in range(400) for top in (1 if n % 2 else 50,)]
    kind = "array<struct<x: double, y: double>>"
    quads_ = spark.createDataFrame(data, f"n int, a {kind}, b {kind}")
    found = quads_.select("n", g.aligned_quad(F.col("a"), F.col("b")).alias("q"))
    # Of orders that are equally near, as many are here, the first counts.
    assert {q.n: [tuple(p) for p in q.q] for q in found.collect()} == {n: [tuple(p) for p in quads.align(np.array(a), np.array(b))] for n, a, b in data}
    for df in (found, reports.aligned_quads(spark, "/root/testdata/sf0.001")) if os.path.isdir("/root/testdata/sf0.001") else (found,):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    null = spark.sql(f"select cast(null as {kind}) as a, array(named_struct('x', 1d, 'y', cast(null as double))) || array_repeat(named_struct('x', 0d, 'y', 0d), 3) as b")
    assert null.select(F.to_json(g.aligned_quad(F.col("a"), F.col("b")))).first()[0] == '[{"x":1.0},{"x":0.0,"y":0.0},{"x":0.0,"y":0.0},{"x":0.0,"y":0.0}]'


def test_dedupe_grows_the_kept_box(spark):
    data = [(0, 3, 100, 200, 180, 420, 0.66), (1, 3, 110, 210, 170, 340, 0.24), (2, 2, 100, 200, 180, 420, 0.9)]
    df = spark.createDataFrame(data, "ord int, cls int, x1 int, y1 int, x2 int, y2 int, conf double")
    own = df.agg(F.collect_list(F.struct("*")).alias("v")).select(F.explode(folds.dedupe_vehicles(F.col("v"))).alias("v")).select("v.*")
    assert rows(own, "cls", "x1", "y1", "x2", "y2", "conf") == [(2, 100, 200, 180, 420, 0.9), (3, 100, 200, 180, 420, 0.66)]


def test_merging_looks_at_the_last_result_only(spark):
    data = [(0, 0, 10, 10, 0), (5, 0, 15, 10, 1), (30, 0, 40, 10, 2), (12, 0, 14, 5, 3)]
    df = spark.createDataFrame(data, "x1 int, y1 int, x2 int, y2 int, pord int")
    own = df.agg(F.collect_list(F.struct("*")).alias("v")).select(F.explode(folds.merge_touching_last(F.col("v"))).alias("v")).select("v.*")
    assert rows(own) == [(0, 0, 15, 10), (30, 0, 40, 10)]


def test_texts(spark):
    one = spark.range(1)
    got = one.select(
        scalars.time_to_seconds(F.lit("1:30.5")), scalars.time_to_seconds(F.lit("01:02:03")), scalars.time_to_seconds(F.lit("7.25")),
        scalars.format_duration(F.lit(12.34)), scalars.format_duration(F.lit(323.0)), scalars.format_duration(F.lit(4325.0)),
        scalars.parse_color(F.lit("255, 0,7")), scalars.class_name(F.lit(3)), scalars.class_name(F.lit(9)), scalars.estimated_frames(F.lit(1.0), F.lit(0.0), F.lit(11.0), F.lit(30.0)),
    ).first()
    assert tuple(got) == (90.5, 3723.0, 7.25, "12.3s", "5m23s", "1h12m05s", [7, 0, 255], "motorcycle", "9", 300)
    with pytest.raises(Exception, match="expected x1,y1,x2,y2"):
        one.select(scalars.parse_region(F.lit("1,2,3"))).collect()


def test_sql_functions_equal_the_columns(spark):
    from framewise.functions import sql

    names = sql.register(spark)
    r = random.Random(5)
    box = lambda: (x := r.randint(-50, 900), y := r.randint(-50, 500), x + r.randint(-3, 300), y + r.randint(-3, 300))
    data = [(*box(), *box(), r.randint(0, 40), r.choice([2, 3, 5, 7]), r.choice([2, 3, 5, 7]), r.random()) for _ in range(300)]
    rows_ = spark.createDataFrame(data, "ax1 int, ay1 int, ax2 int, ay2 int, bx1 int, by1 int, bx2 int, by2 int, gap int, x int, y int, t double")
    pairs = rows_.select(*(F.struct(*(F.col(s + e).alias(e) for e in g.Box._fields)).alias(s) for s in "ab"), "gap", "x", "y", "t")
    pairs.createOrReplaceTempView("box_pairs")
    asked = {"margin": "gap", "v": "b", "px": "80D", "frac": "0.35D", "flip": "10", "least": "0.15D"}
    values = {"px": F.lit(80.0), "frac": F.lit(0.35), "flip": F.lit(10), "least": F.lit(0.15), "margin": F.col("gap")}
    for name in names:
        kinds, made = sql.FUNCTIONS[name]
        columns = [g.fields(F.col(asked.get(p, p))) if k == "box" else values[p] if p in values else F.col(p) for p, k in kinds.items()]
        want = [r.value for r in pairs.select(made(*columns).alias("value")).collect()]
        found = spark.sql(f"select {name}({', '.join(asked.get(p, p) for p in kinds)}) as value from box_pairs")
        assert [r.value for r in found.collect()] == want and len({*map(str, want)}) > 1, name
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan

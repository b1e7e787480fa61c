"""Tasks on written caches, against the operators they call."""

import json

import pytest
from compare import rows
from pyspark.sql import functions as F
from test_tracking import cached, random_cache

from framewise.__main__ import TASKS, run
from framewise.operators import audit, metrics, tracking
from framewise.schema import DEFAULTS
from framewise.sources import cache, labels


@pytest.fixture(scope="module")
def caches(spark, tmp_path_factory):
    f, plates, vehicles = cached(spark, random_cache(5, 60))
    path = str(tmp_path_factory.mktemp("caches") / "a")
    cache.to_lines(f, plates, vehicles, cache.meta(width=1920, height=1080)).coalesce(1).sortWithinPartitions("video_id").select("value").write.text(path)
    return path, f, plates, vehicles


def test_tracks_of_a_cache_equal_the_operator(spark, caches, tmp_path):
    path, f, plates, vehicles = caches
    columns = ["frame", "x1", "y1", "x2", "y2", "conf", "track_id"]
    found = run(spark, ["tracks", path, "--out", f"{tmp_path}/out"])
    assert rows(spark.read.parquet(f"{tmp_path}/out"), *columns) == rows(found, *columns) == rows(tracking.selected(f, plates, vehicles, DEFAULTS), *columns)


@pytest.mark.parametrize("task", sorted(set(TASKS) - {"tracks", "fixlists", "seconds"}))
def test_each_task_runs(spark, caches, task, tmp_path):
    fixes = tmp_path / "fixes.json"
    fixes.write_text('{"1": [[10, 10, 60, 40]]}')
    assert run(spark, [task, caches[0], "--end", "200", "--own-plate", "0,900,100,1000", "--fixlist", str(fixes), "--vehicles", "motorbike"]).count() > 0


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    """Caches a.jsonl and b.jsonl, and their tables."""
    folder, found = tmp_path_factory.mktemp("two"), {}
    for name, seed in (("a", 5), ("b", 9)):
        f, plates, vehicles = cached(spark, random_cache(seed, 60))
        lines = cache.to_lines(f, plates, vehicles, cache.meta(width=1920, height=1080)).orderBy("at")
        (folder / f"{name}.jsonl").write_text("".join(r.value + "\n" for r in lines.collect()))
        found[name] = f, plates, vehicles
    return folder, found


def ids(spark, folder):
    found = cache.read_lines(spark, str(folder)).select("video", F.xxhash64("video").alias("id")).distinct()
    return {r.video.rpartition("/")[2].removesuffix(".jsonl"): r.id for r in found.collect()}


def test_fixlists_go_to_the_videos_they_are_named_like(spark, two, tmp_path):
    folder, tables = two
    known = [{r.frame for r in f.collect()} for f, _, _ in tables.values()]
    one, other = sorted(known[0] & known[1])[:2]
    for name, box in (("a", "[10, 10, 60, 40]"), ("b", "[200, 220, 290, 300]"), ("other", "[1, 1, 99, 99]")):
        (tmp_path / f"{name}.json").write_text(f'{{"{one}": [{box}], "{other}": [{box}]}}')
    found = run(spark, ["plan", str(folder), "--fixlist", str(tmp_path)]).filter("src = 'forced'")
    video = ids(spark, folder)
    boxes = {(r.video_id, r.frame): (r.x1, r.y1) for r in found.collect()}
    assert {*boxes} == {(v, f) for v in video.values() for f in (one, other)}
    assert all(boxes[video["a"], f][0] < 20 and boxes[video["b"], f][0] > 150 for f in (one, other))
    only = run(spark, ["plan", str(folder), "--fixlist", f"{tmp_path}/b.json"]).filter("src = 'forced'")
    assert {r.video_id for r in only.collect()} == {video["b"]}


def test_an_audit_ends_in_a_fixlist_for_each_video(spark, two, tmp_path):
    folder, tables = two
    measured = [(name, r.frame, r.pord, 200.0 if (r.frame + r.pord) % 3 == 0 else 20.0) for name, (_, plates, _) in tables.items() for r in plates.collect()]
    spark.createDataFrame(measured, "stem string, frame int, pord int, var double").write.parquet(f"{tmp_path}/m")
    options = ["--measured", f"{tmp_path}/m", "--readable", "100"]
    found = run(spark, ["audit", str(folder), *options])
    video, want = ids(spark, folder), []
    for name, (_, plates, _) in tables.items():
        var = F.when((F.col("frame") + F.col("pord")) % 3 == 0, 200.0).otherwise(20.0)
        own = audit.findings(plates.withColumn("var", var), readable=100.0)
        want += [(video[name], *r) for r in rows(own, "frame", "pord", "readable")]
    assert rows(found, "video_id", "frame", "pord", "readable") == sorted(want)
    lists = {r.stem: json.loads(r.json) for r in run(spark, ["fixlists", str(folder), *options]).collect()}
    assert {*lists} == {"a", "b"}
    for name, fixes in lists.items():
        assert {int(f) for f in fixes} == {f for v, f, _, readable in want if v == video[name] and readable}
        (tmp_path / f"{name}.json").write_text(json.dumps(fixes))
    # With these patches nothing readable is left.
    (tmp_path / "fixes").mkdir()
    for name in lists:
        (tmp_path / f"{name}.json").rename(tmp_path / "fixes" / f"{name}.json")
    assert run(spark, ["audit", str(folder), *options, "--fixlist", f"{tmp_path}/fixes"]).filter("readable").count() == 0


def test_exports_write_the_labels_of_their_split(spark, two, tmp_path):
    folder, _ = two
    found = run(spark, ["exports", str(folder), "--positives", "30", "--negatives", "10", "--labels", f"{tmp_path}/labels"])
    want = {(r.split, r.stem): r.value for r in found.collect()}
    assert {s for s, _ in want} == {"train", "val"} and any(want.values()) and not all(want.values())
    got = {}
    for split in ("train", "val"):
        for r in spark.read.text(f"{tmp_path}/labels/{split}").collect():
            got[split, r.stem] = r.value
    assert got == want
    parsed = labels.parse_labels(found.filter("positive"), F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1"))
    assert all(abs(r.x1 - r.lx1) < 0.01 and abs(r.y2 - r.ly2) < 0.01 for r in parsed.collect())


def test_key_seconds_equal_the_operator(spark, two):
    folder, tables = two
    found = run(spark, ["seconds", str(folder / "a.jsonl"), "--fps", "4"])
    _, plates, vehicles = tables["a"]
    want = metrics.key_seconds(plates, vehicles, 4.0)
    assert rows(found, "second", "moto_frames", "geo_frames") == rows(want, "second", "moto_frames", "geo_frames") and found.count() > 0

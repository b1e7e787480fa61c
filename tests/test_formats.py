"""Formats of its own: raw frames read in ranges, caches that a job commits; exact order statistics."""

import json
import math
import os
import random

import pytest
from compare import rows
from pyspark.sql import functions as F
from test_tracking import cached, random_cache

from framewise import schema
from framewise.operators import filters, metrics, quantiles, sampling, table_functions
from framewise.sources import cache, cache_sink, frames_source


HEADER = cache.meta(width=1920, height=1080)


def sequential(path):
    """Frames of a raw file, one after another, by another reader."""
    with open(path, "rb") as f:
        tags = dict((t[:1], t[1:]) for t in f.readline().decode().split()[1:])
        size = int(tags["W"]) * int(tags["H"]) * {"mono": 2, "420": 3, "444": 6}[tags["C"]] // 2
        while f.readline() == b"FRAME\n":
            yield f.read(size)


@pytest.fixture(scope="module")
def videos(tmp_path_factory):
    folder = tmp_path_factory.mktemp("videos")
    (folder / "more").mkdir()
    for name, chroma, fps, n in (("a", "mono", "30:1", 101), ("more/b", "420", "30000:1001", 7), ("c", "444", "10:1", 0), ("d", "mono", "10:1", 40)):
        size = 4 * 2 * {"mono": 2, "420": 3, "444": 6}[chroma] // 2
        with open(folder / f"{name}.y4m", "wb") as f:
            f.write(f"YUV4MPEG2 W4 H2 F{fps} Ip C{chroma}\n".encode())
            for i in range(n):
                f.write(b"FRAME\n" + bytes((i * 7 + k + len(name)) % 256 for k in range(size)))
    (folder / "_hidden.y4m").write_bytes(b"no video")
    return str(folder)


@pytest.fixture(scope="module")
def loaded(spark, videos):
    frames_source.register(spark)
    return lambda **options: spark.read.format("framewise_frames").options(**options).load(videos)


def test_ranges_of_frames_equal_a_sequential_reader(loaded, videos):
    want = []
    for name, fps in (("a", 30), ("more/b", 30000 / 1001), ("c", 10), ("d", 10)):
        path = f"{videos}/{name}.y4m"
        want += [(path, i, i / fps, 2, 4, data) for i, data in enumerate(sequential(path))]
    for options in ({}, {"span": 9}):
        found = loaded(**options)
        assert sorted((*r[:5], bytes(r[5])) for r in found.collect()) == sorted(want)
    assert loaded(span=9).rdd.getNumPartitions() == 12 + 1 + 5


def test_bounds_are_pushed_into_the_scan(loaded, videos):
    clip = loaded(span=8).filter("frame >= 10 and frame < 30 and t > 0.5")
    plan = clip._sc._jvm.PythonSQLUtils.explainString(clip._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(frame,10)" in plan and "LessThan(frame,30)" in plan and "GreaterThan(t,0.5)" in plan and "Condition" not in plan
    want = sorted((r.video, r.frame) for r in loaded().collect() if 10 <= r.frame < 30 and r.t > 0.5)
    assert sorted((r.video, r.frame) for r in clip.collect()) == want and len(want) > 20
    # Frames 16 to 29 of one video, 10 to 29 of the other: no other range is read.
    assert clip.rdd.getNumPartitions() == 2 + 3
    one = loaded().filter(F.col("video") == f"{videos}/d.y4m")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 40
    assert loaded().filter("frame = 3 and height = 2").count() == 3 and loaded().filter("frame > 5 and frame < 5").count() == 0
    assert loaded().filter("frame in (1, 2, 200)").count() == 6


@pytest.mark.parametrize(("rate", "start", "end"), [(10, 0, 2), (7, 0.5, 1.5), (60, 1, 2), (29.97, 0, None), (1, 0, None)])
def test_sampled_pictures_are_those_shown_then(loaded, videos, rate, start, end):
    options = {"rate": rate, "start": start} | ({} if end is None else {"end": end})
    found = sorted((r.frame, r.t, bytes(r.content)) for r in loaded(**options).filter(F.col("video").endswith("/a.y4m")).collect())
    shown = [*sequential(f"{videos}/a.y4m")]
    own = shown[math.ceil(start * 30) :]
    want = []
    for i in range(math.ceil(((end if end is not None else len(shown) / 30) - start) * rate)):
        # A frame is shown from the sample nearest to its own time on, halves later.
        candidates = [k for k in range(len(own)) if math.floor(k * rate / 30 + 0.5 + 1e-9) <= i]
        if candidates:
            want.append((i, start + i / rate, own[max(candidates)]))
    assert [(i, pytest.approx(t), c) for i, t, c in want] == found


def test_a_clip_has_the_rows_whose_frames_the_video_holds(spark, tmp_path):
    frames_source.register(spark)
    lengths = (15, 16, 17, 38, 40, 42, 43, 44, 60)
    for n in lengths:
        (tmp_path / f"v{n}.y4m").write_bytes(b"YUV4MPEG2 W1 H1 F30:1 Cmono\n" + b"".join(b"FRAME\n" + bytes([k]) for k in range(n)))
    found = spark.read.format("framewise_frames").options(rate=7, start=0.5, end=1.5).load(str(tmp_path)).collect()
    # As frames_sampled's SQL has it: row i shows frame 15 + (60 i + 43) // 14 - 1, if there is one.
    want = [(n, i, bytes([k])) for n in lengths for i in range(7) if (k := 15 + (60 * i + 43) // 14 - 1) < n]
    assert sorted((int(os.path.basename(r.video)[1:-4]), r.frame, bytes(r.content)) for r in found) == want


def test_many_videos_and_ranges_are_read_by_few_tasks(spark, tmp_path):
    frames_source.register(spark)
    video = lambda n: b"YUV4MPEG2 W1 H1 F10:1 Cmono\n" + b"".join(b"FRAME\n" + bytes([k]) for k in range(n))
    lengths = {f"v{v}": v % 60 for v in range(600)}
    (tmp_path / "many").mkdir()
    for name, n in lengths.items():
        (tmp_path / "many" / f"{name}.y4m").write_bytes(video(n))
    load = lambda path, span: spark.read.format("framewise_frames").option("span", span).load(str(tmp_path / path))
    clip = load("many", 16).filter("frame >= 5 and frame < 40 and t > 0.95")
    assert clip.rdd.getNumPartitions() <= frames_source.FEW
    assert sorted((os.path.basename(r.video)[:-4], r.frame, r.t, r.content[0]) for r in clip.collect()) == sorted((v, k, k / 10, k) for v, n in lengths.items() for k in range(10, min(n, 40)))
    (tmp_path / "many" / "torn.y4m").write_bytes(video(3)[:-1])
    with pytest.raises(Exception, match="ends within a frame"):
        load("many", 16).count()
    (tmp_path / "short.y4m").write_bytes(video(256))
    one = load("short.y4m", 1)
    assert one.rdd.getNumPartitions() == 256 and one.filter("frame < 9").rdd.getNumPartitions() == 9
    (tmp_path / "long.y4m").write_bytes(b"YUV4MPEG2 W1 H1 F10:1 Cmono\n" + b"FRAME\na" * 2000)
    long = load("long.y4m", 1)
    assert long.rdd.getNumPartitions() <= frames_source.FEW and sorted(r.frame for r in long.collect()) == [*range(2000)]


def test_torn_and_foreign_files_are_refused(spark, tmp_path):
    frames_source.register(spark)
    for data, message in ((b"RIFF....", "not a YUV4MPEG2"), (b"YUV4MPEG2 W2 H1 Cmono\nFRAME\nab" + b"FRAME\na", "ends within a frame"), (b"YUV4MPEG2 W2 H1 Cmono\nGRAME\nab", "no frame 0")):
        (tmp_path / "x.y4m").write_bytes(data)
        with pytest.raises(Exception, match=message):
            spark.read.format("framewise_frames").load(str(tmp_path)).collect()
    (tmp_path / "x.y4m").unlink()
    assert spark.read.format("framewise_frames").load(str(tmp_path)).count() == 0


def test_written_frames_are_read_back(spark, tmp_path):
    data = [(f"v{v}", f, 1, 3, bytes([v, f, 9])) for v in range(5) for f in range(30)]
    frames_source.write_frames(spark.createDataFrame(data, "video string, frame int, height int, width int, content binary").repartition(4), str(tmp_path / "out"), "25:1")
    found = spark.read.format("framewise_frames").load(str(tmp_path / "out"))
    assert sorted((os.path.basename(r.video)[:-4], r.frame, r.height, r.width, bytes(r.content)) for r in found.collect()) == data
    assert found.filter("frame = 5").first().t == 0.2


@pytest.mark.parametrize(("source", "trailer"), [(frames_source.FramesSource, None), (cache_sink.CacheSink, '{"eof": 2}')])
def test_what_tasks_tell_the_driver_does_not_grow_with_files(spark, tmp_path, source, trailer):
    n, told = 3000, tmp_path / "told"

    class Probe(source):
        @classmethod
        def name(cls):
            return f"probe_{source.name()}"

        def writer(self, schema, overwrite):
            import pickle

            own = super().writer(schema, overwrite)

            class Told(type(own)):
                def commit(self, messages):
                    told.write_text(str(len(pickle.dumps(messages))))
                    super().commit(messages)

            own.__class__ = Told
            return own

    (cache_sink if trailer else frames_source).register(spark)
    spark.dataSource.register(Probe)
    if trailer:
        # The second line of a video comes from another task, which has the videos in another order.
        rows_ = spark.range(2 * n).repartition(2, F.col("id") >= n).select((F.col("id") % n).alias("video_id"), F.col("id").alias("at"), F.lit('{"f": 1, "p": [], "v": []}').alias("value"))
        rows_ = rows_.sortWithinPartitions(F.when(F.col("at") >= n, -F.col("at")).otherwise(F.col("at")))
    else:
        rows_ = spark.range(n).repartition(1).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video"), F.lit(0).alias("frame"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(b"a").alias("content"))
    rows_.write.format(Probe.name()).option("header", json.dumps(HEADER)).mode("append").save(str(tmp_path / "out"))
    assert int(told.read_text()) < 2000
    if trailer:
        eof = [d / "eof.jsonl" for d in (tmp_path / "out").glob("video_id=*")]
        assert len(eof) == n and {p.read_text().strip() for p in eof} == {trailer}
    else:
        assert spark.read.format("framewise_frames").load(str(tmp_path / "out")).select("video").distinct().count() == n


@pytest.fixture(scope="module")
def detections(spark):
    return cached(spark, random_cache(7, 60))


def test_a_committed_cache_is_whole(spark, detections, tmp_path):
    f, p, v = detections
    cache_sink.write_cache(f, p, v, str(tmp_path / "c"), HEADER)
    lines = cache_sink.read_lines(spark, str(tmp_path / "c"))
    assert all(r.complete and r.meta["width"] == "1920" for r in cache.headers(lines).collect())
    n = {r.video_id: r.n for r in f.distinct().groupBy("video_id").agg(F.count("*").alias("n")).collect()}
    eof = {int(d.name[len("video_id=") :]): json.loads((d / "eof.jsonl").read_text())["eof"] for d in (tmp_path / "c").glob("video_id=*")}
    assert eof == n
    assert rows(cache.plates(lines).withColumnRenamed("video", "video_id"), "video_id", "frame", "pord", "x1", "conf") == rows(p, "video_id", "frame", "pord", "x1", "conf")


def test_caches_are_listed_and_read_by_tasks(spark, tmp_path):
    frames = spark.range(900).select((F.col("id") % 300 - 20).alias("video_id"), F.col("id").alias("at"), F.format_string('{"f": %d, "p": [], "v": []}', "id").alias("value"))
    cache_sink.write(frames, str(tmp_path / "c"), HEADER)
    (tmp_path / "c" / "video_id=5" / "_hidden.jsonl").write_text("hidden")
    (tmp_path / "c" / "video_id=900").mkdir()
    (tmp_path / "c" / "video_id=900" / "part-0.jsonl").write_text('{"f": 7, "p": [], "v": []}\r\n\n{"f": 8, "p": [], "v": []}')
    lines = cache_sink.read_lines(spark, str(tmp_path / "c"))
    assert "FileScan" not in lines._jdf.queryExecution().executedPlan().toString() and lines.inputFiles() == []
    assert rows(cache.frames(lines)) == sorted([(i % 300 - 20, i) for i in range(900)] + [(900, 7), (900, 8)])
    assert {(r.video, r.complete) for r in cache.headers(lines).collect()} == {(v, True) for v in range(-20, 280)} | {(900, False)}


@pytest.mark.parametrize("data", [b"", b"a", b"\n", b"a\n\nbcd\n", b"ab\r\nc", b"long line of text\nx\n\n\ny"])
def test_ranges_of_a_cache_hold_each_line_once(tmp_path, data):
    (tmp_path / "x").write_bytes(data)
    for span in range(1, len(data) + 2):
        found = [line for k in range(0, len(data), span) for line in cache_sink._lines_of(str(tmp_path / "x"), k, min(k + span, len(data)))]
        assert found == data.splitlines()


def test_a_job_that_ends_early_leaves_partial_videos_and_a_repeated_one_whole_ones(spark, tmp_path):
    path = str(tmp_path / "c")
    good = spark.createDataFrame([(v, f, json.dumps({"f": f, "p": [], "v": []})) for v in (1, 2) for f in range(50)], "video_id long, at long, value string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        cache_sink.register(spark)
        broken = good.withColumn("value", F.when((F.col("video_id") == 2) & (F.col("at") == 40), F.lit(None)).otherwise(F.col("value")))
        with pytest.raises(Exception, match="without a video or a value"):
            cache_sink.write(broken, path, HEADER)
        lines = cache_sink.read_lines(spark, path) if any((tmp_path / "c").glob("video_id=*")) else None
        if lines is not None:
            assert not cache.headers(lines).filter("complete").count()
            # The attempt that failed left no line; what other tasks had finished is there.
            assert cache.frames(lines).filter("video = 2 and frame = 39").count() == 0
        # What a lost attempt of another job left goes when the video is written anew.
        (tmp_path / "c" / "video_id=1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "video_id=1" / "part-000099-7.jsonl").write_text('{"f": 777, "p": [], "v": []}\n')
        cache_sink.write(good, path, HEADER)
        lines = cache_sink.read_lines(spark, path)
        assert cache.headers(lines).filter("complete").count() == 2
        assert sorted(map(tuple, cache.frames(lines).collect())) == [(v, f) for v in (1, 2) for f in range(50)]
        # A long video lies in several files.
        assert len([*(tmp_path / "c" / "video_id=1").glob("part-*")]) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# Order statistics

POINTS = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)


def test_percentiles_of_millions_keep_few_values_in_a_task(spark, tmp_path, monkeypatch):
    values = spark.range(0, 2_000_000, 1, 8).select(F.exp(F.rand(1) * 20 - 10).alias("a"), (F.randn(2) * 100).alias("b"), F.when(F.rand(3) < 0.5, F.floor(F.rand(4) * 10).cast("double")).alias("c"), F.lit(None).cast("double").alias("d"))
    values.write.parquet(f"{tmp_path}/v")
    values = spark.read.parquet(f"{tmp_path}/v")
    seen = []
    whole = quantiles._histogram
    monkeypatch.setattr(quantiles, "_histogram", lambda *a: seen.append(whole(*a)) or seen[-1])
    found = quantiles.percentiles(values, dict.fromkeys("abcd", POINTS))
    want = values.agg(*(F.percentile(c, F.array(*map(F.lit, POINTS))).alias(c) for c in "abcd")).first()
    assert all(found[c] == list(want[c]) for c in "abc") and found["d"] == [None] * 6
    # Bins are all that a task keeps: at most 1,024 for a range, and two ranges for a fraction.
    assert len(seen) <= 7 and max(map(len, seen)) <= 2 * len(POINTS) * 3 * quantiles.BINS


def test_percentiles_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    for data in ([], [None], [3.0], [0.0, -0.0, 0.0], [-5.0, 5e-324, -5e-324, 1e308, -1e308, 0.0], [1.0, nan, inf, -inf], [7.0] * 5000 + [8.0], [-(2.0**k) for k in range(-1000, 1000, 7)]):
        values = spark.createDataFrame([(x,) for x in data], "x double")
        want = values.agg(F.percentile("x", F.array(*map(F.lit, POINTS))).alias("p")).first().p or [None] * len(POINTS)
        found = quantiles.percentiles(values, {"x": POINTS})["x"]
        assert [str(x) if x is None or x != x else x for x in found] == [str(x) if x is None or x != x else x for x in want]


def test_reports_hold_no_values_in_one_buffer(spark, detections):
    _, p, v = detections
    sizes = metrics.plate_sizes(metrics.moto_plates(p, v))
    assert "percentile" not in sizes._jdf.queryExecution().executedPlan().toString().lower()


# Prefixes and patches


def test_a_global_prefix_equals_row_numbers_over_the_whole(spark):
    rows_ = spark.range(0, 5000).select("id", (F.hash("id") % 97).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("w"))
    ordered = sorted(map(tuple, rows_.collect()), key=lambda r: (r[1], r[0]))
    for budget in (0, 1, 777, 4999, 5000, 9000):
        found = sampling.global_prefix(rows_, ("k", "id"), budget)
        assert sorted(map(tuple, found.select("id", "k", "w").collect())) == sorted(ordered[:budget])
    for budget in (0, 5, 1234, 10**6):
        upto, want = 0, []
        for r in ordered:
            upto += r[2] or 0
            if upto <= budget:
                want.append(r)
        found = sampling.global_prefix(rows_, ("k", "id"), budget, F.col("w"))
        assert sorted(found.select("id").collect()) == sorted((r[0],) for r in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("range-sums", "") and sampling.global_prefix(rows_.filter("id < 0"), ("k", "id"), 5).count() == 0
    with pytest.raises(Exception, match="a negative weight"):
        sampling.global_prefix(rows_, ("k", "id"), 5, -F.col("w")).count()


def test_plates_off_many_patches_equal_brute_force(spark):
    r = random.Random(4)
    box = lambda: (x := r.randint(-300, 1900), y := r.randint(-300, 1000), x + r.randint(-5, 300), y + r.randint(-5, 300))
    plates = [(v, f, n, *box()) for v in (1, 2) for f in range(30) for n in range(4)] * 2
    patches = [(v, *box()) for v in (1, 2, 3) for _ in range(25)] * 2
    found = filters.not_on_patches(spark.createDataFrame(plates, "video_id long, frame int, pord int, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(patches, "video_id long, x1 int, y1 int, x2 int, y2 int"))
    hit = lambda a, b: a[0] - 8 < b[2] and b[0] < a[2] + 8 and a[1] - 8 < b[3] and b[1] < a[3] + 8
    want = sorted(p for p in plates if not any(p[0] == q[0] and hit(p[3:], q[1:]) for q in patches))
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < len(plates)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


# A detector in SQL


def test_a_detector_is_a_table_function(spark):
    def model(seen):
        assert len(seen) <= 3 and len({r.video_id for r in seen}) == 1
        return [[(3, r.frame, k, r.frame + 5, k + 5, 0.5) for k in range(len(r.content))] for r in seen]

    table_functions.register(spark, model, "test_detect", 3)
    data = [(v, f, b"x" * ((v + f) % 4)) for v in (1, 2, 3) for f in range(11)]
    spark.createDataFrame(data, "video_id long, frame int, content binary").createOrReplaceTempView("detector_frames")
    found = spark.sql("select * from test_detect(table(detector_frames) partition by video_id order by frame)")
    want = [(v, f, k, 3, f, k, f + 5, k + 5, 0.5) for v, f, c in data for k in range(len(c))]
    assert rows(found) == sorted(want)
    assert [x.split()[0] for x in schema.VEHICLES.split(", ")] == found.columns
    with pytest.raises(Exception, match="frames have no content"):
        spark.sql("select * from test_detect(table(select 1L as video_id, 2 as frame) partition by video_id)").collect()

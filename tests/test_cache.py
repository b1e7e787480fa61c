"""Cache files, headers, replay and small sources."""

import pytest
from compare import rows
from pyspark.sql import functions as F

from framewise.schema import PLATES, VEHICLES, Params
from framewise.sources import cache, labels, media


def test_lines_written_are_read_back(spark, tmp_path):
    frames = spark.createDataFrame([(7, 0), (7, 1), (7, 5)], "video_id long, frame int")
    plates = spark.createDataFrame([(7, 1, 0, 1, 2, 3, 4, 0.5, "crop"), (7, 1, 1, 5, 6, 7, 8, 0.25, None)], PLATES)
    vehicles = spark.createDataFrame([(7, 5, 0, 3, 1, 2, 30, 40, 0.75)], VEHICLES)
    cache.write_lines(cache.to_lines(frames, plates, vehicles, cache.meta(width=1920, fps=1.0)), str(tmp_path / "c"))
    lines = cache.read_lines(spark, str(tmp_path / "c"))
    assert rows(cache.frames(lines), "frame") == [(0,), (1,), (5,)]
    assert rows(cache.plates(lines), "frame", "pord", "x1", "conf", "src") == [(1, 0, 1, 0.5, "crop"), (1, 1, 5, 0.25, None)]
    assert rows(cache.vehicles(lines), "frame", "cls", "x2", "conf") == [(5, 3, 30, 0.75)]
    head = cache.headers(lines)
    assert head.first().complete
    cache.check_headers(head, cache.meta(width=1920))
    with pytest.raises(cache.CacheMismatch, match="width"):
        cache.check_headers(head, cache.meta(width=1280))


def test_the_last_line_of_a_frame_counts(spark):
    data = [("v", 0, '{"f": 3, "p": [[1, 2, 3, 4, 0.5]], "v": []}'), ("v", 1, '{"f": 3, "p": [], "v": []}')]
    lines = spark.createDataFrame(data, "video string, at long, value string")
    assert cache.plates(lines).count() == 0
    assert not cache.headers(lines).first().complete


def test_ranges_and_replay(spark):
    one = spark.range(1)
    null, num = F.lit(None).cast("double"), lambda v: F.lit(float(v))
    fits = one.select(cache.range_compatible(null, null, num(5), num(9)), cache.range_compatible(num(0), null, num(5), null), cache.range_compatible(num(5), num(9), num(5), num(9)), cache.range_compatible(num(5), num(9), num(6), num(9))).first()
    assert tuple(fits) == (True, True, True, False)
    assert one.select(cache.replay_index(F.lit(10), num(310), F.lit(29.97), F.lit(True))).first()[0] == round(310 * 29.97) + 10


def test_probe_turns_and_evens(spark):
    text = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"hevc","width":1921,"height":1080,"r_frame_rate":"30000/1001","side_data_list":[{"side_data_type":"Display Matrix","rotation":-90}]}],"format":{"duration":"9.5"}}'
    info = spark.range(1).select(media.video_info(F.lit(text))).first()[0]
    assert (info.width, info.height, info.codec, info.pix_fmt, info.duration) == (1080, 1920, "hevc", "yuv420p", 9.5)
    flags = spark.range(1).select(media.color_flags(F.lit("color_range=tv\ncolor_space=bt709\ncolor_primaries=unknown\n"))).first()[0]
    assert flags == ["-colorspace", "bt709", "-color_range", "tv"]


def test_configuration_and_labels(spark):
    p = labels.load_config("[zones]\nmax_gap_frames = 12\n[blur]\nstrength = 51\n")
    assert (p.max_gap, p.blur_strength, p.max_disp_px) == (12, 51, Params().max_disp_px)
    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.2"), ("a", "0 0.5")], "stem string, value string")
    assert rows(labels.parse_labels(lines, F.lit(100.0), F.lit(50.0), True), "x1", "y1", "x2", "y2") == [(45, 20, 55, 30)]

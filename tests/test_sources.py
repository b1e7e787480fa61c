"""Pictures, command lines, devices, shared folders: small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise import shared
from framewise.operators import models, sampling
from framewise.sources import media


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pictures_come_back_from_files(spark, tmp_path, channels):
    picture = np.random.default_rng(channels).integers(0, 256, (7, 5, channels)).astype(np.uint8)
    assert (media.read_png(media.write_png(picture)) == picture).all()
    (tmp_path / "cover.png").write_bytes(media.write_png(picture))
    assert (media.overlay_image(spark, f"file://{tmp_path}/cover.png") == picture).all()
    with pytest.raises(ValueError, match="not a PNG"):
        media.read_png(b"GIF89a")


def test_filtered_lines_are_undone():
    """All five line filters of the format, made here by their definitions."""
    import struct
    import zlib

    picture = np.random.default_rng(9).integers(0, 256, (5, 6, 3)).astype(np.int64)
    lines = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = bytearray([kind])
        for x in range(6):
            for c in range(3):
                a = picture[y, x - 1, c] if x else 0
                b = picture[y - 1, x, c] if y else 0
                d = picture[y - 1, x - 1, c] if x and y else 0
                near = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
                line.append(int(picture[y, x, c] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        lines += bytes(line)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"0000"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (media.read_png(data) == picture[..., ::-1]).all()


def test_command_lines():
    with_sound, without = media.mux_commands("v.avi", "a.mov", "o.mp4", True, 20, colors=["-colorspace", "bt709"])
    assert with_sound[-1] == without[-1] == "o.mp4" and "hevc_nvenc" in with_sound and "20" in without and with_sound.count("-i") == 2 and without.count("-i") == 1
    assert "libx265" in media.mux_commands("v", "a", "o", False)[0] and "-colorspace" in without
    assert media.audio_command("in.mp4", "a.mov", 1.5, 4.0)[2:8] == ["-ss", "1.500000", "-i", "in.mp4", "-t", "2.500000"]
    assert media.decoder_for("hevc", True) == "hevc_cuvid" and media.decoder_for("hevc", False) is None


def test_resizing_keeps_means_and_boxes_come_back():
    picture = np.arange(12 * 8 * 3).reshape(12, 8, 3).astype(np.uint8)
    small = models.resized(picture, 4, 6)
    want = picture.reshape(6, 2, 4, 2, 3).astype(float).mean((1, 3))
    assert np.abs(small - want).max() <= 0.5
    seen = []
    model = models.on_shrunk(lambda ps: [seen.append(p.shape) or [(2, 10, 20, 30, 40, 0.5)] for p in ps], 100)
    assert model([np.zeros((100, 200, 3), np.uint8), np.zeros((50, 80, 3), np.uint8)]) == [[(2, 20, 40, 60, 80, 0.5)], [(2, 10, 20, 30, 40, 0.5)]]
    assert seen == [(50, 100, 3), (50, 80, 3)]


def test_sharpness_is_measured_at_one_size():
    flat = np.full((200, 300, 3), 90, np.uint8)
    stripes = flat.copy()
    stripes[:, ::8] = 250
    assert models.plate_sharpness(flat, (10, 10, 106, 42)) == 0 == models.plate_sharpness(stripes, (0, 0, 7, 30))
    one, two = stripes[:32, :96], np.repeat(np.repeat(stripes[:32, :96], 2, 0), 2, 1)
    assert models.plate_sharpness(one, (0, 0, 96, 32)) == pytest.approx(models.plate_sharpness(two, (0, 0, 192, 64)))
    assert models.plate_sharpness(one, (0, 0, 96, 32)) > 150


@pytest.mark.parametrize("shape", ["feathered", "circle", "rotated"])
def test_shapes_blur_inside_and_leave_the_rest(shape):
    picture = np.random.default_rng(2).integers(0, 256, (80, 100, 3)).astype(np.uint8)
    quad = np.array([(30, 20), (70, 30), (66, 60), (26, 50)])
    out = models.blur_shape(picture, (20, 10, 80, 70), 21, shape, 5, quad)
    assert (out[:10] == picture[:10]).all() and (out[:, 80:] == picture[:, 80:]).all()
    assert out[35:45, 45:55].std() < picture[35:45, 45:55].std() / 3
    if shape != "feathered":
        assert (out[12, 22] == picture[12, 22]).all()
    assert (models.blur_shape(picture, (5, 5, 6, 50), 21, shape, 5, quad) == picture).all()


def test_forced_crops_do_not_count(spark):
    crops = spark.createDataFrame([(1, f, 0, 3, [0.9], f % 2 == 0) for f in range(16)], "video_id long, frame int, ord int, cls int, confs array<double>, f boolean")
    kept = {r.frame for r in sampling.keep_one_in_n(crops, force=F.col("f")).collect() if r.kept}
    assert kept == {*range(0, 16, 2), 7, 15}


def test_written_tables_are_removed(spark, tmp_path):
    found = shared.written(spark.range(3), "short-lived")
    path = next(p for d, p in shared._folders.values() if d is found).removeprefix("file://")
    import os

    assert os.path.isdir(path) and found.count() == 3
    shared.discard(found)
    shared.discard(found)
    assert not os.path.exists(path)


def test_shared_folder_keeps_its_file_system(spark, tmp_path, monkeypatch):
    class Conf:
        def __init__(self, path):
            self.path = path

        def get(self, *_):
            return self.path

    class Session:
        def __init__(self, path, master):
            self.conf, self._jvm, self._jsc = Conf(path), spark._jvm, spark._jsc
            self.sparkContext = type("C", (), {"master": master, "getConf": lambda s: Conf(path)})()

    assert shared.shared_dir(Session("hdfs://n/x/", "yarn")) == "hdfs://n/x"
    assert shared.shared_dir(Session("/user/x", "yarn")) == "file:///user/x"
    for master in ("yarn", "local-cluster[2,1,900]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(None, master))

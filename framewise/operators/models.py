"""Pluggable detectors: batched model calls over pictures, and pixel work in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FRAME_BATCH = 4


def padded_batch(pictures: list, size: int = FRAME_BATCH) -> list:
    """Filled up with the last picture, so that a compiled model always sees one size."""
    return pictures + pictures[-1:] * (-len(pictures) % size) if pictures else pictures


def detected(frames: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], list[list[tuple]]]], schema: str = "ord int, cls int, x1 int, y1 int, x2 int, y2 int, conf double", size: int = FRAME_BATCH) -> DataFrame:
    """video, frame and each box that a model finds. `load` runs once a task; the model gets `size` pictures at a time."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = load()
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), size):
                some = rows[k : k + size]
                pictures = [np.frombuffer(r["content"], np.uint8).reshape(r["height"], r["width"], 3) for r in some]
                found = model(padded_batch(pictures, size))[: len(some)]
                out = [{"video": r["video"], "frame": r["frame"], **dict(zip(names, (n, *box), strict=True))} for r, boxes in zip(some, found, strict=True) for n, box in enumerate(boxes)]
                if out:
                    table = pa.Table.from_pylist(out)
                    yield from table.cast(pa.schema([table.schema.field(n).with_type(KINDS[k]) for n, k in (f.split() for f in ("video string, frame int, " + schema).split(", "))])).to_batches()

    import pyarrow as pa

    KINDS = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "long": pa.int64()}
    return frames.select("video", "frame", "content", "height", "width").mapInArrow(run, "video string, frame int, " + schema)


def batch_pictures(spark: SparkSession, size: int = 64) -> None:
    """Pictures in one Arrow batch: what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))


def is_dead(picture: np.ndarray) -> bool:
    return float(picture.std()) < 5


def area_shares(old: int, new: int) -> np.ndarray:
    """A (new, old) matrix: how much of each old pixel a new one averages."""
    edges = np.arange(new + 1) * old / new
    low, high = np.arange(old), np.arange(1, old + 1)
    share = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return share.clip(0) / (old / new)


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at another size; each new pixel is the mean of the area it covers."""
    flat = picture.astype(np.float64)
    out = np.tensordot(area_shares(picture.shape[0], height), flat, (1, 0))
    out = np.moveaxis(np.tensordot(area_shares(picture.shape[1], width), out, (1, 1)), 0, 1)
    return out.round().clip(0, 255).astype(np.uint8)


def grey(picture: np.ndarray) -> np.ndarray:
    """Luma of a B, G, R picture."""
    return (picture[..., :3] @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)


def plate_sharpness(picture: np.ndarray, rect: tuple[int, int, int, int]) -> float:
    """`laplacian_variance` of a plate's part of the frame at 96 x 32, so that a limit means the same for all sizes; 0 for parts under 8 x 4."""
    x1, y1, x2, y2 = max(0, rect[0]), max(0, rect[1]), min(picture.shape[1], rect[2]), min(picture.shape[0], rect[3])
    return laplacian_variance(grey(resized(picture[y1:y2, x1:x2], 96, 32))) if x2 - x1 >= 8 and y2 - y1 >= 4 else 0.0


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges mirrored; 0 for pictures under 8 x 4."""
    if gray.shape[1] < 8 or gray.shape[0] < 4:
        return 0.0
    p = np.pad(gray.astype(np.float64), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def gaussian(size: int, sigma: float | None = None) -> np.ndarray:
    """Weights of a Gaussian; without a sigma, one that suits the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def softened(picture: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    """Separable Gaussian blur, edges mirrored, in floating point."""
    k, pad = gaussian(size, sigma), size // 2
    mode = "reflect" if min(picture.shape[:2]) > pad else "edge"
    out = picture.astype(np.float64)
    for axis in (0, 1):
        widths = [(pad, pad) if a == axis else (0, 0) for a in range(out.ndim)]
        p = np.pad(out, widths, mode=mode)
        out = sum(w * np.take(p, range(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return out


def blurred(picture: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    return softened(picture, size, sigma).round().clip(0, 255).astype(np.uint8)


def sharpened(picture: np.ndarray, amount: float = 1.5, sigma: float = 1.0) -> np.ndarray:
    """The picture with `amount` of what a blur of this sigma takes away added."""
    soft = blurred(picture, round(sigma * 6 + 1) | 1, sigma).astype(np.float64)
    return (picture + amount * (picture - soft)).round().clip(0, 255).astype(np.uint8)


def inside_quad(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """Which pixels of a frame lie in a convex quad, edges included."""
    y, x = np.mgrid[:height, :width]
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, np.roll(quad, -1, 0), strict=True)]
    return np.all([s >= 0 for s in sides], 0) | np.all([s <= 0 for s in sides], 0)


def blur_masked(picture: np.ndarray, rect: tuple[int, int, int, int], kernel: int, mask: np.ndarray) -> None:
    """Blur a rectangle's pixels in place, as far as the mask (0 to 1, of the rectangle's size) says."""
    x1, y1, x2, y2 = rect
    part = picture[y1:y2, x1:x2]
    m = mask[..., None] if part.ndim == 3 else mask
    part[:] = (blurred(part, kernel) * m + part * (1.0 - m)).astype(np.uint8)


def blur_shape(picture: np.ndarray, rect: tuple[int, int, int, int], kernel: int, shape: str = "feathered", feather: int = 14, quad: np.ndarray | None = None) -> np.ndarray:
    """A copy with a rectangle blurred: with soft edges (feathered), in its inscribed circle, or in a quad of frame points (rotated)."""
    out = picture.copy()
    x1, y1, x2, y2 = max(0, rect[0]), max(0, rect[1]), min(picture.shape[1], rect[2]), min(picture.shape[0], rect[3])
    w, h = x2 - x1, y2 - y1
    if w < 2 or h < 2:
        return out
    if shape == "feathered":
        mask = np.zeros((h, w))
        mask[min(feather, h // 2) : max(h - feather, h // 2) + 1, min(feather, w // 2) : max(w - feather, w // 2) + 1] = 1.0
        mask = softened(mask, round(feather * 6 + 1) | 1, float(feather)).clip(0, 1)
    elif shape == "circle":
        y, x = np.mgrid[:h, :w]
        radius = max(1, round(0.5 * min(rect[2] - rect[0], rect[3] - rect[1])))
        mask = ((x - round(0.5 * (rect[0] + rect[2]) - x1)) ** 2 + (y - round(0.5 * (rect[1] + rect[3]) - y1)) ** 2 <= radius**2).astype(float)
    else:
        mask = inside_quad(np.asarray(quad) - (x1, y1), w, h).astype(float)
    blur_masked(out, (x1, y1, x2, y2), kernel, mask)
    return out


def rescaled(boxes: list[tuple], scale: float, width: int, height: int) -> list[tuple]:
    """Boxes (cls, x1, y1, x2, y2, conf) that a model found on a frame shrunk by `scale`, on the whole frame."""
    back = lambda v, most: max(0, min(most, round(v / scale)))
    return [(c, back(x1, width), back(y1, height), back(x2, width), back(y2, height), conf) for c, x1, y1, x2, y2, conf in boxes]


def on_shrunk(model: Callable[[list[np.ndarray]], list[list[tuple]]], most: int = 1280) -> Callable[[list[np.ndarray]], list[list[tuple]]]:
    """A vehicle model that sees frames of at most this width, and whose boxes come back at full size."""

    def run(pictures: list[np.ndarray]) -> list[list[tuple]]:
        scales = [min(1.0, most / p.shape[1]) for p in pictures]
        small = [p if s == 1.0 else resized(p, round(p.shape[1] * s), round(p.shape[0] * s)) for p, s in zip(pictures, scales, strict=True)]
        return [rescaled(boxes, s, p.shape[1], p.shape[0]) for boxes, s, p in zip(model(small), scales, pictures, strict=True)]

    return run


def redact(picture: np.ndarray, rects: list[tuple[int, int, int, int, int]], mode: str = "blur", color=(0, 0, 0), image: np.ndarray | None = None) -> np.ndarray:
    """A copy with rectangles (x1, y1, x2, y2, kernel) of a plan blurred, coloured, or covered by an image; without an image, blurred."""
    out = picture.copy()
    for x1, y1, x2, y2, kernel in rects:
        part = out[y1:y2, x1:x2]
        if not part.size:
            continue
        if mode == "color":
            part[:] = color
        elif mode == "image" and image is not None:
            rows = np.arange(y2 - y1) * image.shape[0] // max(1, y2 - y1)
            cols = np.arange(x2 - x1) * image.shape[1] // max(1, x2 - x1)
            cover = image[rows][:, cols].astype(np.float64)
            alpha = cover[..., 3:] / 255.0 if cover.shape[-1] == 4 else 1.0
            part[:] = (cover[..., :3] * alpha + part * (1 - alpha)).round().astype(np.uint8)
        else:
            part[:] = blurred(part, kernel)
    return out


def placed_on_square(picture: np.ndarray, size: int, most: float | None = None, fill: int = 114) -> tuple[np.ndarray, float, float, float]:
    """The picture on a square, nearest neighbour: square, scale, padding."""
    h, w = picture.shape[:2]
    scale = min(size / w, size / h, most or float("inf"))
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    px, py = (size - nw) / 2.0, (size - nh) / 2.0
    out = np.full((size, size, *picture.shape[2:]), fill, picture.dtype)
    out[round(py) : round(py) + nh, round(px) : round(px) + nw] = picture[np.arange(nh) * h // nh][:, np.arange(nw) * w // nw]
    return out, scale, px, py

"""Tables, classes and parameters of the detection model.

Videos hold frames; a frame holds plates and vehicles in list order. List order
is part of the meaning (ties go to the first), so every table carries it: `ord`
for vehicles, `pord` for plates, `zord` for zones.
"""

from __future__ import annotations

from dataclasses import dataclass

# Class codes and names, filters, classes a detector confuses.
CAR, MOTO, BUS, TRUCK = 2, 3, 5, 7
CLASS_NAMES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
FILTERS = {"all": (2, 3, 5, 7), "motorbike": (3,), "car": (2,), "bus": (5,), "truck": (7,)}
CONFUSED = (2, 3, 7)
#: Header keys of a detection cache whose difference makes it useless. Fixed values, in the file format's order.
META_KEYS = (
    "input", "input_size", "start", "end", "width", "height",
    "vehicle_conf", "vehicle_filter", "plate_conf", "plate_conf_in_vehicle",
    "sahi_slice_size", "sahi_overlap", "detect_scale",
    "sharpen", "sharpen_amount", "sharpen_sigma", "vehicle_crop_scale",
    "moto_crop_scale", "moto_crop_bottom_frac", "moto_crop_side_pad_frac",
    "plate_crop_imgsz", "crop_clahe", "crop_clahe_clip", "crop_clahe_grid",
    "moto_close_conf", "plate_model", "vehicle_model",
)
CACHE_VERSION = 1

BOX = "x1 int, y1 int, x2 int, y2 int"
FRAMES = "video_id long, frame int"
VEHICLES = f"video_id long, frame int, ord int, cls int, {BOX}, conf double"
PLATES = f"video_id long, frame int, pord int, {BOX}, conf double, src string"
SELECTED = f"video_id long, frame int, dord int, {BOX}, conf double, src string, vx1 int, vy1 int, vx2 int, vy2 int, vcls int"
ZONES = f"video_id long, frame int, zord int, {BOX}, conf double, src string, track_id int"
VIDEO = "width int, height int, fps double, codec string, pix_fmt string, duration double"


@dataclass(frozen=True)
class Params:
    """Thresholds; the defaults are those of the reference configuration."""

    width: int = 1920
    height: int = 1080
    fps: float = 30.0
    moto_min_conf: float = 0.30
    conf_floor: float = 0.15
    min_plate_side: float = 12.0
    classes: tuple[int, ...] = (2, 3, 5, 7)
    max_gap: int = 30
    max_disp_px: float = 80.0
    max_disp_frac: float = 0.35
    min_vehicle_iou: float = 0.15
    max_area_ratio: float = 2.5
    max_class_flip: int = 10
    moto_min_h_frac: float = 0.08333
    size_enter: float = 1.15
    size_exit: float = 0.85
    blur_strength: int = 35
    blur_padding: int = 10
    max_box_frac: float = 0.25
    crop_size: int = 1280
    vehicle_crop_scale: float = 2.0
    moto_crop_scale: float = 2.0
    moto_crop_bottom: float = 0.28
    moto_crop_side: float = 0.05

    @property
    def min_moto_size(self) -> float:
        return self.moto_min_h_frac * float(self.height)


DEFAULTS = Params()

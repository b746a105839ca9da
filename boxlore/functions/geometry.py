"""Box arithmetic as native column expressions.

``Box`` always means top-left corner plus size in one frame; other encodings are spelled
out in the argument names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


class Corners(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box_of(prefix: str = "") -> Box:
    """Box from columns ``x, y, w, h``; ``prefix`` may be an alias like ``"p."``."""
    return Box(*(F.col(prefix + c) for c in "xywh"))


def from_array(bbox: str | Column) -> Box:
    arr = F.col(bbox) if isinstance(bbox, str) else bbox
    return Box(*(F.get(arr, F.lit(i)) for i in range(4)))


def named(box: Box) -> list[Column]:
    return [c.alias(n) for c, n in zip(box, "xywh")]


def as_array(box: Box) -> Column:
    return F.array(*box)


def overlaps(a: Box, b: Box) -> Column:
    """The interiors touch; four comparisons, no division."""
    return (a.x < b.x2) & (b.x < a.x2) & (a.y < b.y2) & (b.y < a.y2)


def intersection(a: Box, b: Box) -> Column:
    side_x = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x, b.x))
    side_y = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y, b.y))
    return side_x * side_y


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def iou_eps(a: Box, b: Box, eps: float = 1e-6) -> Column:
    """The suppression variant: no guard, a small constant in the denominator."""
    inter = intersection(a, b)
    return inter / (a.area + b.area - inter + F.lit(eps))


def corners_to_box(c: Corners) -> Box:
    return Box(c.x1, c.y1, c.x2 - c.x1, c.y2 - c.y1)


def box_to_corners(b: Box) -> Corners:
    return Corners(b.x, b.y, b.x2, b.y2)


def iou_mixed(a: Box, b: Corners) -> Column:
    return iou(a, corners_to_box(b))


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Corners:
    return Corners(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_yolo(b: Box, width: Column, height: Column) -> Box:
    """Pixels to centre and size, as shares of the image. Returned as (cx, cy, w, h)."""
    return Box((b.x + b.w / 2) / width, (b.y + b.h / 2) / height, b.w / width, b.h / height)


def to_yolo_tile(b: Box, tile: int) -> Box:
    side = F.lit(float(tile))
    return to_yolo(b, side, side)


class Letterbox(NamedTuple):
    scale: Column
    left: Column
    top: Column
    new_w: Column
    new_h: Column


def letterbox(width: Column, height: Column, size: int) -> Letterbox:
    """Scale and padding that fit an image into a square; whole numbers round half to even."""
    scale = F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)
    new_w = F.bround(width * scale).cast("int")
    new_h = F.bround(height * scale).cast("int")
    left = F.bround((F.lit(size) - new_w) / 2 - F.lit(0.1)).cast("int")
    top = F.bround((F.lit(size) - new_h) / 2 - F.lit(0.1)).cast("int")
    return Letterbox(scale, left, top, new_w, new_h)


def unletterbox(c: Corners, lb: Letterbox) -> Corners:
    return Corners(
        (c.x1 - lb.left) / lb.scale, (c.y1 - lb.top) / lb.scale,
        (c.x2 - lb.left) / lb.scale, (c.y2 - lb.top) / lb.scale,
    )


def clamp(v: Column, low: float, high: Column | float) -> Column:
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(v, F.lit(low)), high)


def clip_corners_norm(c: Corners, width: Column, height: Column) -> Corners:
    return Corners(
        clamp(c.x1 / width, 0.0, 1.0), clamp(c.y1 / height, 0.0, 1.0),
        clamp(c.x2 / width, 0.0, 1.0), clamp(c.y2 / height, 0.0, 1.0),
    )


def clip_box(b: Box, width: Column, height: Column) -> Box:
    """Clamp the corner first, then the size to what is left.

    A negative corner moves to zero without shrinking the size, so the right edge shifts;
    that is what the result is defined to be.
    """
    x = clamp(b.x, 0.0, width)
    y = clamp(b.y, 0.0, height)
    return Box(x, y, F.least(b.w, width - x), F.least(b.h, height - y))


def flip_corners(c: Corners, width: Column | float = 1.0) -> Corners:
    width = width if isinstance(width, Column) else F.lit(width)
    return Corners(width - c.x2, c.y1, width - c.x1, c.y2)


def flip_box(b: Box, width: Column) -> Box:
    return Box(width - b.x - b.w, b.y, b.w, b.h)


def denormalise(c: Corners, width: Column, height: Column) -> Box:
    return Box(c.x1 * width, c.y1 * height, (c.x2 - c.x1) * width, (c.y2 - c.y1) * height)


def tile_to_image(b: Box, tile_x: Column, tile_y: Column) -> Box:
    return Box(b.x + tile_x, b.y + tile_y, b.w, b.h)


def clip_to_tile(
    b: Box, tile_x: Column, tile_y: Column, tile: int, min_share: float = 0.5, min_side: float = 10
) -> tuple[Box, Column]:
    """The part of a box inside a tile, in tile coordinates, and whether it counts."""
    x1, y1 = F.greatest(b.x, tile_x), F.greatest(b.y, tile_y)
    w = F.least(b.x2, tile_x + tile) - x1
    h = F.least(b.y2, tile_y + tile) - y1
    kept = (
        (b.area > 0) & (w > 0) & (h > 0)
        & (w >= min_side) & (h >= min_side)
        & F.when(b.area > 0, (w * h) / b.area >= min_share).otherwise(F.lit(False))
    )
    return Box(x1 - tile_x, y1 - tile_y, w, h), kept


def crop_rect(b: Box, width: Column, height: Column, pad: float = 0.0) -> Corners:
    """Whole-pixel crop rectangle, cut towards zero and clamped to the image."""
    px, py = b.w * F.lit(float(pad)), b.h * F.lit(float(pad))
    return Corners(
        F.greatest(F.lit(0), (b.x - px).cast("int")), F.greatest(F.lit(0), (b.y - py).cast("int")),
        F.least(width.cast("int"), (b.x2 + px).cast("int")), F.least(height.cast("int"), (b.y2 + py).cast("int")),
    )


def crop_usable(c: Corners, min_side: int = 1) -> Column:
    return (c.x2 - c.x1 >= min_side) & (c.y2 - c.y1 >= min_side)


def argmax_class(scores: Column) -> tuple[Column, Column]:
    """Best score of a class vector and its first position."""
    best = F.array_max(scores)
    return best, (F.array_position(scores, best) - 1).cast("int")


def softmax_if_logits(scores: Column) -> Column:
    """Turn raw scores into shares; vectors that already look like shares stay."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v)
    top = F.array_max(scores)
    powers = F.transform(scores, lambda v: F.exp(v - top))
    norm = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    looks_raw = (F.array_min(scores) < 0) | (total > 1.5)
    return F.when(looks_raw, F.transform(powers, lambda v: v / norm)).otherwise(scores)


def clamp_category(category: Column, n_classes: int, fallback: Column | int = 0) -> Column:
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when((category < 0) | (category >= n_classes), fallback).otherwise(category)


def finite(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return ok

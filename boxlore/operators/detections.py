"""Raw model rows to detections, and the filters around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.operators.ranking import cap_per_group

BEST_FIRST = ("score", "pred_id")


def decode_detections(raw: DataFrame, images: DataFrame, size: int, conf: float, *, flipped: bool = False, flip_before_clip: bool = True) -> DataFrame:
    """Rows ``cx, cy, w, h, class_scores`` in model space to normalised corners with class and score.

    The confidence filter comes before any coordinate work. ``flipped`` rows come from a mirrored
    image and are mirrored back, before or after they are clipped.
    """
    score, cls = G.argmax_class(F.col("class_scores"))
    rows = raw.withColumns({"score": score, "category_id": cls}).where(F.col("score") >= conf)
    rows = rows.join(images.select("image_id", "width", "height"), "image_id")
    w, h = F.col("width"), F.col("height")
    corners = G.centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    corners = G.unletterbox(corners, G.letterbox(w, h, size))
    if flipped and flip_before_clip:
        corners = G.flip_corners(corners, w)
    norm = G.clip_corners_norm(corners, w, h)
    if flipped and not flip_before_clip:
        norm = G.flip_corners(norm)
    out = rows.select(*[c for c in ("pred_id", "model_id", "image_id") if c in raw.columns], "category_id", "score",
                      *[c.alias(n) for c, n in zip(norm, ("x1", "y1", "x2", "y2"))])
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def decode_boxes(raw: DataFrame, images: DataFrame, size: int, conf: float, *, flipped: bool = False, flip_before_clip: bool = True) -> DataFrame:
    """The same rows to pixel boxes ``x, y, w, h``, clipped as boxes: first the corner, then the size."""
    score, cls = G.argmax_class(F.col("class_scores"))
    rows = raw.withColumns({"score": score, "category_id": cls}).where(F.col("score") >= conf)
    rows = rows.join(images.select("image_id", "width", "height"), "image_id")
    w, h = F.col("width"), F.col("height")
    c = G.unletterbox(G.centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), G.letterbox(w, h, size))
    box = G.Box(c.x1, c.y1, c.x2 - c.x1, c.y2 - c.y1)
    if flipped and flip_before_clip:
        box = G.flip_box(box, w)
    box = G.clip_box(box, w, h)
    if flipped and not flip_before_clip:
        box = G.flip_box(box, w)
    out = rows.select(*[n for n in ("pred_id", "model_id", "image_id") if n in raw.columns], "category_id", "score", *[v.alias(n) for v, n in zip(box, "xywh")])
    return out.where((F.col("w") > 0) & (F.col("h") > 0))


def sanitize(preds: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """Drop broken rows, clamp boxes, scores and classes."""
    b, score = G.box_of(), F.col("score")
    rows = preds.where(G.finite(*b, score)).join(images.select("image_id", "width", "height"), "image_id")
    x, y = F.greatest(F.lit(0.0), b.x), F.greatest(F.lit(0.0), b.y)
    box = G.Box(x, y, F.least(b.w, F.col("width") - x), F.least(b.h, F.col("height") - y))
    rest = [c for c in preds.columns if c not in ("x", "y", "w", "h", "score", "category_id")]
    return rows.select(
        *rest, *G.named(box), G.clamp(score, 0.0, 1.0).alias("score"), G.clamp_category(F.col("category_id"), n_classes).alias("category_id")
    ).where((F.col("w") > 0) & (F.col("h") > 0))


def positive_area(df: DataFrame) -> DataFrame:
    return df.where((F.col("w") > 0) & (F.col("h") > 0))


def split_filter(df: DataFrame, split: DataFrame, name: str = "val") -> DataFrame:
    return df.join(split.where(F.col("split") == name).select("image_id"), "image_id", "left_semi")


def cap_per_image(preds: DataFrame, cap: int = 500, *, drop_empty: str | None = None, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Best ``cap`` detections per image; empty boxes leave ``before`` or ``after`` the cap, or stay."""
    order = [F.col("score").desc(), F.col("pred_id").asc()]
    rows = positive_area(preds) if drop_empty == "before" else preds
    rows = cap_per_group(rows, list(keys), order, cap)
    return positive_area(rows) if drop_empty == "after" else rows


def selective(dets: DataFrame, det_t: float) -> DataFrame:
    """Detections unsure enough to be worth a second look; filter before any model call."""
    return dets.where(F.col("score") < det_t)


def confident(dets: DataFrame, conf: float) -> DataFrame:
    return dets.where(F.col("score") >= conf)


def min_side(boxes: DataFrame, side: float) -> DataFrame:
    """Boxes whose two sides reach ``side``."""
    return boxes.where((F.col("w") >= side) & (F.col("h") >= side))


def min_side_counts(boxes: DataFrame, side: float) -> DataFrame:
    """How many boxes :func:`min_side` keeps and skips, in one row."""
    ok = (F.col("w") >= side) & (F.col("h") >= side)
    return boxes.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def union_passes(original: DataFrame, flipped: DataFrame, images: DataFrame) -> DataFrame:
    """Both passes as rows of one table, the boxes of the second mirrored back."""
    width = images.select("image_id", "width")
    back = flipped.join(width, "image_id").withColumn("x", G.flip_box(G.box_of(), F.col("width")).x)
    return original.unionByName(back.select(*original.columns))


def image_universe(*tables: DataFrame) -> DataFrame:
    """Ids of all images that any of the tables mentions."""
    out = tables[0].select("image_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("image_id"))
    return out.distinct()

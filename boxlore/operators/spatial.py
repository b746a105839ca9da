"""Joins of boxes by overlap.

Boxes meet inside grid cells, never inside whole images. Every box lies on a grid of its own size:
cells of level k are ``4**k`` units wide, and a box is listed in the cells it touches (at most
four) of the level whose cells are two to eight times as wide as the box. Boxes of two levels meet
on the coarser one, where the smaller is a guest; guests never meet guests, so one box as large as
the image costs one listing per other box. The join is a plain equi-join on (keys, level, cell),
and a pair is reported only by the cell that holds the top-left corner of its intersection, so no
duplicate removal is needed. Coordinates may be fractions or millions, negative or far from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G

CELL = 1024  # the unit of the grids; its power of 4 that fits is used
FARTHEST = 1e15  # boxes beyond have no area in double precision


def level_of(w: Column, h: Column, cell: float = CELL) -> Column:
    """The level of a box's own grid, null without area."""
    return F.ceil(F.log2(F.greatest(w, h) * 2 / F.lit(float(cell))) / 2).cast("int")


def cell_index(v: Column, level: Column, cell: float = CELL) -> Column:
    return F.floor(v / (F.pow(F.lit(4.0), level) * F.lit(float(cell)))).cast("bigint")


def _levels(df: DataFrame, cell: float) -> Column:
    """The levels that occur, as one array: a handful, whatever the rows."""
    return df.select(level_of(F.col("w"), F.col("h"), cell).alias("l")).agg(F.collect_set("l").alias("l")).scalar()


def _in_cells(df: DataFrame, box: G.Box, cell: float) -> DataFrame:
    """Rows once per cell of the level ``_level`` that the box touches."""
    level = F.col("_level")
    span = lambda a, b: F.explode(F.sequence(cell_index(a, level, cell), cell_index(b, level, cell)))
    return df.withColumn("_cx", span(box.x, box.x2)).withColumn("_cy", span(box.y, box.y2))


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    cell: float = CELL,
    condition: Column | None = None,
) -> DataFrame:
    """All pairs with the same keys whose interiors touch.

    Both sides carry ``keys`` and ``x, y, w, h``. The result has the keys and every other
    column with prefix ``a_`` (left) or ``b_`` (right); ``condition`` may use those. Columns
    stay flat: packing a side into a struct made the join three times slower. ``cell`` only sets
    the unit of the grids.
    """
    box_a, box_b = G.box_of("a_"), G.box_of("b_")
    entry = lambda level, guests: F.struct(level.alias("level"), F.lit(guests).alias("guests"))

    def side(df: DataFrame, prefix: str, box: G.Box, others: Column, is_left: bool) -> DataFrame:
        flat = df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
        flat = flat.where((box.w > 0) & (box.h > 0) & (F.greatest(F.abs(box.x), F.abs(box.y), box.w, box.h) < FARTHEST))
        flat = flat.withColumn("_own", level_of(box.w, box.h, cell)).withColumn("_others", others)
        own = F.col("_own")
        # The left's guests meet the right's natives apart from all other pairs.
        at = [F.array(entry(own, False)), F.transform(F.filter("_others", lambda x: x > own), lambda x: entry(x, is_left))]
        if not is_left:
            at.append(F.when(F.exists("_others", lambda x: x < own), F.array(entry(own, True))).otherwise(F.array().cast("array<struct<level:int,guests:boolean>>")))
        flat = flat.withColumn("_at", F.explode(F.concat(*at))).withColumns({"_level": F.col("_at.level"), "_guests": F.col("_at.guests")})
        return _in_cells(flat.drop("_own", "_others", "_at"), box, cell)

    on = [*keys, "_guests", "_level", "_cx", "_cy"]
    pairs = side(left, "a_", box_a, _levels(right, cell), True).join(side(right, "b_", box_b, _levels(left, cell), False), on)
    level = F.col("_level")
    pairs = pairs.where(
        G.overlaps(box_a, box_b)
        & (cell_index(F.greatest(box_a.x, box_b.x), level, cell) == F.col("_cx"))
        & (cell_index(F.greatest(box_a.y, box_b.y), level, cell) == F.col("_cy"))
    )
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.drop("_guests", "_level", "_cx", "_cy")


def iou_join(
    preds: DataFrame, gts: DataFrame, min_iou: float, keys: Sequence[str] = ("image_id",), *, strict: bool = False, cell: float = CELL
) -> DataFrame:
    """Prediction and ground-truth pairs at or above an IoU (``strict``: above).

    Returns ``keys, pred_id, gt_id, score, iou`` and, where classes are known and no key, both
    classes. ``min_iou`` 0 means any overlap.
    """
    classes = [] if "category_id" in keys or "category_id" not in preds.columns or "category_id" not in gts.columns else ["category_id"]
    pairs = overlapping(
        preds.select(*keys, "pred_id", "score", *classes, *"xywh"),
        gts.select(*keys, "gt_id", *classes, *"xywh"),
        keys, cell=cell,
    ).select(
        *[F.col("a_category_id").alias("pred_class") for _ in classes], *[F.col("b_category_id").alias("gt_class") for _ in classes],
        *keys, F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), F.col("a_score").alias("score"),
        G.iou(G.box_of("a_"), G.box_of("b_")).alias("iou"),
    )
    if min_iou <= 0:
        return pairs.where(F.col("iou") > 0)
    return pairs.where(F.col("iou") > min_iou if strict else F.col("iou") >= min_iou)


def best_overlap(preds: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image_id",), cell: float = CELL) -> DataFrame:
    """For every ground-truth box the prediction that covers it best, not exclusively.

    Boxes nothing touches get class -1, IoU 0 and score 0. The best pair is one aggregate
    with map-side combine, so a box with very many partners costs no large group.
    """
    pairs = overlapping(
        preds.select(*keys, "pred_id", "score", "category_id", *"xywh"),
        gts.select(*keys, "gt_id", *"xywh"),
        keys, cell=cell,
    )
    iou = G.iou(G.box_of("a_"), G.box_of("b_"))
    best = (
        pairs.select(
            F.col("b_gt_id").alias("gt_id"), iou.alias("iou"),
            *[F.col("a_" + c).alias(c) for c in ("pred_id", "category_id", "score")],
        )
        .where(F.col("iou") > 0)
        .groupBy("gt_id")
        .agg(F.min(F.struct((-F.col("iou")).alias("k"), "pred_id", "category_id", "score")).alias("b"))
    )
    return gts.join(best, "gt_id", "left").select(
        *[c for c in gts.columns],
        F.col("b.pred_id").alias("pred_id"),
        F.coalesce(F.col("b.category_id"), F.lit(-1)).alias("pred_category"),
        F.coalesce(-F.col("b.k"), F.lit(0.0)).alias("iou"),
        F.coalesce(F.col("b.score"), F.lit(0.0)).alias("pred_score"),
    )


def label_disagreement(best: DataFrame, min_iou: float = 0.5, min_score: float = 0.4, strict: bool = False) -> DataFrame:
    """Rows of :func:`best_overlap` whose classes differ with enough support."""
    iou, score = F.col("iou"), F.col("pred_score")
    enough = (iou > min_iou) & (score > min_score) if strict else (iou >= min_iou) & (score >= min_score)
    return best.where(enough & (F.col("pred_category") != F.col("category_id")))


def rank_disagreements(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` disagreements the detector is surest of; Spark trims every partition first."""
    return rows.orderBy(F.col("pred_score").desc(), F.col("gt_id").asc()).limit(k)

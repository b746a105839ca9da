"""Average precision and the scores built on it.

Every function takes leading group keys, so one job can score many configurations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxlore.functions.scalars import bucket_label, bucket_ordinal
from boxlore.operators.matching import candidate_pairs, greedy_match, resolve_pairs, with_match
from boxlore.operators.ranking import rank_slices, slice_by
from boxlore.session import materialise

TAIL_BUCKETS = [(1, 1), (2, 3), (4, 5), (6, 10), (11, 25), (26, None)]
DETECTION_SHARE = 0.7
CLASSIFICATION_SHARE = 0.3


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("image_id").asc(), F.col("pred_id").asc()]


def pr_curve(flagged: DataFrame, gt_counts: DataFrame, keys: Sequence[str], flag: str = "is_tp") -> DataFrame:
    """Precision and recall after every prediction, in score order.

    ``flagged`` has ``keys, image_id, pred_id, score`` and the 0/1 column ``flag``; ``gt_counts``
    has ``keys, n_gt``. A frame from :func:`sliced` is used as it is stored.
    """
    keys = list(keys)
    cut = flagged if "_slice" in flagged.columns else sliced(flagged.select(*keys, "image_id", "pred_id", "score", flag), keys)
    running = rank_slices(cut, keys, _order(), {flag: "tp"})
    counted = running.join(gt_counts, keys) if keys else running.withColumn("n_gt", gt_counts.select("n_gt").scalar())
    return counted.select(
        *keys, "image_id", "pred_id", "score", F.col(flag).alias("is_tp"), "rank", "tp", (F.col("rank") - F.col("tp")).alias("fp"),
        (F.col("tp") / F.col("rank")).alias("precision"),
        F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(F.lit(0.0)).alias("recall"),
    )


def sliced(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Store predictions in score order once, for curves over several groupings."""
    return slice_by(flagged, [*[F.col(k) for k in keys], *_order()])


def thresholds_reached(recall: Column) -> Column:
    """How many of the thresholds ``i * 0.01`` for i = 0..100 a recall reaches.

    The product is compared, not i / 100: the two differ in the last bit for some i.
    """
    near = F.floor(recall * 100).cast("int")
    reach = lambda i: (i <= 100) & (i * F.lit(0.01) <= recall)
    return (
        F.when(reach(near + 1), near + 2).when(reach(near), near + 1).when(reach(near - 1), near).otherwise(F.greatest(near - 1, F.lit(0)))
    )


def _true_positives(curve: DataFrame) -> DataFrame:
    # The best precision at or beyond a recall is always at a true positive.
    return curve.where((F.col("is_tp") == 1) & (F.col("recall") > 0)).withColumn("_k", thresholds_reached(F.col("recall")))


def _ap_of_steps(steps: DataFrame, gt_counts: DataFrame, keys: list[str]) -> DataFrame:
    """AP from the best precision ``_p`` per number ``_k`` of thresholds reached: at most 101 rows per group."""
    from_here = W.partitionBy(*keys).orderBy(F.col("_k").desc())
    tail = from_here.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = steps.select(
        *keys,
        ((F.col("_k") - F.coalesce(F.lead("_k").over(from_here), F.lit(0))) * F.max("_p").over(tail)).alias("_part"),
    )
    ap = parts.groupBy(*keys).agg((F.sum("_part") / 101).alias("ap"))
    scored = gt_counts.join(ap, keys, "left") if keys else gt_counts.withColumn("ap", ap.scalar())
    return scored.withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def average_precision(flagged: DataFrame, gt_counts: DataFrame, keys: Sequence[str], flag: str = "is_tp") -> DataFrame:
    """101-point interpolated AP for every row of ``gt_counts``; 0 without predictions or truth.

    The curve shrinks to at most 101 numbers per group before the only window that looks ahead.
    """
    keys = list(keys)
    points = _true_positives(pr_curve(flagged, gt_counts, keys, flag))
    return _ap_of_steps(points.groupBy(*keys, "_k").agg(F.max("precision").alias("_p")), gt_counts, keys)


def average_precision_from(flagged: DataFrame, gt_counts: DataFrame, keys: Sequence[str], confs: Sequence[float], flag: str = "is_tp") -> DataFrame:
    """AP for every lower score bound in ``confs``, from one curve; adds the column ``conf``.

    A bound cuts the end off the score order, so ranks and sums of the remaining rows stay; only
    the maximum runs over fewer of them.
    """
    keys = list(keys)
    points = _true_positives(pr_curve(flagged, gt_counts, keys, flag))
    bounds = F.array(*[F.lit(float(c)) for c in confs])
    level = sum((F.when(F.col("score") >= c, 1).otherwise(0) for c in confs), F.lit(0))
    low = points.groupBy(*keys, "_k", level.alias("_level")).agg(F.max("precision").alias("_p"), F.max("score").alias("_s"))
    steps = low.withColumn("conf", F.explode(F.filter(bounds, lambda c: c <= F.col("_s"))))
    steps = steps.groupBy(*keys, "conf", "_k").agg(F.max("_p").alias("_p"))
    return _ap_of_steps(steps, gt_counts.withColumn("conf", F.explode(bounds)), [*keys, "conf"])


def truth_counts(gts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return gts.groupBy(*keys).agg(F.count("*").alias("n_gt"))


def flag_matches(preds: DataFrame, pairs: DataFrame, config: Sequence[str] = (), **options) -> DataFrame:
    """Predictions with ``tp_any`` (class ignored) and ``tp_class``, stored in score order."""
    config = list(config)
    cols = [*config, "image_id", "pred_id", "gt_id", "score", "iou"]
    anywhere = resolve_pairs(pairs.select(*cols), [*config, "image_id"], **options)
    in_class = resolve_pairs(
        pairs.where(F.col("pred_class") == F.col("gt_class")).select(*cols, F.col("pred_class").alias("category_id")),
        [*config, "image_id", "category_id"], **options)
    rows = preds.select(*config, "image_id", "category_id", "pred_id", "score")
    return sliced(with_match(with_match(rows, anywhere, "tp_any"), in_class.drop("category_id"), "tp_class"), config)


def detection_map(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, config: Sequence[str] = (), **options) -> DataFrame:
    """Class-agnostic AP over all images, one row (per configuration): ``n_gt, detection_map``."""
    config = list(config)
    matches = greedy_match(preds, gts, min_iou, [*config, "image_id"], **options)
    flagged = with_match(preds.select(*config, "image_id", "pred_id", "score"), matches)
    return average_precision(flagged, truth_counts(gts, config), config).withColumnRenamed("ap", "detection_map")


def per_class_ap(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, config: Sequence[str] = (), **options) -> DataFrame:
    """AP of every class that occurs in the ground truth: ``category_id, n_gt, ap``."""
    config = list(config)
    keys = [*config, "category_id"]
    matches = greedy_match(preds, gts, min_iou, [*config, "image_id", "category_id"], **options)
    flagged = with_match(preds.select(*keys, "image_id", "pred_id", "score"), matches)
    return average_precision(flagged, truth_counts(gts, keys), keys)


def mean_ap(per_class: DataFrame, config: Sequence[str] = ()) -> DataFrame:
    return per_class.groupBy(*config).agg(
        F.count("*").alias("n_classes"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("classification_map"))


def classification_map(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, config: Sequence[str] = (), **options) -> DataFrame:
    return mean_ap(per_class_ap(preds, gts, min_iou, config, **options), config)


def hybrid_of(detection: Column, classification: Column) -> Column:
    return detection * DETECTION_SHARE + classification * CLASSIFICATION_SHARE


def hybrid_score(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, config: Sequence[str] = (), **options) -> DataFrame:
    """Both maps and their blend. One overlap join and one stored score order serve both.

    The inputs are evaluated once and stored; everything else reads what was stored.
    """
    config = list(config)
    preds = materialise(preds.select(*config, "image_id", "category_id", "pred_id", "score", *"xywh"))
    gts = materialise(gts.select(*config, "image_id", "category_id", "gt_id", *"xywh"))
    pairs = candidate_pairs(preds, gts, min_iou, [*config, "image_id"])
    return hybrid_of_flags(flag_matches(preds, pairs, config, **options), gts, config)


def hybrid_of_flags(flagged: DataFrame, gts: DataFrame, config: Sequence[str] = ()) -> DataFrame:
    config, by_class = list(config), [*config, "category_id"]
    det = average_precision(flagged, truth_counts(gts, config), config, "tp_any").withColumnRenamed("ap", "detection_map")
    cls = mean_ap(average_precision(flagged, truth_counts(gts, by_class), by_class, "tp_class"), config)
    return _blend(det, cls, config)


def _blend(det: DataFrame, cls: DataFrame, config: list[str]) -> DataFrame:
    det, cls = det.select(*config, "detection_map"), cls.select(*config, "classification_map")
    both = det.join(cls, config) if config else det.withColumn("classification_map", cls.scalar())
    return both.withColumn("hybrid", hybrid_of(F.col("detection_map"), F.col("classification_map")))


def tail_buckets(per_class: DataFrame) -> DataFrame:
    n = F.col("n_gt")
    return per_class.groupBy(bucket_ordinal(n, TAIL_BUCKETS).alias("ordinal"), bucket_label(n, TAIL_BUCKETS).alias("bucket")).agg(
        F.count("*").alias("n_classes"), F.avg("ap").alias("mean_ap"), F.avg("n_gt").alias("mean_gt"))


def worst_classes(per_class: DataFrame, k: int) -> DataFrame:
    return per_class.orderBy(F.col("ap").asc(), F.col("n_gt").asc(), F.col("category_id").asc()).limit(k)


def best_classes(per_class: DataFrame, k: int) -> DataFrame:
    return per_class.orderBy(F.col("ap").desc(), F.col("n_gt").asc(), F.col("category_id").asc()).limit(k)

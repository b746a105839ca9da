"""Parameter sweeps as one plan instead of a loop of runs.

A sweep lists the distinct outcomes of every detection, each with the set of settings that choose
it (:mod:`boxlore.operators.settings`), and matches and scores all settings together. Tables grow
with outcomes; detections and truth are never multiplied by settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.operators import fusion
from boxlore.operators import metrics as M
from boxlore.operators import settings as S
from boxlore.operators.spatial import iou_join
from boxlore.session import materialise, owned, owner


def _met(boxes: DataFrame, gts: DataFrame, min_iou: float, box: str) -> DataFrame:
    """Pairs of boxes and truth, found once for all settings."""
    found = iou_join(boxes.select("image_id", F.col(box).alias("pred_id"), "score", "category_id", *"xywh"), gts, min_iou)
    return materialise(found.select("image_id", F.col("pred_id").alias("_box"), "gt_id", "gt_class", "iou"))


def _nth(values: Sequence[float], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i + 1).cast("int"))


def threshold_sweep(preds: DataFrame, gts: DataFrame, confs: Sequence[float], nms_ious: Sequence[float], min_iou: float = 0.5, **limits) -> DataFrame:
    """Scores for every score bound and suppression threshold: ``conf, nms_iou, maps, hybrid, n_preds``."""
    n = len(confs) * len(nms_ious)
    base = preds.where(F.col("score") >= min(confs)).select("image_id", "category_id", "pred_id", "score", *"xywh")
    kept = S.suppress_settings(base, nms_ious, **limits).where("_s <> 0")
    i = lambda k: F.floor(k / len(nms_ious)).cast("int")
    bits = S.bits_moved(F.col("_s"), len(nms_ious), [(F.col("score") >= float(c), at * len(nms_ious)) for at, c in enumerate(confs)], n)
    outcomes = S.numbered(kept.select("image_id", "category_id", "pred_id", "score", *"xywh", F.col("pred_id").alias("_box"), *[x.alias(b) for x, b in zip(bits, S.words(n), strict=True)]))
    scores = S.score_settings(outcomes, _met(outcomes, gts, min_iou, "pred_id"), gts, n)
    k = F.col("config_id")
    return scores.select(_nth(confs, i(k)).alias("conf"), _nth(nms_ious, k % len(nms_ious)).alias("nms_iou"), "detection_map", "classification_map", "hybrid", "n_preds")


def wbf_sweep(
    dets: DataFrame, gts: DataFrame, confs: Sequence[float], ious: Sequence[float], weights: Sequence[Sequence[float]], caps: Sequence[int], min_iou: float = 0.5, **limits
) -> DataFrame:
    """Scores for every score bound, fusion threshold, weighting and cap per image."""
    n = len(confs) * len(ious) * len(weights)
    fused = S.numbered(S.cap_settings(S.fuse_settings(dets, confs, ious, weights, **limits), n, caps)).withColumn("_box", F.col("_o"))
    scores = S.score_settings(fused, _met(fused, gts, min_iou, "_box"), gts, n * len(caps))
    part = lambda after, size: F.floor(F.col("config_id") / after).cast("int") % size
    w = part(len(caps), len(weights))
    return scores.select(
        _nth(confs, part(len(caps) * len(weights) * len(ious), len(confs))).alias("conf"), _nth(ious, part(len(caps) * len(weights), len(ious))).alias("wbf_iou"),
        F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in weights]), w + 1).alias("weights"),
        F.element_at(F.array(*[F.lit(int(c)) for c in caps]), part(1, len(caps)) + 1).alias("max_preds"),
        "hybrid", "detection_map", "classification_map", "n_preds")


def policy_grid(cls_ts: Sequence[float], det_ts: Sequence[float]) -> list[tuple[str, float, float]]:
    grid = [("A", 0.0, 0.7)]
    grid += [(p, c, 0.7) for p in "BC" for c in cls_ts]
    return grid + [(p, c, d) for p in "DE" for c in cls_ts for d in det_ts]


def _policy_outcomes(boxes: DataFrame, grid: Sequence[tuple[str, float, float]]) -> DataFrame:
    """One row per detection and distinct outcome under :func:`fusion.fuse_class`, with the settings that choose it."""
    n, b = len(grid), S.words(len(grid))
    at = lambda policies, i, value: [k for k, row in enumerate(grid) if row[0] in policies and row[i] == value]
    bounds = lambda policies, i: sorted({row[i] for row in grid if row[0] in policies})
    sure = lambda policies: S.bits_of(n, [(F.col("cls_conf") >= float(t), at(policies, 1, t)) for t in bounds(policies, 1)])
    weak = S.bits_of(n, [(F.col("score") < float(t), at("DE", 2, t)) for t in bounds("DE", 2)])
    always = [F.lit(w).cast("bigint") for w in S.bits_at([k for k, row in enumerate(grid) if row[0] == "A"], n=n)]
    every = [F.lit(w).cast("bigint") for w in S.bits_at(range(n), n=n)]
    rows = boxes.withColumns({
        **{f"_m{c}": x for c, x in zip(b, sure("C"), strict=True)},  # the product of both scores
        **{f"_k{c}": a.bitwiseOR(x).bitwiseOR(y.bitwiseAND(w)) for c, a, x, y, w in zip(b, always, sure("B"), sure("DE"), weak, strict=True)},
        "_product": F.col("score") * F.col("cls_conf"),
    })
    one_class, one_score = F.col("cls").eqNullSafe(F.col("category_id")), F.col("_product").eqNullSafe(F.col("score"))
    none = F.lit(0).cast("bigint")
    own, cls, product = [], [], []
    for c, e in zip(b, every, strict=True):
        m, k = F.col(f"_m{c}"), F.col(f"_k{c}")
        both = k.bitwiseOR(F.when(one_score, m).otherwise(none))
        own.append(e.bitwiseAND(F.bitwise_not(m.bitwiseOR(k))).bitwiseOR(F.when(one_class, both).otherwise(none)).alias(c))
        cls.append(F.when(one_class, none).otherwise(both).alias(c))
        product.append(F.when(one_score, none).otherwise(m).alias(c))
    row = lambda category, score, bits: F.struct(F.col(category).alias("category_id"), F.col(score).alias("score"), *bits)
    out = rows.select("image_id", "pred_id", F.col("pred_id").alias("_box"), F.inline(F.array(row("category_id", "score", own), row("cls", "score", cls), row("cls", "_product", product))))
    return out.where(S.any_of(b))


def policy_sweep(dets: DataFrame, gts: DataFrame, cls_ts: Sequence[float], det_ts: Sequence[float], min_iou: float = 0.5) -> DataFrame:
    """Scores of every policy and threshold pair with the gain over the detector alone.

    ``dets`` carries ``cls, cls_conf``. A detection has at most three outcomes: its own class, the
    classifier's, and the classifier's with the product of both scores.
    """
    grid = [("none", 0.0, 0.0), *policy_grid(cls_ts, det_ts)]
    n = len(grid)
    table = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(float(c)).alias("cls_t"), F.lit(float(d)).alias("det_t")) for p, c, d in grid])

    boxes = materialise(dets.select("image_id", "category_id", "pred_id", "score", "cls", "cls_conf", *"xywh"))
    found = S.numbered(_policy_outcomes(boxes, grid))
    scores = materialise(S.score_settings(found, _met(boxes, gts, min_iou, "pred_id"), gts, n))
    base = scores.where(F.col("config_id") == 0).select("hybrid").scalar()
    row = F.element_at(table, F.col("config_id") + 1)
    return scores.select(
        row["policy"].alias("policy"), row["cls_t"].alias("cls_t"), row["det_t"].alias("det_t"),
        "detection_map", "classification_map", "hybrid", (F.col("hybrid") - base).alias("delta"))


def best_policy(sweep: DataFrame) -> DataFrame:
    """The best configuration that beats the detector strictly; no row if none does."""
    better = sweep.where((F.col("policy") != "none") & (F.col("delta") > 0))
    return better.orderBy(F.col("hybrid").desc(), F.col("policy").asc(), F.col("cls_t").asc(), F.col("det_t").asc()).limit(1)


def tta_compare(dets: DataFrame, gts: DataFrame, configs: Sequence[tuple[str, int]], nms_iou: float = 0.5, wbf_iou: float = 0.55, min_iou: float = 0.5) -> DataFrame:
    """Scores of several ways to fuse passes, with the gain over the first. ``configs``: method and passes.

    A box that several ways return is one row with the scores they give it. Detections are stored
    in buckets of whole images, where every way finds its groups together, unless some image is
    very large.
    """
    n, out, own, buckets = len(configs), None, owner(dets.sparkSession), None
    with owned(dets.sparkSession) as short:
        dets = materialise(dets)
        if S.hot_groups(dets, ["image_id"], S.HOT_FUSION) is None:
            buckets = ("image_id", max(int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dets.count() // S.ROWS)))
            loose, dets = dets, short.keep(dets.repartition(buckets[1], "image_id"), buckets)
            short.discard(loose)
        for i, (method, passes) in enumerate(configs):
            part = fusion.dispatch(dets.where(F.col("pass_id") < passes), method, passes, nms_iou, wbf_iou, stored=True, buckets=buckets)
            part = part.select("*", *[F.lit(1 << i % 64 if k == i // 64 else 0).cast("bigint").alias(b) for k, b in enumerate(S.words(n))])
            out = part if out is None else out.unionByName(part)
        found = S.numbered(S.by_box(out, n), own).withColumn("_box", F.col("_o"))
    met = _met(found.withColumn("score", F.col("_scores")[0]["score"]), gts, min_iou, "_box")
    scores = materialise(S.score_settings(found, met, gts, n))
    base = scores.where(F.col("config_id") == 0).select("hybrid").scalar()
    names = F.array(*[F.lit(m) for m, _ in configs])
    return scores.select("config_id", names[F.col("config_id")].alias("method"), "detection_map", "classification_map", "hybrid", (F.col("hybrid") - base).alias("delta"))


def ensemble_eval(dets: DataFrame, gts: DataFrame, models: DataFrame, min_iou: float = 0.55, conf: float = 0.0, cap: int = 500) -> DataFrame:
    """Hybrid score of a weighted ensemble. ``models`` is a model table; it has a handful of rows."""
    from boxlore.operators.ranking import cap_per_group

    weights = [r.weight for r in models.orderBy("model_id").collect()]
    fused = fusion.wbf_weighted(dets, weights, min_iou, conf)
    capped = cap_per_group(fused, ["image_id"], [F.col("score").desc(), F.col("pred_id").asc()], cap)
    return M.hybrid_score(materialise(capped), gts)


def rank_experiments(rows: DataFrame, order: Sequence[Column], k: int, baseline: Column) -> DataFrame:
    """Best ``k`` experiments and their distance to the one ``baseline`` selects."""
    base = rows.where(baseline).agg(F.max("hybrid")).scalar()
    return rows.withColumn("delta", F.col("hybrid") - base).orderBy(F.col("hybrid").desc(), *order).limit(k)

"""Matching, suppression, fusion, metrics, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlore.operators import audit, detections, fusion, matching, metrics, ranking, suppression
from boxlore.operators.predict import ensemble_config
from boxlore.plans import sweeps
from suite import sqltext as Q
from suite.base import Tables as T
from suite.base import query

r6 = lambda c: F.round(c, 6)

# The grids that are swept.
CONFS, NMS_IOUS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.3, 0.4, 0.5, 0.6, 0.7]
CLS_TS, DET_TS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [0.5, 0.6, 0.7, 0.8, 0.9]


@query("mat_1_greedy_match", f"WITH RECURSIVE {Q.match('m', False)} SELECT image_id, pred_id, gt_id FROM m")
def _(s, d):
    t = T(s, d)
    return matching.greedy_match(t.predictions, t.gts, 0.5)


@query("mat_1_greedy_match_by_class", f"WITH RECURSIVE {Q.match('m', True)} SELECT image_id, category_id, pred_id, gt_id FROM m")
def _(s, d):
    t = T(s, d)
    return matching.greedy_match(t.predictions, t.gts, 0.5, ["image_id", "category_id"])


_STATUS = f"""{Q.match('m', False)},
  st AS (SELECT p.image_id AS image_id, p.pred_id AS pred_id, m.gt_id AS gt_id,
      CASE WHEN m.gt_id IS NULL THEN 'fp' WHEN g.category_id = p.category_id THEN 'tp' ELSE 'wrong_class' END AS status
    FROM fx_predictions p LEFT JOIN m ON m.pred_id = p.pred_id LEFT JOIN fx_annotations g ON g.ann_id = m.gt_id
    UNION ALL SELECT g.image_id, NULL, g.ann_id, 'missed' FROM fx_annotations g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.gt_id = g.ann_id))"""


@query("mat_2_match_status", f"WITH RECURSIVE {_STATUS} SELECT image_id, coalesce(pred_id, -1) AS pred_id, coalesce(gt_id, -1) AS gt_id, status FROM st")
def _(s, d):
    t = T(s, d)
    rows = matching.match_status(t.predictions, t.gts)
    return rows.select("image_id", F.coalesce("pred_id", F.lit(-1)).alias("pred_id"), F.coalesce("gt_id", F.lit(-1)).alias("gt_id"), "status")


@query("agg_6_match_totals", f"""WITH RECURSIVE {_STATUS} SELECT coalesce(image_id, -1) AS image_id, count_if(status = 'tp') AS tp, count_if(status = 'wrong_class') AS wrong_class,
   count_if(status = 'fp') AS fp, count_if(status = 'missed') AS missed, count(gt_id) AS n_gt FROM st GROUP BY ROLLUP (image_id)""")
def _(s, d):
    t = T(s, d)
    rows = audit.match_totals(matching.match_status(t.predictions, t.gts))
    return rows.withColumn("image_id", F.coalesce("image_id", F.lit(-1)))


_MATCHED = f"""{Q.match('m', False)},
  mp AS (SELECT m.image_id AS image_id, m.pred_id AS pred_id, m.gt_id AS gt_id, p.category_id AS det_class, g.category_id AS gt_class
    FROM m JOIN fx_predictions p ON p.pred_id = m.pred_id JOIN fx_annotations g ON g.ann_id = m.gt_id)"""


@query("mat_3_matched_pairs", f"WITH RECURSIVE {_MATCHED} SELECT * FROM mp")
def _(s, d):
    t = T(s, d)
    return matching.matched_pairs(t.predictions, t.gts).drop("score")


@query("join_19_attach_classifier", "SELECT p.pred_id AS pred_id, coalesce(c.cls, 0) AS cls, coalesce(c.cls_conf, 0.0) AS cls_conf FROM fx_predictions p LEFT JOIN fx_classifier c USING (pred_id)")
def _(s, d):
    t = T(s, d)
    return fusion.attach_classifier(t.predictions.select("pred_id"), t.classifier).select("pred_id", "cls", "cls_conf")


_ANSWERED = f"{_MATCHED}, ans AS (SELECT mp.*, coalesce(c.cls, 0) AS cls, c.cls2, c.cls3, c.cls IS NOT NULL AS has3 FROM mp LEFT JOIN fx_classifier c USING (pred_id))"


def _answered(t: T):
    return fusion.attach_classifier(matching.matched_pairs(t.predictions, t.gts), t.classifier)


@query("agg_16_crop_accuracy", f"""WITH RECURSIVE {_ANSWERED}, k AS (SELECT count(*) AS matched, count_if(det_class = gt_class) AS det_correct, count_if(cls = gt_class) AS cls_correct,
     count_if(has3 AND (cls = gt_class OR cls2 = gt_class OR cls3 = gt_class)) AS cls3_correct FROM ans)
   SELECT *, round(det_correct / matched, 6) AS det_accuracy, round(cls_correct / matched, 6) AS cls_accuracy, round(cls3_correct / matched, 6) AS cls3_accuracy FROM k""")
def _(s, d):
    out = audit.crop_accuracy(_answered(T(s, d)))
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith("accuracy")})


@query("agg_17_fixed_broke", f"""WITH RECURSIVE {_ANSWERED} SELECT count_if(det_class <> gt_class AND cls = gt_class) AS fixed, count_if(det_class = gt_class AND cls <> gt_class) AS broke,
   count_if(det_class <> gt_class AND cls = gt_class) - count_if(det_class = gt_class AND cls <> gt_class) AS net FROM ans""")
def _(s, d):
    return audit.fixed_broke(_answered(T(s, d)))


def _survivors(preds: str, t: float, keys: str = "image_id, category_id", cols: str = "pred_id, image_id, category_id, score") -> str:
    return f"WITH RECURSIVE {Q.nms('lost', preds, t, keys)} SELECT {cols} FROM {preds} WHERE pred_id NOT IN (SELECT pred_id FROM lost)"


@query("fus_1_nms", _survivors("fx_predictions", 0.5))
def _(s, d):
    return suppression.nms(T(s, d).predictions, 0.5).select("pred_id", "image_id", "category_id", "score")


@query("fus_2_concat_nms", _survivors("fx_predictions", 0.3))
def _(s, d):
    p = T(s, d).predictions
    passes = p.where("model_id = 0").unionByName(p.where("model_id = 1")).unionByName(p.where("model_id = 2"))
    return suppression.concat_nms(passes, 0.3).select("pred_id", "image_id", "category_id", "score")


@query("fus_3_merge_flip", f"""WITH RECURSIVE turned AS (SELECT * REPLACE (CASE WHEN image_id % 3 = 0 THEN image_id + 1 ELSE image_id END AS image_id) FROM fx_predictions WHERE model_id > 0),
   both_passes AS (SELECT * FROM fx_predictions WHERE model_id = 0 AND image_id IN (SELECT image_id FROM turned) UNION ALL SELECT * FROM turned),
   {Q.nms('lost', 'both_passes', 0.5)} SELECT pred_id, model_id FROM both_passes WHERE pred_id NOT IN (SELECT pred_id FROM lost)
   UNION ALL SELECT pred_id, model_id FROM fx_predictions WHERE model_id = 0 AND image_id NOT IN (SELECT image_id FROM turned)""")
def _(s, d):
    p = T(s, d).predictions
    # A third of the images has its flipped boxes on the next one, and none of its own.
    turned = p.where("model_id > 0").withColumn("image_id", F.expr("CASE WHEN image_id % 3 = 0 THEN image_id + 1 ELSE image_id END"))
    return suppression.merge_flip(p.where("model_id = 0"), turned, 0.5).select("pred_id", "model_id")


def _passes(t: T):
    return t.predictions.withColumnRenamed("model_id", "pass_id")


def _shape(df):
    return df.select("image_id", "category_id", "pred_id", *[F.round(c, 4).alias(c) for c in "xywh"], r6("score").alias("score"))


def _fused_sql(preds: str, t: float, best_fit: bool, weight: str, score: str, keep: str = "true", source: str = "model_id", head: str = "") -> str:
    return f"""WITH RECURSIVE {head}{Q.fuse('fz', preds, t, best_fit, weight, source)}
      SELECT image_id, category_id, pred_id, round(c.x, 4) AS x, round(c.y, 4) AS y, round(c.w, 4) AS w, round(c.h, 4) AS h, round({score}, 6) AS score FROM fz WHERE {keep}"""


_SEQ_SCORE = "c.s / c.n * least(len(list_distinct(c.src)), 3) / 3"


@query("fus_4_wbf_sequential", _fused_sql("fx_predictions", 0.55, False, "score", _SEQ_SCORE))
def _(s, d):
    return _shape(fusion.wbf_sequential(_passes(T(s, d)), 3, 0.55))


@query("fus_5_nms_then_wbf", _fused_sql("kept", 0.55, False, "score", _SEQ_SCORE,
    head=Q.nms("lost", "fx_predictions", 0.5, "image_id, category_id, model_id") + ", kept AS (SELECT * FROM fx_predictions WHERE pred_id NOT IN (SELECT pred_id FROM lost)), "))
def _(s, d):
    return _shape(fusion.nms_then_wbf(_passes(T(s, d)), 3, 0.5, 0.55))


@query("fus_6_wbf_weighted", _fused_sql("sure", 0.55, True, "score * [1.0::DOUBLE, 1.2::DOUBLE, 1.5::DOUBLE][model_id + 1]", "c.s / c.n * least(c.n, 3) / 3.7::DOUBLE",
    head="sure AS (SELECT * FROM fx_predictions WHERE score >= 0.05), "))
def _(s, d):
    return _shape(fusion.wbf_weighted(T(s, d).predictions, [1.0, 1.2, 1.5], 0.55, 0.05))


@query("fus_7_wbf_single", _fused_sql("fx_predictions", 0.55, True, "score", "c.s / c.n"))
def _(s, d):
    return _shape(fusion.wbf_weighted(T(s, d).predictions.withColumn("model_id", F.lit(0)), [1.0], 0.55))


def _tiled(t: T):
    """Predictions in the coordinates of the tile their id points to."""
    p = F.col("pred_id")
    rows = t.predictions.withColumns({"tile_x": (p % 3) * 64, "tile_y": (p % 2) * 64})
    return rows.withColumns({"x": F.col("x") - F.col("tile_x"), "y": F.col("y") - F.col("tile_y")})


@query("fus_8_tile_fusion_nms", f"""WITH RECURSIVE {Q.nms('lost', 'fx_predictions', 0.5)}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rn
   FROM fx_predictions WHERE pred_id NOT IN (SELECT pred_id FROM lost)) SELECT image_id, category_id, pred_id, x, y, w, h, score FROM k WHERE rn <= 60""")
def _(s, d):
    return fusion.tile_fusion(_tiled(T(s, d)), "nms", 0.5, 60)


@query("fus_8_tile_fusion_wbf", f"""WITH RECURSIVE {Q.fuse('fz', 'fx_predictions', 0.55, True, 'score', '0')}, r AS (SELECT image_id, category_id, pred_id, c, row_number() OVER (PARTITION BY image_id ORDER BY c.s / c.n DESC, pred_id) AS rn FROM fz)
   SELECT image_id, category_id, pred_id, round(c.x, 4) AS x, round(c.y, 4) AS y, round(c.w, 4) AS w, round(c.h, 4) AS h, round(c.s / c.n, 6) AS score FROM r WHERE rn <= 60""")
def _(s, d):
    return _shape(fusion.tile_fusion(_tiled(T(s, d)), "wbf", 0.55, 60))


_TAKE = {
    "A": "true", "B": "cls_conf >= 0.5", "C": "cls_conf >= 0.5",
    "D": "cls_conf >= 0.5 AND score < 0.7", "E": "cls_conf >= 0.5 AND score < 0.7",
}
_DC = "dc AS (SELECT p.pred_id, p.category_id, p.score, coalesce(c.cls, 0) AS cls, coalesce(c.cls_conf, 0.0) AS cls_conf FROM fx_predictions p LEFT JOIN fx_classifier c USING (pred_id))"
_FUSED = " UNION ALL ".join(
    f"SELECT '{p}' AS policy, pred_id, CASE WHEN {w} THEN cls ELSE category_id END AS final_class, round({'CASE WHEN cls_conf >= 0.5 THEN score * cls_conf ELSE score END' if p == 'C' else 'score'}, 8) AS final_score FROM dc"
    for p, w in _TAKE.items())


def _answers(t: T):
    return fusion.attach_classifier(t.predictions, t.classifier)


@query("fus_9_class_fusion", f"WITH {_DC} {_FUSED}")
def _(s, d):
    rows = _answers(T(s, d)).withColumn("policy", F.explode(F.array(*[F.lit(p) for p in _TAKE])))
    cls, score = fusion.fuse_class(F.col("policy"), 0.5, 0.7)
    return rows.select("policy", "pred_id", cls.alias("final_class"), F.round(score, 8).alias("final_score"))


@query("fus_10_class_fusion_runtime", f"""WITH {_DC}, f AS (SELECT pred_id, category_id, score, cls_conf, CASE WHEN cls_conf >= 0.5 THEN cls ELSE category_id END AS c FROM dc)
   SELECT pred_id, CASE WHEN c < 0 OR c >= 30 THEN category_id ELSE c END AS final_class, score AS final_score, round(score * cls_conf, 8) AS product_score FROM f""")
def _(s, d):
    cls, score = fusion.fuse_class_runtime("C", 0.5, 0.7, 30)
    _, product = fusion.fuse_class_runtime("B", 0.5, 0.7, 30, "det_x_cls")
    return _answers(T(s, d)).select("pred_id", cls.alias("final_class"), score.alias("final_score"), F.round(product, 8).alias("product_score"))


@query("fus_11_class_override", f"""WITH {_DC} SELECT pred_id, CASE WHEN cls_conf >= 0.6 AND cls >= 0 AND cls < 30 THEN cls ELSE category_id END AS final_class,
   CASE WHEN cls >= 0 AND cls < 30 THEN cls ELSE category_id END AS always_class FROM dc""")
def _(s, d):
    return _answers(T(s, d)).select("pred_id", fusion.override_class(0.6, 30).alias("final_class"), fusion.override_class(0.6, 30, True).alias("always_class"))


_PASS0 = "first_pass AS (SELECT * FROM fx_predictions WHERE model_id = 0)"


@query("fus_12_dispatch_concat_nms", _survivors("fx_predictions", 0.5, cols="image_id, category_id, pred_id, x, y, w, h, score"))
def _(s, d):
    return fusion.dispatch(_passes(T(s, d)), "concat_nms", 3, 0.5)


@query("fus_12_dispatch_first_pass", f"WITH RECURSIVE {_PASS0}, {Q.nms('lost', 'first_pass', 0.2)} SELECT image_id, category_id, pred_id, x, y, w, h, score FROM first_pass WHERE pred_id NOT IN (SELECT pred_id FROM lost)")
def _(s, d):
    return fusion.dispatch(_passes(T(s, d)), "something else", 3, 0.2)


# --- metrics -------------------------------------------------------------------------------

_FL_ANY = "f_any AS (SELECT p.image_id, p.pred_id, p.score, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_predictions p LEFT JOIN m USING (pred_id)), t_any AS (SELECT count(*) AS n_gt FROM fx_annotations)"
_FL_CLS = "f_cls AS (SELECT p.category_id, p.image_id, p.pred_id, p.score, CASE WHEN mc.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_predictions p LEFT JOIN mc USING (pred_id)), t_cls AS (SELECT category_id, count(*) AS n_gt FROM fx_annotations GROUP BY category_id)"
_DET = f"{Q.match('m', False)}, {_FL_ANY}, {Q.ap('da', 'f_any', 't_any')}"
_CLS = f"{Q.match('mc', True)}, {_FL_CLS}, {Q.ap('ca', 'f_cls', 't_cls', 'category_id')}"


@query("met_1_pr_curve", f"""WITH RECURSIVE {Q.match('mc', True)}, {_FL_CLS}
   SELECT category_id, pred_id, row_number() OVER w AS rank, CAST(sum(tp) OVER w AS BIGINT) AS tp, round(sum(tp) OVER w / row_number() OVER w, 9) AS precision, round(sum(tp) OVER w / n_gt, 9) AS recall
   FROM f_cls JOIN t_cls USING (category_id) WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    t = T(s, d)
    keys = ["image_id", "category_id"]
    matches = matching.greedy_match(t.predictions, t.gts, 0.5, keys)
    flagged = matching.with_match(t.predictions.select(*keys, "pred_id", "score"), matches)
    curve = metrics.pr_curve(flagged, metrics.truth_counts(t.gts, ["category_id"]), ["category_id"])
    return curve.select("category_id", "pred_id", "rank", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("met_2_average_precision", f"""WITH RECURSIVE {Q.match('m', False)}, f AS (SELECT p.model_id, p.image_id, p.pred_id, p.score, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_predictions p LEFT JOIN m USING (pred_id)),
   tr AS (SELECT model_id, count(DISTINCT ann_id) AS n_gt FROM fx_annotations CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS model_id) GROUP BY model_id),
   {Q.ap('a', 'f', 'tr', 'model_id')} SELECT model_id, n_gt, round(ap, 6) AS ap FROM a""")
def _(s, d):
    t = T(s, d)
    flagged = matching.with_match(t.predictions.select("model_id", "image_id", "pred_id", "score"), matching.greedy_match(t.predictions, t.gts, 0.5))
    truth = metrics.truth_counts(t.gts).withColumn("model_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return metrics.average_precision(flagged, truth, ["model_id"]).select("model_id", "n_gt", r6("ap").alias("ap"))


@query("met_3_detection_map", f"WITH RECURSIVE {_DET} SELECT n_gt, round(ap, 6) AS detection_map FROM da")
def _(s, d):
    t = T(s, d)
    return metrics.detection_map(t.predictions, t.gts).withColumn("detection_map", r6("detection_map"))


@query("met_4_classification_map", f"WITH RECURSIVE {_CLS} SELECT count(*) AS n_classes, round(avg(ap), 6) AS classification_map FROM ca")
def _(s, d):
    t = T(s, d)
    return metrics.classification_map(t.predictions, t.gts).withColumn("classification_map", r6("classification_map"))


@query("met_5_hybrid_score", f"""WITH RECURSIVE {_DET}, {_CLS}, k AS (SELECT (SELECT ap FROM da) AS dm, (SELECT avg(ap) FROM ca) AS cm)
   SELECT round(dm, 6) AS detection_map, round(cm, 6) AS classification_map, round(0.7 * dm + 0.3 * cm, 6) AS hybrid FROM k""")
def _(s, d):
    t = T(s, d)
    out = metrics.hybrid_score(t.predictions, t.gts)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("met_6_per_class_ap", f"WITH RECURSIVE {_CLS} SELECT category_id, n_gt, round(ap, 6) AS ap FROM ca")
def _(s, d):
    t = T(s, d)
    return metrics.per_class_ap(t.predictions, t.gts).withColumn("ap", r6("ap"))


_BUCKET = "CASE WHEN n_gt = 1 THEN '1' WHEN n_gt <= 3 THEN '2-3' WHEN n_gt <= 5 THEN '4-5' WHEN n_gt <= 10 THEN '6-10' WHEN n_gt <= 25 THEN '11-25' ELSE '26+' END"


def _sized(df, ann):
    """A fortieth of the boxes goes to classes of 1, 2, 4, 8, ... annotations, so every bucket has some."""
    small = F.length(F.bin(F.floor(ann / 40) + 1)) + 10000
    return df.withColumn("category_id", F.when(ann % 40 == 3, small).otherwise(F.col("category_id")).cast("int"))


def _sized_sql(ann: str) -> str:
    return f"CAST(CASE WHEN {ann} % 40 = 3 THEN strlen(bin({ann} // 40 + 1)) + 10000 ELSE category_id END AS INT) AS category_id"


_TAIL = f"""sized_annotations AS (SELECT * REPLACE ({_sized_sql('ann_id')}) FROM fx_annotations), sized_predictions AS (SELECT * REPLACE ({_sized_sql('(pred_id // 3)')}) FROM fx_predictions),
   {_CLS.replace('fx_annotations', 'sized_annotations').replace('fx_predictions', 'sized_predictions')}"""


@query("met_7_tail_buckets", f"WITH RECURSIVE {_TAIL} SELECT {_BUCKET} AS bucket, count(*) AS n_classes, round(avg(ap), 6) AS mean_ap, round(avg(n_gt), 6) AS mean_gt FROM ca GROUP BY 1")
def _(s, d):
    t = T(s, d)
    out = metrics.tail_buckets(metrics.per_class_ap(_sized(t.predictions, F.floor(F.col("pred_id") / 3)), _sized(t.gts, F.col("gt_id"))))
    return out.select("bucket", "n_classes", r6("mean_ap").alias("mean_ap"), r6("mean_gt").alias("mean_gt"))


for _name, _order, _fn in (("met_8_worst_classes", "ap, n_gt, category_id", metrics.worst_classes), ("met_8_best_classes", "ap DESC, n_gt, category_id", metrics.best_classes)):
    def _extreme(s, d, fn=_fn):
        t = T(s, d)
        # Ranked on rounded values, so that both engines see the same ties.
        return fn(metrics.per_class_ap(t.predictions, t.gts).withColumn("ap", r6("ap")), 20)
    query(_name, f"WITH RECURSIVE {_CLS} SELECT category_id, n_gt, round(ap, 6) AS ap FROM ca ORDER BY round(ap, 6) {'DESC' if 'DESC' in _order else ''}, n_gt, category_id LIMIT 20")(_extreme)


@query("set_3_image_universe", "SELECT image_id * 2 AS image_id FROM fx_predictions UNION SELECT image_id * 3 FROM fx_annotations")
def _(s, d):
    t = T(s, d)
    times = lambda df, k: df.withColumn("image_id", F.col("image_id") * k)
    return detections.image_universe(times(t.predictions, 2), times(t.annotations, 3))


@query("set_1_union_passes", "SELECT pred_id, x FROM fx_predictions WHERE model_id = 0 UNION ALL SELECT pred_id, 4000 - x - w FROM fx_predictions WHERE model_id = 1")
def _(s, d):
    t = T(s, d)
    p = t.predictions
    return detections.union_passes(p.where("model_id = 0"), p.where("model_id = 1"), t.images).select("pred_id", "x")


# --- sweeps --------------------------------------------------------------------------------

def _rounded(df, names=("detection_map", "classification_map", "hybrid", "delta")):
    return df.withColumns({c: r6(c) for c in names if c in df.columns})


def _score_sql(preds: str, configs: str, final: str, head: str, caps: bool = False) -> str:
    """Both maps of ``preds(cfg, image_id, category_id, pred_id, x, y, w, h, score)`` for every ``cfg`` of ``configs``, as ``k``."""
    return f"""WITH RECURSIVE {head}, {Q.match('m', False, preds=preds, config='cfg')}, {Q.match('mc', True, preds=preds, config='cfg')},
      fa AS (SELECT f.cfg, f.image_id, f.pred_id, f.score, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM {preds} f LEFT JOIN m USING (cfg, image_id, pred_id)),
      fc AS (SELECT f.cfg, f.category_id, f.image_id, f.pred_id, f.score, CASE WHEN mc.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM {preds} f LEFT JOIN mc USING (cfg, image_id, category_id, pred_id)),
      t_any AS (SELECT cfg, count(*) AS n_gt FROM fx_annotations CROSS JOIN {configs} GROUP BY cfg),
      t_cls AS (SELECT cfg, category_id, count(*) AS n_gt FROM fx_annotations CROSS JOIN {configs} GROUP BY cfg, category_id),
      {Q.ap('da', 'fa', 't_any', 'cfg')}, {Q.ap('ca', 'fc', 't_cls', 'cfg, category_id')},
      k AS (SELECT {configs}.*, (SELECT ap FROM da WHERE da.cfg = {configs}.cfg) AS dm, (SELECT avg(ap) FROM ca WHERE ca.cfg = {configs}.cfg) AS cm,
            (SELECT count(*) FROM {preds} z WHERE z.cfg = {configs}.cfg) AS n_preds FROM {configs}) {final}"""


_MAPS = "round(dm, 6) AS detection_map, round(cm, 6) AS classification_map, round(0.7 * dm + 0.3 * cm, 6) AS hybrid"
_DELTA = "round(0.7 * dm + 0.3 * cm - (SELECT 0.7 * dm + 0.3 * cm FROM k WHERE cfg = 0), 6) AS delta"


def _threshold_sql(confs, ious) -> str:
    """Every configuration suppressed, matched and scored on its own."""
    rows = " UNION ALL ".join(
        f"SELECT {i * len(ious) + j} AS cfg, CAST({c} AS DOUBLE) AS conf, CAST({t} AS DOUBLE) AS nms_iou" for i, c in enumerate(confs) for j, t in enumerate(ious))
    head = f"""cfgs AS ({rows}), base AS (SELECT c.cfg, c.nms_iou, p.* FROM fx_predictions p JOIN cfgs c ON p.score >= c.conf),
      {Q.nms('lost', 'base', 'a.nms_iou', 'cfg, image_id, category_id')}, kept AS (SELECT b.* FROM base b ANTI JOIN lost USING (cfg, image_id, category_id, pred_id))"""
    return _score_sql("kept", "cfgs", f"SELECT conf, nms_iou, {_MAPS}, n_preds FROM k", head)


@query("swp_1_threshold_sweep_small", _threshold_sql([0.1, 0.5], [0.3, 0.6]))
def _(s, d):
    t = T(s, d)
    return _rounded(sweeps.threshold_sweep(t.predictions, t.gts, [0.1, 0.5], [0.3, 0.6]))


@query("swp_1_threshold_sweep", _threshold_sql(CONFS, NMS_IOUS))
def _(s, d):
    t = T(s, d)
    return _rounded(sweeps.threshold_sweep(t.predictions, t.gts, CONFS, NMS_IOUS))


def _wbf_sql(confs, ious, weights, caps) -> str:
    parts, fused, rows, n = [], [], [], 0
    for c in confs:
        for t in ious:
            for w in weights:
                z = f"z{n}"
                parts += [f"{z}_src AS (SELECT * FROM fx_predictions WHERE score >= {c})",
                          Q.fuse(z, f"{z}_src", t, True, f"score * [{', '.join(f'{x}::DOUBLE' for x in w)}][model_id + 1]")]
                share = f"least(c.n, {len(w)}) / {float(sum(w))!r}::DOUBLE"
                parts.append(f"{z}_rank AS (SELECT image_id, category_id, pred_id, c.x AS x, c.y AS y, c.w AS w, c.h AS h, c.s / c.n * ({share}) AS score, row_number() OVER (PARTITION BY image_id ORDER BY c.s / c.n * ({share}) DESC, pred_id) AS rn FROM {z})")
                for cap in caps:
                    i = len(rows)
                    fused.append(f"SELECT {i} AS cfg, image_id, category_id, pred_id, x, y, w, h, score FROM {z}_rank WHERE rn <= {cap}")
                    rows.append(f"SELECT {i} AS cfg, CAST({c} AS DOUBLE) AS conf, CAST({t} AS DOUBLE) AS wbf_iou, '{'/'.join(str(x) for x in w)}' AS weights, {cap} AS max_preds")
                n += 1
    head = f"{', '.join(parts)}, fused AS ({' UNION ALL '.join(fused)}), cfgs AS ({' UNION ALL '.join(rows)})"
    return _score_sql("fused", "cfgs", f"SELECT conf, wbf_iou, weights, max_preds, {_MAPS}, n_preds FROM k", head)


def _wbf(t: T, *grid):
    out = sweeps.wbf_sweep(t.predictions, t.gts, *grid)
    return _rounded(out.withColumn("weights", F.concat_ws("/", F.transform("weights", lambda w: w.cast("string")))))


_SMALL_WBF = ([0.05, 0.2], [0.55], [[1.0, 1.5, 0.8]], [40, 300])


@query("swp_2_wbf_sweep_small", _wbf_sql(*_SMALL_WBF))
def _(s, d):
    return _wbf(T(s, d), *_SMALL_WBF)


_FULL_WBF = ([0.01, 0.05, 0.1, 0.2], [0.5, 0.55, 0.6], [[1.0, 1.0, 1.0], [1.0, 1.2, 0.8], [1.0, 1.5, 0.5]], [100, 300])


@query("swp_2_wbf_sweep", _wbf_sql(*_FULL_WBF))
def _(s, d):
    return _wbf(T(s, d), *_FULL_WBF)


def _policy_sql(cls_ts, det_ts, best: bool = False) -> str:
    grid = [("none", 0.0, 0.0), *sweeps.policy_grid(cls_ts, det_ts)]
    take = {"none": "false", "A": "true", "B": "cls_conf >= {c}", "C": "cls_conf >= {c}", "D": "cls_conf >= {c} AND score < {d}", "E": "cls_conf >= {c} AND score < {d}"}
    score = lambda p, c: f"CASE WHEN cls_conf >= {c} THEN score * cls_conf ELSE score END" if p == "C" else "score"
    parts = " UNION ALL ".join(
        f"SELECT {i} AS cfg, image_id, pred_id, x, y, w, h, CASE WHEN {take[p].format(c=c, d=d)} THEN cls ELSE category_id END AS category_id, {score(p, c)} AS score FROM dc"
        for i, (p, c, d) in enumerate(grid))
    rows = " UNION ALL ".join(f"SELECT {i} AS cfg, '{p}' AS policy, CAST({c} AS DOUBLE) AS cls_t, CAST({d} AS DOUBLE) AS det_t" for i, (p, c, d) in enumerate(grid))
    dc = "dc AS (SELECT p.*, coalesce(c.cls, 0) AS cls, coalesce(c.cls_conf, 0.0) AS cls_conf FROM fx_predictions p LEFT JOIN fx_classifier c USING (pred_id))"
    final = f"SELECT policy, cls_t, det_t, {_MAPS}, {_DELTA} FROM k"
    if best:
        final = f"SELECT * FROM ({final}) WHERE policy <> 'none' AND delta > 0 ORDER BY hybrid DESC, policy, cls_t, det_t LIMIT 1"
    return _score_sql("fused", "cfgs", final, f"{dc}, fused AS ({parts}), cfgs AS ({rows})")


def _policies(t: T, cls_ts, det_ts):
    return sweeps.policy_sweep(_answers(t), t.gts, cls_ts, det_ts)


@query("swp_3_policy_sweep_small", _policy_sql([0.4, 0.8], [0.6]))
def _(s, d):
    return _rounded(_policies(T(s, d), [0.4, 0.8], [0.6]))


@query("swp_3_policy_sweep", _policy_sql(CLS_TS, DET_TS))
def _(s, d):
    return _rounded(_policies(T(s, d), CLS_TS, DET_TS))


@query("swp_3_best_policy", _policy_sql(CLS_TS, DET_TS, best=True))
def _(s, d):
    return _rounded(sweeps.best_policy(_policies(T(s, d), CLS_TS, DET_TS)))


def _tta_sql() -> str:
    one = "one AS (SELECT * FROM fx_predictions WHERE model_id = 0), two AS (SELECT * FROM fx_predictions WHERE model_id < 2)"
    parts = [one, Q.nms("l0", "one", 0.5), Q.nms("l1", "two", 0.5), Q.fuse("z2", "two", 0.55, False, "score"),
             Q.nms("l3", "fx_predictions", 0.5, "image_id, category_id, model_id"), "kept3 AS (SELECT * FROM fx_predictions WHERE pred_id NOT IN (SELECT pred_id FROM l3))",
             Q.fuse("z3", "kept3", 0.55, False, "score")]
    cols = "image_id, category_id, pred_id, x, y, w, h, score"
    seq = lambda z, n: f"SELECT {{i}} AS cfg, image_id, category_id, pred_id, c.x, c.y, c.w, c.h, c.s / c.n * least(len(list_distinct(c.src)), {n}) / {n} AS score FROM {z}"
    fused = " UNION ALL ".join([
        f"SELECT 0 AS cfg, {cols} FROM one WHERE pred_id NOT IN (SELECT pred_id FROM l0)", f"SELECT 1 AS cfg, {cols} FROM two WHERE pred_id NOT IN (SELECT pred_id FROM l1)",
        seq("z2", 2).format(i=2), seq("z3", 3).format(i=3)])
    rows = " UNION ALL ".join(f"SELECT {i} AS cfg, '{m}' AS method" for i, m in enumerate(["nms", "concat_nms", "wbf", "nms_then_wbf"]))
    return _score_sql("fused", "cfgs", f"SELECT cfg AS config_id, method, {_MAPS}, {_DELTA} FROM k", f"{', '.join(parts)}, fused AS ({fused}), cfgs AS ({rows})")


@query("swp_4_tta_compare", _tta_sql())
def _(s, d):
    t = T(s, d)
    return _rounded(sweeps.tta_compare(_passes(t), t.gts, [("nms", 1), ("concat_nms", 2), ("wbf", 2), ("nms_then_wbf", 3)]))


_ENS = f"""sure AS (SELECT * FROM fx_predictions WHERE score >= 0.05), {Q.fuse('fz', 'sure', 0.55, True, 'score * [1.0::DOUBLE, 1.2::DOUBLE, 0.8::DOUBLE][model_id + 1]')},
   fused AS (SELECT 0 AS cfg, image_id, category_id, pred_id, c.x AS x, c.y AS y, c.w AS w, c.h AS h, c.s / c.n * least(c.n, 3) / 3.0::DOUBLE AS score FROM fz), cfgs AS (SELECT 0 AS cfg)"""


@query("swp_5_ensemble_eval", _score_sql("fused", "cfgs", f"SELECT {_MAPS} FROM k", _ENS))
def _(s, d):
    t = T(s, d)
    models = ensemble_config(s, {"models": [{"file": "a.onnx", "weight": 1.0}, {"file": "b.onnx", "weight": 1.2}, {"file": "c.onnx", "weight": 0.8}]})
    return _rounded(sweeps.ensemble_eval(t.predictions, t.gts, models, 0.55, 0.05))


@query("win_5_rank_experiments", """WITH e AS (SELECT o_orderkey AS run, ((o_orderkey * 7919) % 9973) / 1e4 AS det, ((o_orderkey * 104729) % 9967) / 1e4 AS cls FROM orders),
   h AS (SELECT run, round(det * 0.7 + cls * 0.3, 6) AS hybrid FROM e)
   SELECT run, hybrid, round(hybrid - (SELECT hybrid FROM h WHERE run = 0), 6) AS delta FROM h ORDER BY hybrid DESC, run LIMIT 10""")
def _(s, d):
    k = F.col("o_orderkey")
    hybrid = metrics.hybrid_of(((k * 7919) % 9973) / F.lit(1e4), ((k * 104729) % 9967) / F.lit(1e4))
    rows = T(s, d).orders.select(k.alias("run"), r6(hybrid).alias("hybrid"))
    return sweeps.rank_experiments(rows, [F.col("run").asc()], 10, F.col("run") == 0).withColumn("delta", r6("delta"))


@query("win_6_last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(s, d):
    return ranking.last_wins(T(s, d).events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("agg_18_runtime_stats", """SELECT coalesce(event_type, 'total') AS stage, round(avg(value), 6) AS mean_sec, max(value) AS max_sec, round(avg(value) * 50, 4) AS sec_for_50, round(quantile_cont(value, 0.95), 6) AS p95_sec
   FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def _(s, d):
    events = T(s, d).events
    shape = lambda df, stage: df.select(stage.alias("stage"), r6("mean_sec").alias("mean_sec"), "max_sec", F.round("sec_for_50", 4).alias("sec_for_50"), r6("p95_sec").alias("p95_sec"))
    return shape(audit.runtime_stats(events, "value", "event_type"), F.col("event_type")).unionByName(shape(audit.runtime_stats(events, "value"), F.lit("total")))

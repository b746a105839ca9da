"""Geometry, filters and box joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions import scalars as S
from boxlore.operators import catalog, detections as D
from boxlore.operators import spatial

from boxlore.sources import readers
from suite import sqltext as Q
from suite.base import Tables as T
from suite.base import query

r6 = lambda c: F.round(c, 6)


def _own_pairs(t: T):
    """Every prediction with the annotation it was derived from."""
    p = t.predictions.select("pred_id", F.floor(F.col("pred_id") / 3.0).alias("ann_id"), *[F.col(c).alias("p" + c) for c in "xywh"])
    return p.join(t.annotations.select("ann_id", *"xywh"), "ann_id")


_OWN = "FROM fx_predictions p JOIN fx_annotations g ON CAST(floor(p.pred_id / 3.0) AS BIGINT) = g.ann_id"


@query("geo_1_iou", f"SELECT p.pred_id AS pred_id, round({Q.iou('p', 'g')}, 6) AS iou {_OWN}")
def _(s, d):
    return _own_pairs(T(s, d)).select("pred_id", r6(G.iou(G.box_of("p"), G.box_of())).alias("iou"))


@query("geo_2_iou_mixed", f"SELECT p.pred_id AS pred_id, round({Q.iou('p', 'g')}, 6) AS iou {_OWN}")
def _(s, d):
    corners = G.box_to_corners(G.box_of("p"))
    return _own_pairs(T(s, d)).select("pred_id", r6(G.iou_mixed(G.box_of(), corners)).alias("iou"))


@query("geo_3_iou_eps", f"SELECT p.pred_id AS pred_id, round({Q.iou_eps('p', 'g')}, 6) AS iou {_OWN}")
def _(s, d):
    return _own_pairs(T(s, d)).select("pred_id", r6(G.iou_eps(G.box_of("p"), G.box_of())).alias("iou"))


@query("geo_4_xyxy_to_xywh", "SELECT pred_id, x, y, (x + w) - x AS w, (y + h) - y AS h FROM fx_predictions")
def _(s, d):
    return T(s, d).predictions.select("pred_id", *G.named(G.corners_to_box(G.box_to_corners(G.box_of()))))


@query("geo_5_centre_to_corners", "SELECT pred_id, x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2 FROM fx_predictions")
def _(s, d):
    c = G.centre_to_corners(*[F.col(n) for n in "xywh"])
    return T(s, d).predictions.select("pred_id", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])


@query("geo_6_coco_to_yolo", """SELECT ann_id, round((x + w / 2) / 4000, 6) AS cx, round((y + h / 2) / 3000, 6) AS cy,
       round(w / 4000, 6) AS nw, round(h / 3000, 6) AS nh FROM fx_annotations""")
def _(s, d):
    t = T(s, d)
    y = G.to_yolo(G.box_of(), F.col("width"), F.col("height"))
    return t.annotations.join(t.images, "image_id").select("ann_id", *[r6(v).alias(n) for v, n in zip(y, ("cx", "cy", "nw", "nh"))])


@query("geo_7_yolo_tile", """SELECT ann_id, round((x + w / 2) / 1280, 6) AS cx, round((y + h / 2) / 1280, 6) AS cy,
       round(w / 1280, 6) AS nw, round(h / 1280, 6) AS nh FROM fx_annotations""")
def _(s, d):
    return T(s, d).annotations.select("ann_id", *[r6(v).alias(n) for v, n in zip(G.to_yolo_tile(G.box_of(), 1280), ("cx", "cy", "nw", "nh"))])


_SIZES = "SELECT o_orderkey AS image_id, CAST(300 + (o_orderkey * 37) % 3700 AS INT) AS width, CAST(300 + (o_orderkey * 53) % 2900 AS INT) AS height FROM orders"
_LB = """lb AS (SELECT *, least(1280.0::DOUBLE / height, 1280.0::DOUBLE / width) AS r FROM sizes),
  lb2 AS (SELECT *, CAST(round_even(width * r, 0) AS INT) AS new_w, CAST(round_even(height * r, 0) AS INT) AS new_h FROM lb),
  lb3 AS (SELECT *, CAST(round_even((1280 - new_w) / 2.0::DOUBLE - 0.1::DOUBLE, 0) AS INT) AS pad_left,
                 CAST(round_even((1280 - new_h) / 2.0::DOUBLE - 0.1::DOUBLE, 0) AS INT) AS pad_top FROM lb2)"""


def _sizes(t: T):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("image_id"), (300 + (k * 37) % 3700).cast("int").alias("width"), (300 + (k * 53) % 2900).cast("int").alias("height"))


@query("geo_8_letterbox", f"WITH sizes AS ({_SIZES}), {_LB} SELECT image_id, round(r, 6) AS r, pad_left, pad_top, new_w, new_h FROM lb3")
def _(s, d):
    lb = G.letterbox(F.col("width"), F.col("height"), 1280)
    return _sizes(T(s, d)).select("image_id", r6(lb.scale).alias("r"), lb.left.alias("pad_left"), lb.top.alias("pad_top"), lb.new_w.alias("new_w"), lb.new_h.alias("new_h"))


@query("geo_9_unletterbox", f"""WITH sizes AS ({_SIZES}), {_LB} SELECT image_id, round((100 - pad_left) / r, 8) AS x1, round((120 - pad_top) / r, 8) AS y1,
   round((700 - pad_left) / r, 8) AS x2, round((650 - pad_top) / r, 8) AS y2 FROM lb3""")
def _(s, d):
    lb = G.letterbox(F.col("width"), F.col("height"), 1280)
    c = G.unletterbox(G.Corners(F.lit(100), F.lit(120), F.lit(700), F.lit(650)), lb)
    return _sizes(T(s, d)).select("image_id", *[F.round(v, 8).alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])


@query("geo_10_clip_corners", """SELECT pred_id, round(least(greatest(x / 4000, 0), 1), 6) AS x1, round(least(greatest(y / 3000, 0), 1), 6) AS y1,
   round(least(greatest((x + w) / 4000, 0), 1), 6) AS x2, round(least(greatest((y + h) / 3000, 0), 1), 6) AS y2 FROM fx_predictions""")
def _(s, d):
    c = G.clip_corners_norm(G.box_to_corners(G.box_of()), F.lit(4000), F.lit(3000))
    return T(s, d).predictions.select("pred_id", *[r6(v).alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])


@query("geo_11_clip_box", """SELECT pred_id, least(greatest(x, 0.0), 3600) AS x, least(greatest(y, 0.0), 2500) AS y,
   least(w, 3600 - least(greatest(x, 0.0), 3600)) AS w, least(h, 2500 - least(greatest(y, 0.0), 2500)) AS h FROM fx_predictions""")
def _(s, d):
    return T(s, d).predictions.select("pred_id", *G.named(G.clip_box(G.box_of(), F.lit(3600.0), F.lit(2500.0))))


@query("geo_12_flip", """SELECT pred_id, 4000 - x - w AS flipped_x, 4000 - (x + w) AS flipped_x1, 4000 - x AS flipped_x2,
   4000 - least(greatest(x, 0.0), 3600) - least(w, 3600 - least(greatest(x, 0.0), 3600)) AS clip_then_flip,
   least(greatest(4000 - x - w, 0.0), 3600) AS flip_then_clip FROM fx_predictions""")
def _(s, d):
    b, w = G.box_of(), F.lit(4000.0)
    c = G.flip_corners(G.box_to_corners(b), w)
    return T(s, d).predictions.select(
        "pred_id", G.flip_box(b, w).x.alias("flipped_x"), c.x1.alias("flipped_x1"), c.x2.alias("flipped_x2"),
        G.flip_box(G.clip_box(b, F.lit(3600.0), F.lit(2500.0)), w).x.alias("clip_then_flip"),
        G.clip_box(G.flip_box(b, w), F.lit(3600.0), F.lit(2500.0)).x.alias("flip_then_clip"))


@query("geo_13_denormalise", """WITH c AS (SELECT pred_id, least(greatest(x / 3900, 0), 1) AS x1, least(greatest(y / 2500, 0), 1) AS y1,
   least(greatest((x + w) / 3900, 0), 1) AS x2, least(greatest((y + h) / 2500, 0), 1) AS y2 FROM fx_predictions)
   SELECT pred_id, round(x1 * 3900, 4) AS x, round(y1 * 2500, 4) AS y, round((x2 - x1) * 3900, 4) AS w, round((y2 - y1) * 2500, 4) AS h
   FROM c WHERE (x2 - x1) * 3900 > 0 AND (y2 - y1) * 2500 > 0""")
def _(s, d):
    w, h = F.lit(3900), F.lit(2500)
    box = G.denormalise(G.clip_corners_norm(G.box_to_corners(G.box_of()), w, h), w, h)
    return D.positive_area(T(s, d).predictions.select("pred_id", *G.named(box))).select("pred_id", *[F.round(c, 4).alias(c) for c in "xywh"])


@query("geo_14_tile_to_image", "SELECT pred_id, x + (pred_id % 4) * 640 AS x, y + (pred_id % 3) * 640 AS y, w, h FROM fx_predictions")
def _(s, d):
    p = F.col("pred_id")
    return T(s, d).predictions.select("pred_id", *G.named(G.tile_to_image(G.box_of(), (p % 4) * 640, (p % 3) * 640)))


@query("geo_15_clip_to_tile", """WITH c AS (SELECT ann_id, greatest(x, 960.0) AS x1, greatest(y, 640.0) AS y1, least(x + w, 2240.0) AS x2, least(y + h, 1920.0) AS y2, w * h AS area FROM fx_annotations)
   SELECT ann_id, x1 - 960 AS x, y1 - 640 AS y, x2 - x1 AS w, y2 - y1 AS h FROM c
   WHERE area > 0 AND x2 - x1 >= 10 AND y2 - y1 >= 10 AND (x2 - x1) * (y2 - y1) / area >= 0.5""")
def _(s, d):
    box, kept = G.clip_to_tile(G.box_of(), F.lit(960.0), F.lit(640.0), 1280)
    return T(s, d).annotations.where(kept).select("ann_id", *G.named(box))


def _crop_sql(pad: float, side: int) -> str:
    return f"""WITH c AS (SELECT ann_id, greatest(0, CAST(trunc(x - w * {pad}::DOUBLE) AS INT)) AS x1, greatest(0, CAST(trunc(y - h * {pad}::DOUBLE) AS INT)) AS y1,
       least(3700, CAST(trunc(x + w + w * {pad}::DOUBLE) AS INT)) AS x2, least(2400, CAST(trunc(y + h + h * {pad}::DOUBLE) AS INT)) AS y2 FROM fx_annotations)
       SELECT * FROM c WHERE x2 - x1 >= {side} AND y2 - y1 >= {side}"""


for _name, _pad, _side in (("geo_16_crop_rect", 0.0, 5), ("geo_16_crop_rect_padded", 0.1, 1)):
    def _crop(s, d, pad=_pad, side=_side):
        c = G.crop_rect(G.box_of(), F.lit(3700), F.lit(2400), pad)
        return T(s, d).annotations.where(G.crop_usable(c, side)).select("ann_id", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])
    query(_name, _crop_sql(_pad, _side))(_crop)


@query("geo_17_argmax_class", "SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS score, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_id FROM embeddings")
def _(s, d):
    score, cls = G.argmax_class(F.col("embedding"))
    return T(s, d).embeddings.select("vec_id", r6(score.cast("double")).alias("score"), cls.alias("class_id"))


@query("geo_18_softmax", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN [CAST(e AS DOUBLE) FOR e IN embedding]
        ELSE [CAST(e AS DOUBLE) * e FOR e IN embedding] END AS p FROM embeddings),
   f AS (SELECT vec_id, p, list_min(p) < 0 OR list_sum(p) > 1.5 AS raw, [exp(e - list_max(p)) FOR e IN p] AS z FROM v)
   SELECT vec_id, raw AS is_raw, round(CASE WHEN raw THEN z[1] / list_sum(z) ELSE p[1] END, 6) AS first_share,
          round(CASE WHEN raw THEN list_max(z) / list_sum(z) ELSE list_max(p) END, 6) AS best_share FROM f""")
def _(s, d):
    vec = F.transform("embedding", lambda e: e.cast("double"))
    vec = F.when(F.col("vec_id") % 2 == 0, vec).otherwise(F.transform(vec, lambda e: e * e))
    rows = T(s, d).embeddings.select("vec_id", vec.alias("p")).withColumn("q", G.softmax_if_logits(F.col("p")))
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", ((F.array_min("p") < 0) | (total > 1.5)).alias("is_raw"), r6(F.get("q", F.lit(0))).alias("first_share"), r6(F.array_max("q")).alias("best_share"))


@query("geo_19_clamp_category", """SELECT pred_id, CASE WHEN category_id - 3 < 0 OR category_id - 3 >= 30 THEN 0 ELSE category_id - 3 END AS detector,
   CASE WHEN category_id - 3 < 0 OR category_id - 3 >= 30 THEN category_id ELSE category_id - 3 END AS classifier FROM fx_predictions""")
def _(s, d):
    c = F.col("category_id") - 3
    return T(s, d).predictions.select("pred_id", G.clamp_category(c, 30).alias("detector"), G.clamp_category(c, 30, F.col("category_id")).alias("classifier"))


@query("geo_20_sanitize", """WITH broken AS (SELECT pred_id, image_id, category_id - 2 AS category_id, CASE WHEN pred_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN pred_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE x - 40 END AS x,
     y - 40 AS y, CASE WHEN pred_id % 83 = 0 THEN -5 ELSE w END AS w, h, score * 1.5 - 0.2 AS score FROM fx_predictions),
   c AS (SELECT pred_id, greatest(0.0, x) AS x, greatest(0.0, y) AS y, w, h, score, category_id FROM broken WHERE NOT isnan(x) AND NOT isinf(x)),
   k AS (SELECT pred_id, x, y, least(w, 4000 - x) AS w, least(h, 3000 - y) AS h, round(least(greatest(score, 0.0), 1.0), 6) AS score,
     CASE WHEN category_id < 0 OR category_id >= 35 THEN 0 ELSE category_id END AS category_id FROM c)
   SELECT * FROM k WHERE w > 0 AND h > 0""")
def _(s, d):
    t, p = T(s, d), F.col("pred_id")
    broken = t.predictions.select(
        "pred_id", "image_id", (F.col("category_id") - 2).alias("category_id"),
        F.when(p % 97 == 0, F.lit(float("nan"))).when(p % 89 == 0, F.lit(float("inf"))).otherwise(F.col("x") - 40).alias("x"),
        (F.col("y") - 40).alias("y"), F.when(p % 83 == 0, F.lit(-5.0)).otherwise(F.col("w")).alias("w"), "h", (F.col("score") * 1.5 - 0.2).alias("score"))
    return D.sanitize(broken, t.images, 35).drop("image_id").withColumn("score", r6("score"))


_RAW = """raw AS (SELECT pred_id, model_id, image_id, (x + w / 2) * 0.32::DOUBLE AS cx, (y + h / 2) * 0.32::DOUBLE + 160 AS cy, w * 0.32::DOUBLE AS w, h * 0.32::DOUBLE AS h, score, CAST(category_id % 4 AS INT) AS cls FROM fx_predictions)"""


def raw_rows(t: T):
    """Predictions pushed back into model space (4000 x 3000 in a square of 1280)."""
    k = F.lit(0.32)
    cls = F.col("category_id") % 4
    scores = F.array(*[F.when(cls == i, F.col("score")).otherwise(F.col("score") / (i + 2)) for i in range(4)])
    return t.predictions.select(
        "pred_id", "model_id", "image_id", ((F.col("x") + F.col("w") / 2) * k).alias("cx"), ((F.col("y") + F.col("h") / 2) * k + 160).alias("cy"),
        (F.col("w") * k).alias("w"), (F.col("h") * k).alias("h"), scores.alias("class_scores"))


@query("decode_detections", f"""WITH {_RAW}, c AS (SELECT pred_id, model_id, image_id, cls AS category_id, score,
     least(greatest((cx - w / 2) / 0.32::DOUBLE / 4000, 0), 1) AS x1, least(greatest((cy - h / 2 - 160) / 0.32::DOUBLE / 3000, 0), 1) AS y1,
     least(greatest((cx + w / 2) / 0.32::DOUBLE / 4000, 0), 1) AS x2, least(greatest((cy + h / 2 - 160) / 0.32::DOUBLE / 3000, 0), 1) AS y2 FROM raw WHERE score >= 0.25)
   SELECT pred_id, model_id, image_id, category_id, score, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM c WHERE x2 > x1 AND y2 > y1""")
def _(s, d):
    t = T(s, d)
    out = D.decode_detections(raw_rows(t), t.images, 1280, 0.25)
    return out.select("pred_id", "model_id", "image_id", "category_id", "score", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _flipped_sql(boxes: bool, before: bool) -> str:
    head = f"WITH {_RAW}, p AS (SELECT pred_id, model_id, image_id, cls AS category_id, score, (cx - w / 2) / 0.32::DOUBLE AS x1, (cy - h / 2 - 160) / 0.32::DOUBLE AS y1, (cx + w / 2) / 0.32::DOUBLE AS x2, (cy + h / 2 - 160) / 0.32::DOUBLE AS y2 FROM raw WHERE score >= 0.25)"
    turn = "SELECT * REPLACE (4000 - x2 AS x1, 4000 - x1 AS x2) FROM"
    clip = "SELECT * REPLACE (least(greatest(x1 / 4000, 0), 1) AS x1, least(greatest(y1 / 3000, 0), 1) AS y1, least(greatest(x2 / 4000, 0), 1) AS x2, least(greatest(y2 / 3000, 0), 1) AS y2) FROM"
    if not boxes:
        steps = f"f AS ({turn} p), c AS ({clip} f)" if before else f"f AS ({clip} p), c AS (SELECT * REPLACE (1 - x2 AS x1, 1 - x1 AS x2) FROM f)"
        return f"{head}, {steps} SELECT pred_id, model_id, image_id, category_id, score, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM c WHERE x2 > x1 AND y2 > y1"
    shape = "b AS (SELECT pred_id, model_id, image_id, category_id, score, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM p)"
    turn = "SELECT * REPLACE (4000 - x - w AS x) FROM"
    clip = "SELECT * REPLACE (least(greatest(w, 0), 4000 - x) AS w, least(greatest(h, 0), 3000 - y) AS h) FROM (SELECT * REPLACE (least(greatest(x, 0), 4000) AS x, least(greatest(y, 0), 3000) AS y) FROM {})"
    steps = f"f AS ({turn} b), c AS ({clip.format('f')})" if before else f"f AS ({clip.format('b')}), c AS ({turn} f)"
    return f"{head}, {shape}, {steps} SELECT pred_id, model_id, image_id, category_id, score, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM c WHERE w > 0 AND h > 0"


for _boxes, _before in ((False, True), (False, False), (True, True), (True, False)):
    def _flipped(s, d, boxes=_boxes, before=_before):
        t = T(s, d)
        decode, names, digits = (D.decode_boxes, "xywh", 4) if boxes else (D.decode_detections, ("x1", "y1", "x2", "y2"), 5)
        out = decode(raw_rows(t), t.images, 1280, 0.25, flipped=True, flip_before_clip=before)
        return out.select("pred_id", "model_id", "image_id", "category_id", "score", *[F.round(c, digits).alias(c) for c in names])

    query(f"decode_{'boxes' if _boxes else 'detections'}_flipped_{'before' if _before else 'after'}_clip", _flipped_sql(_boxes, _before))(_flipped)


@query("decode_boxes", _flipped_sql(True, True).replace("SELECT * REPLACE (4000 - x - w AS x) FROM b", "SELECT * FROM b"))
def _(s, d):
    t = T(s, d)
    out = D.decode_boxes(raw_rows(t), t.images, 1280, 0.25)
    return out.select("pred_id", "model_id", "image_id", "category_id", "score", *[F.round(c, 4).alias(c) for c in "xywh"])


@query("flt_1_conf_filter", "SELECT pred_id, score FROM fx_predictions WHERE score >= 0.4")
def _(s, d):
    return D.confident(T(s, d).predictions, 0.4).select("pred_id", "score")


@query("flt_2_split_filter", "SELECT pred_id, image_id FROM fx_predictions WHERE image_id % 5 = 2")
def _(s, d):
    t = T(s, d)
    split = t.images.select("image_id", F.when(F.col("image_id") % 5 == 2, "val").otherwise("train").alias("split"))
    return D.split_filter(t.predictions.select("pred_id", "image_id"), split)


@query("flt_3_positive_area", "SELECT pred_id FROM fx_predictions WHERE w - 230 > 0 AND h - 210 > 0")
def _(s, d):
    return D.positive_area(T(s, d).predictions.select("pred_id", (F.col("w") - 230).alias("w"), (F.col("h") - 210).alias("h"))).select("pred_id")


@query("flt_4_min_side", "SELECT count_if(w - 205 >= 3 AND h - 203 >= 3) AS kept, count_if(w - 205 < 3 OR h - 203 < 3) AS skipped FROM fx_annotations")
def _(s, d):
    return D.min_side_counts(T(s, d).annotations.withColumns({"w": F.col("w") - 205, "h": F.col("h") - 203}), 3)


@query("flt_5_selective_classify", "SELECT p.pred_id AS pred_id, coalesce(c.cls, -1) AS cls FROM fx_predictions p LEFT JOIN fx_classifier c ON p.pred_id = c.pred_id AND p.score < 0.7")
def _(s, d):
    t = T(s, d)
    unsure = D.selective(t.predictions, 0.7).select("pred_id").join(t.classifier, "pred_id").select("pred_id", "cls")
    return t.predictions.select("pred_id").join(unsure, "pred_id", "left").select("pred_id", F.coalesce("cls", F.lit(-1)).alias("cls"))


_PAIR_COLS = "p.image_id AS image_id, p.pred_id AS pred_id, g.ann_id AS gt_id, round({iou}, 6) AS iou".format(iou=Q.iou("p", "g"))


@query("join_5_iou_join", f"SELECT {_PAIR_COLS} FROM fx_predictions p JOIN fx_annotations g ON p.image_id = g.image_id AND {Q.touch('p', 'g')} WHERE {Q.iou('p', 'g')} >= 0.3")
def _(s, d):
    t = T(s, d)
    return spatial.iou_join(t.predictions, t.gts, 0.3).select("image_id", "pred_id", "gt_id", r6("iou").alias("iou"))


@query("join_5_iou_join_same_class", f"""SELECT {_PAIR_COLS} FROM fx_predictions p JOIN fx_annotations g
   ON p.image_id = g.image_id AND p.category_id = g.category_id AND {Q.touch('p', 'g')} WHERE {Q.iou('p', 'g')} >= 0.5""")
def _(s, d):
    t = T(s, d)
    return spatial.iou_join(t.predictions, t.gts, 0.5, ["image_id", "category_id"]).select("image_id", "pred_id", "gt_id", r6("iou").alias("iou"))


_BEST = f"""best AS (SELECT g.ann_id, g.image_id, g.category_id, p.pred_id, p.category_id AS pred_category, p.score, {Q.iou('p', 'g')} AS iou,
     row_number() OVER (PARTITION BY g.ann_id ORDER BY {Q.iou('p', 'g')} DESC, p.pred_id) AS rn
     FROM fx_annotations g JOIN fx_predictions p ON p.image_id = g.image_id AND {Q.touch('p', 'g')}),
   bo AS (SELECT g.ann_id AS gt_id, g.image_id AS image_id, g.category_id AS category_id, coalesce(b.pred_category, -1) AS pred_category, coalesce(b.iou, 0.0) AS iou, coalesce(b.score, 0.0) AS pred_score
     FROM fx_annotations g LEFT JOIN best b ON b.ann_id = g.ann_id AND b.rn = 1)"""


def _best(t: T):
    return spatial.best_overlap(t.predictions, t.gts)


@query("join_6_best_overlap", f"WITH {_BEST} SELECT gt_id, category_id, pred_category, round(iou, 6) AS iou, pred_score FROM bo")
def _(s, d):
    return _best(T(s, d)).select("gt_id", "category_id", "pred_category", r6("iou").alias("iou"), "pred_score")


@query("join_7_label_disagreement", f"WITH {_BEST} SELECT gt_id, category_id, pred_category, round(iou, 6) AS iou, pred_score FROM bo WHERE iou >= 0.5 AND pred_score >= 0.4 AND pred_category <> category_id")
def _(s, d):
    return spatial.label_disagreement(_best(T(s, d))).select("gt_id", "category_id", "pred_category", r6("iou").alias("iou"), "pred_score")


@query("join_7_label_disagreement_strict", f"WITH {_BEST} SELECT gt_id, category_id, pred_category, pred_score FROM bo WHERE iou > 0.5 AND pred_score > 0.5 AND pred_category <> category_id")
def _(s, d):
    return spatial.label_disagreement(_best(T(s, d)), 0.5, 0.5, strict=True).select("gt_id", "category_id", "pred_category", "pred_score")


@query("win_3_rank_disagreements", f"""WITH {_BEST} SELECT gt_id, pred_category, pred_score FROM bo WHERE iou >= 0.5 AND pred_score >= 0.4 AND pred_category <> category_id
   ORDER BY pred_score DESC, gt_id LIMIT 30""")
def _(s, d):
    rows = spatial.label_disagreement(_best(T(s, d)))
    return spatial.rank_disagreements(rows, 30).select("gt_id", "pred_category", "pred_score")


@query("join_1_ann_image", "SELECT a.ann_id AS ann_id, i.file_name AS file_name, i.width AS width, i.height AS height FROM fx_annotations a JOIN fx_images i ON a.image_id = i.image_id")
def _(s, d):
    t = T(s, d)
    return catalog.annotation_images(t.annotations, t.images).select("ann_id", "file_name", "width", "height")


@query("join_2_ann_category_name", """SELECT a.ann_id AS ann_id, coalesce(c.name, '?') AS name, coalesce(c.name, concat('cat_', CAST(a.category_id AS VARCHAR))) AS label
   FROM fx_annotations a LEFT JOIN fx_categories c ON a.category_id = c.category_id + CASE WHEN c.category_id % 6 = 1 THEN 1000000 ELSE 0 END""")
def _(s, d):
    t = T(s, d)
    c = F.col("category_id")
    known = t.categories.withColumn("category_id", (c + F.when(c % 6 == 1, 1000000).otherwise(0)).cast("int"))  # some classes have no name
    return catalog.annotation_names(t.annotations, known).select("ann_id", "name", "label")


@query("join_21_existing_files", "SELECT image_id, file_name FROM fx_images WHERE image_id % 3 <> 1")
def _(s, d):
    t = T(s, d)
    there = t.images.select(F.concat(F.lit("/data/images/"), F.when(F.col("image_id") % 3 == 1, "old_").otherwise(""), F.col("file_name")).alias("path"))
    return readers.existing_files(t.images.select("image_id", "file_name"), there)




def _cap_sql(cap: int, before: str = "true", after: str = "true") -> str:
    return f"""WITH r AS (SELECT pred_id, image_id, w, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rn
      FROM (SELECT pred_id, image_id, score, w - 220 AS w, h FROM fx_predictions) WHERE {before}) SELECT pred_id, image_id FROM r WHERE rn <= {cap} AND {after}"""


for _name, _mode, _sql in (
    ("win_2_cap_per_image", None, _cap_sql(40)),
    ("win_2_cap_then_filter", "after", _cap_sql(40, after="w > 0")),
    ("win_2_filter_then_cap", "before", _cap_sql(40, before="w > 0")),
):
    def _cap(s, d, mode=_mode):
        rows = T(s, d).predictions.withColumn("w", F.col("w") - 220)
        return D.cap_per_image(rows, 40, drop_empty=mode).select("pred_id", "image_id")
    query(_name, _sql)(_cap)


@query("fn_5_format_names", """SELECT ann_id, format('tile_{:05d}_{:04d}_{:04d}', image_id, ann_id % 3000, ann_id % 1777) AS tile, format('crop_img{:05d}_ann{:06d}', image_id, ann_id) AS crop,
   format('cat{:03d}_{}', category_id, CAST(ann_id AS VARCHAR)) AS file FROM fx_annotations""")
def _(s, d):
    a = F.col("ann_id")
    return T(s, d).annotations.select(
        "ann_id", S.tile_name(F.col("image_id"), a % 3000, a % 1777).alias("tile"), S.crop_name(F.col("image_id"), a).alias("crop"), S.catalogue_name(F.col("category_id"), a.cast("string")).alias("file"))


@query("fn_7_rounding", "SELECT pred_id, round(x / 7, 1) AS r1, round(score / 3, 4) AS r4, round(score / 7, 6) AS r6 FROM fx_predictions")
def _(s, d):
    return T(s, d).predictions.select("pred_id", F.round(F.col("x") / 7, 1).alias("r1"), F.round(F.col("score") / 3, 4).alias("r4"), r6(F.col("score") / 7).alias("r6"))


@query("fn_8_vectors", """WITH n AS (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings), z AS (SELECT vec_id, v, sqrt(list_sum([e * e FOR e IN v])) AS norm FROM n)
   SELECT vec_id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first_value, round(list_sum([e * e / norm FOR e IN v]), 6) AS dot_with_unit FROM z""")
def _(s, d):
    rows = T(s, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    unit = S.l2_normalise(F.col("v"))
    return rows.select("vec_id", r6(F.sqrt(S.dot(F.col("v"), F.col("v")))).alias("norm"), r6(F.get(unit, F.lit(0))).alias("first_value"), r6(S.dot(F.col("v"), unit)).alias("dot_with_unit"))


@query("fn_10_parse_grid", "SELECT user_id, event_id, CAST(trim(v) AS DOUBLE) AS v FROM (SELECT user_id, event_id, unnest(string_split(concat(CAST(value AS VARCHAR), ', ', CAST(value / 2 AS VARCHAR), ',0.5'), ',')) AS v FROM events)")
def _(s, d):
    text = F.concat(F.col("value").cast("string"), F.lit(", "), (F.col("value") / 2).cast("string"), F.lit(",0.5"))
    return T(s, d).events.select("user_id", "event_id", S.grid_values(text).alias("v"))


@query("src_7_image_listing", "SELECT image_id, concat('/data/', file_name) AS path FROM fx_images WHERE image_id % 4 <> 0 UNION ALL SELECT image_id, concat('/data/', upper(file_name), '.bak') FROM fx_images WHERE image_id % 4 = 0 AND image_id % 8 = 0")
def _(s, d):
    i = F.col("image_id")
    name = F.when(i % 8 == 0, F.concat(F.upper("file_name"), F.lit(".bak"))).when(i % 4 == 0, F.concat(F.lit("photo_"), F.col("file_name"))).otherwise(F.col("file_name"))
    files = T(s, d).images.select(F.concat(F.lit("/data/"), name).alias("path"), F.lit(1).alias("length"))
    return readers.listed_images(files).select("image_id", "path")


@query("src_7_image_listing_lenient", "SELECT file_name, CASE WHEN image_id % 5 = 0 THEN NULL ELSE image_id END AS parsed_id FROM fx_images")
def _(s, d):
    path = F.when(F.col("image_id") % 5 == 0, F.concat(F.lit("/a/x_"), F.col("image_id").cast("string"), F.lit("b.jpg"))).otherwise(F.concat(F.lit("/a/b_"), F.col("file_name")))
    return T(s, d).images.select("file_name", readers.lenient_image_id(path).alias("parsed_id"))


_CATFILES = "SELECT format('cat{:03d}_{}', ann_id % 60, CAST(ann_id AS VARCHAR)) AS stem, ann_id FROM fx_annotations"


def catalogue_listing(t: T):
    a = F.col("ann_id")
    stem = S.catalogue_name((a % 60).cast("int"), a.cast("string"))
    stem = F.when(a % 9 == 0, F.concat(F.lit("dog_"), a.cast("string"))).otherwise(stem)
    return t.annotations.select(F.concat(F.lit("/cdn/"), stem, F.lit(".jpg")).alias("path"))


@query("src_8_catalog_filenames", f"SELECT CAST(ann_id % 60 AS INT) AS category_id, CAST(ann_id AS VARCHAR) AS code, stem FROM ({_CATFILES}) WHERE ann_id % 9 <> 0 AND ann_id % 60 < 40")
def _(s, d):
    return readers.catalogue_files(catalogue_listing(T(s, d)), 40)

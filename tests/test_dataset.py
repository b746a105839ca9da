"""Readers, tiling, sampling, votes, catalogue and cleaning on small inputs worked out by hand or by plain Python."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions.scalars import unit
from boxlore.operators import audit, catalog, cleaning, consensus, detections, predict, ranking, sampling, tiling
from boxlore.sources import readers, writers

ANN = "ann_id long, image_id long, category_id int, x double, y double, w double, h double"
IMG = "image_id long, file_name string, width int, height int"


def test_documents_of_both_layouts(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "img_00001.jpg", "width": 40, "height": 30}],
           "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "area": 12}],
           "categories": [{"id": 2, "name": "tea"}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc, indent=1))
    images, anns, cats = readers.coco_scan(spark, str(tmp_path / "coco.json"))
    assert tuple(images.first()) == (1, "img_00001.jpg", 40, 30) and cats.first().name == "tea"
    a = anns.first()
    assert (a.ann_id, a.x, a.y, a.w, a.h) == (5, 1.0, 2.0, 3.0, 4.0)

    preds = [{"image_id": 1, "category_id": 3, "bbox": [0, 0, 5, 5], "score": 0.5}] * 2
    (tmp_path / "p.json").write_text(json.dumps(preds, indent=1))
    assert readers.predictions_scan(spark, str(tmp_path / "p.json")).count() == 2

    split = {"train_ids": [1, 2], "val_ids": [3], "seed": 42}
    (tmp_path / "s.json").write_text(json.dumps(split, indent=1))
    rows = readers.split_scan(spark, str(tmp_path / "s.json"))
    assert {tuple(r) for r in rows.collect()} == {(1, "train"), (2, "train"), (3, "val")}
    assert {r.split for r in readers.all_train(rows).collect()} == {"train"}


@pytest.mark.parametrize("wrapped", [True, False])
def test_product_metadata(spark, tmp_path, wrapped):
    rows = [{"product_name": "a", "product_code": "1"}, {"product_name": "", "name": "b", "product_code": "2"},
            {"display_name": "c", "product_code": "3"}, {"product_code": "4"}, {"product_name": "a", "product_code": "5"}]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"products": rows} if wrapped else rows, indent=1))
    got = {r.product_name: r.product_code for r in readers.product_metadata_scan(spark, str(path)).collect()}
    assert got == {"a": "5", "b": "2", "c": "3"}
    assert readers.product_metadata_scan(spark, str(tmp_path / "none.json")).count() == 0


def test_corrections_and_verdicts(spark, tmp_path):
    for i, rows in enumerate(([{"ann_id": 1, "old_cat": 2, "new_cat": 3}], [{"ann_id": 4, "old_cat": 5, "new_cat": 6, "source": "review"}])):
        (tmp_path / f"c{i}.json").write_text(json.dumps(rows, indent=1))
    got = readers.corrections_scan(spark, [str(tmp_path / "c0.json"), str(tmp_path / "c1.json")])
    assert {(r.ann_id, r.file[-7:]) for r in got.collect()} == {(1, "c0.json"), (4, "c1.json")}
    results = [{"ann_id": 1, "consensus": "mismatch"}, {"ann_id": 2, "consensus": "match"}]
    (tmp_path / "ckpt.json").write_text(json.dumps(results[:1], indent=1))
    final, ckpt = str(tmp_path / "final.json"), str(tmp_path / "ckpt.json")
    assert [r.ann_id for r in readers.verification_scan(spark, final, ckpt).collect()] == [1]
    (tmp_path / "final.json").write_text(json.dumps({"results": results + [{"ann_id": 9, "consensus": "mismatch"}]}, indent=1))
    assert sorted(r.ann_id for r in readers.verification_scan(spark, final, ckpt).collect()) == [1, 9]


def test_image_listing_reads_names_only(spark, tmp_path):
    for name in ("img_00007.JPG", "IMG_8.png", "img_9.gif", "other_1.jpg", "img_10.jpeg.bak"):
        (tmp_path / name).write_bytes(b"x" * 10)
    got = {(r.image_id, r.length) for r in readers.image_listing(spark, str(tmp_path)).collect()}
    assert got == {(7, 10), (8, 10), (10, 10)}


def test_label_texts_and_files(spark, tmp_path):
    anns = [(i, 1, i % 3, float(i), 5.0, 10.0, 10.0) for i in range(2500)] + [(99, 2, 1, 0.0, 0.0, 8.0, 6.0)]
    images = [(1, "img_1.jpg", 100, 50), (2, "img_2.jpg", 100, 50), (3, "img_3.jpg", 100, 50)]
    split = spark.createDataFrame([(1, "train"), (2, "val"), (3, "val")], "image_id long, split string")
    a, i = spark.createDataFrame(anns, ANN), spark.createDataFrame(images, IMG)
    rows = writers.yolo_labels(a, i, split).collect()
    whole = {r.label_file: r.labels for r in rows}
    assert len(rows) == 3 and whole["img_3.txt"] == "" and whole["img_2.txt"] == "1 0.040000 0.060000 0.080000 0.120000"
    assert whole["img_1.txt"].count("\n") == len(anns) - 2
    writers.write_yolo_labels(a, i, split, str(tmp_path / "labels"))
    files = {p.parent.name.split("=")[1]: p.read_text().rstrip("\n") for p in (tmp_path / "labels").rglob("part-*") if p.suffix == ".txt"}
    assert files == whole


def _tiles(w, h, tile, stride):
    if w < tile or h < tile:
        return {(0, 0)}
    xs = set(range(0, w - tile + 1, stride)) | {w - tile}
    ys = set(range(0, h - tile + 1, stride)) | {h - tile}
    return {(x, y) for x in xs for y in ys}


def test_tiles_cover_images_and_hold_the_right_boxes(spark):
    r = random.Random(4)
    images = [(i, f"img_{i}.jpg", r.randrange(60, 400), r.randrange(60, 400)) for i in range(12)] + [(50, "img_50.jpg", 100, 400), (51, "e.jpg", 99, 400)]
    anns = [(k, i, 0, float(r.randrange(-10, w)), float(r.randrange(-10, h)), float(r.randrange(0, 90)), float(r.randrange(5, 90))) for k, (i, _, w, h) in enumerate(images * 8)]
    di, da = spark.createDataFrame(images, IMG), spark.createDataFrame(anns, ANN)
    for stride in (100, 70):
        grid = {}
        for row in tiling.tile_grid(di, 100, stride).collect():
            grid.setdefault(row.image_id, []).append((row.tile_x, row.tile_y))
        for i, _, w, h in images:
            assert sorted(grid[i]) == sorted(_tiles(w, h, 100, stride))
        want = set()
        for k, i, _, x, y, w, h in anns:
            for tx, ty in grid[i]:
                cw, ch = min(x + w, tx + 100) - max(x, tx), min(y + h, ty + 100) - max(y, ty)
                if w * h > 0 and cw >= 10 and ch >= 10 and cw * ch / (w * h) >= 0.5:
                    want.add((k, tx, ty, max(x, tx) - tx, max(y, ty) - ty, cw, ch))
        got = tiling.tile_annotations(da, di, 100, stride).collect()
        assert {(g.ann_id, g.tile_x, g.tile_y, g.x, g.y, g.w, g.h) for g in got} == want and len(got) == len(want)


def test_val_split_keeps_sole_sources_in_training(spark):
    images = spark.range(40).select(F.col("id").alias("image_id"))
    anns = [(i, i % 40, 0 if i % 40 > 4 else 100 + i % 40) for i in range(80)]
    split = {r.image_id: r.split for r in sampling.val_split(images, spark.createDataFrame(anns, "ann_id long, image_id long, category_id int")).collect()}
    assert sum(v == "val" for v in split.values()) == 8 and len(split) == 40
    assert all(split[i] == "train" for i in range(5))


def test_jitter_respects_overlap_and_count(spark):
    images = spark.createDataFrame([(1, "a.jpg", 1000, 1000)], IMG)
    anns = spark.createDataFrame([(i, 1, 0, 50.0 + 3 * i, 60.0, 40.0 + i, 30.0) for i in range(60)], ANN)
    rows = sampling.jitter_boxes(anns, images, pos=0.2, scale=0.3).join(anns.select("ann_id", *[F.col(c).alias("o" + c) for c in "xywh"]), "ann_id")
    got = rows.withColumn("iou", G.iou(G.box_of(), G.box_of("o"))).collect()
    assert got and all(r.iou >= 0.6 for r in got)
    assert max(sum(1 for r in got if r.ann_id == i) for i in range(60)) == 2


# Votes 1, 2, 3 and what they give; None is no vote.
TRUTH = [("YYY", "match"), ("YNY", "match"), ("NYY", "match"), ("YYN", "match"), ("NNN", "mismatch"), ("YNN", "mismatch"), ("NNY", "mismatch"), ("NYN", "mismatch"),
         ("YN?", "disagree"), ("Y??", "match"), ("N??", "mismatch"), ("???", "error"), ("YY?", "match"), ("?NN", "mismatch")]


def test_vote_truth_table(spark):
    vote = {"Y": True, "N": False, "?": None}
    long = [(i, v + 1, vote[c]) for i, (p, _) in enumerate(TRUTH) for v, c in enumerate(p)]
    got = {r.ann_id: r.consensus for r in consensus.vote_consensus(spark.createDataFrame(long, "ann_id long, voter int, vote boolean")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(TRUTH)}
    wide = spark.createDataFrame([(w, *[vote[c] for c in p]) for p, w in TRUTH], "want string, a boolean, b boolean, c boolean")
    assert all(r.want == r.got for r in wide.select("want", consensus.vote_consensus_wide(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect())


def test_answers_are_parsed(spark):
    cases = [('{"match": true, "reason": "ok"}', True, "ok"), ('```json\n{"match": false, "reason": "x"}\n```', False, "x"), ('{"match": false,', False, '{"match": false,'),
             ("They do not match at all", False, "They do not match at all"), ("clearly the same product", True, ""), ("this is not same product", None, "parse_error"), ("", None, "parse_error"),
             ('{"match": null}', None, ""), ('  {"match":true, "rea', True, "")]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", consensus.parse_verdict(F.col("t")).alias("v")).collect()
    for r in rows:
        assert (r.v.match, r.v.reason) == cases[r.i][1:], cases[r.i]
    cases = [('{"choice": 2, "cat_id": 7, "confidence": "high", "reason": "r"}', (2, 7, "high", "r")), ('{"choice": 0, "cat_id": null}', (0, None, "unknown", "")),
             ('{"choice": 3, "cat_id": 12, "reason": "cut', (3, 12, "unknown", "partial_parse")), ("no idea " * 20, (0, None, "error", "parse_error: " + ("no idea " * 20)[:80]))]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", consensus.parse_choice(F.col("t")).alias("v")).collect()
    for r in rows:
        assert tuple(r.v) == cases[r.i][1]


def test_reconcile_statuses(spark):
    cats = spark.createDataFrame([(0, "tea a"), (1, "tea b"), (2, "tea c"), (3, "tea d"), (4, "tea e"), (5, "tea f"), (6, "unknown_product")], "category_id int, name string")
    codes = spark.createDataFrame([(0, "10"), (1, "11"), (2, "12"), (3, "13")], "category_id int, meta_ean string")
    hits = spark.createDataFrame([
        (0, 0, "other", "10", "i", "b", None), (0, 1, "TEA  A", "10", "i", "b", None), (1, 0, "x", "9", "i", "b", None), (1, 1, "y", "11", "i", "b", None), (1, 2, "z", "11", "j", "b", None),
        (2, 0, "Tea C", "99", "i", "b", None), (4, 0, "green", None, "", "b", None), (5, 0, None, None, None, None, "timeout")],
        "category_id int, rank int, name string, ean string, image string, brand string, error string")
    ref = spark.createDataFrame([(0,), (1,)], "category_id int")
    got = {r.category_id: r for r in catalog.reconcile(cats, codes, hits, ref).collect()}
    assert {k: r.status for k, r in got.items()} == {0: "OK", 1: "NAME_MISMATCH", 2: "EAN_MISMATCH", 3: "NOT_FOUND", 4: "FUZZY_MATCH", 5: "API_ERROR", 6: "SKIP"}
    assert got[1].api_name == "z" and got[0].issues == [] and got[3].issues == ["no results", "missing reference image"]
    assert [r.category_id for r in catalog.missing_reference_images(spark.createDataFrame(list(got.values()), catalog.reconcile(cats, codes, hits, ref).schema)).collect()] == [2]


def test_similarity_blocks_agree(spark):
    r = random.Random(2)
    crops = spark.createDataFrame([(i, i % 9, [r.gauss(0, 1) for _ in range(6)]) for i in range(40)], "ann_id long, category_id int, embedding array<float>")
    cen = cleaning.reference_centroid(crops.where("category_id < 7 and ann_id < 30").select("category_id", "embedding"))
    one = {x.ann_id: x for x in cleaning.topk_similarity(crops, cen).collect()}
    many = {x.ann_id: x for x in cleaning.topk_similarity(crops, cen, max_numbers=12).collect()}
    assert one.keys() == many.keys()
    for k, x in one.items():
        assert [x[c] if isinstance(x[c], int) else pytest.approx(x[c]) for c in x.__fields__] == list(many[k])
        assert (x.gt_sim == -1.0) == (x.gt_cat >= 7)


def test_last_correction_wins(spark):
    anns = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "ann_id long, category_id int")
    corr = spark.createDataFrame([(1, 5, 8, 0), (1, 5, 9, 1), (3, 7, 7, 2)], "ann_id long, old_cat int, new_cat int, o int")
    assert {tuple(r) for r in cleaning.apply_corrections(anns, corr, "o").collect()} == {(1, 9, True), (2, 6, False), (3, 7, False)}


def test_medians_percentiles_and_gaps(spark):
    r = random.Random(6)
    for n in (1, 2, 7, 200):
        vals = [r.randrange(30) / 4 for _ in range(n)]
        df = spark.createDataFrame([(v, 1.0, v) for v in vals], "w double, h double, seconds double")
        assert audit.area_stats(df).first().median_area == sorted(vals)[n // 2]
        pos = (n - 1) * 0.95
        lo, hi = sorted(vals)[math.floor(pos)], sorted(vals)[math.ceil(pos)]
        assert audit.runtime_stats(df).first().p95_sec == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))
    ids = [1, 2, 3, 7, 8, 999_998, 1_000_002, 3_500_000]
    got = ranking.id_gaps(spark.createDataFrame([(i,) for i in ids], "k long"), "k").collect()
    assert sorted((g.previous_id, g.next_id) for g in got) == [(3, 7), (8, 999_998), (999_998, 1_000_002), (1_000_002, 3_500_000)]


def test_sanitize(spark):
    images = spark.createDataFrame([(1, "a", 100, 50)], IMG)
    rows = [(1, 1, 5, float("nan"), 0.0, 5.0, 5.0, 0.5), (2, 1, 5, -5.0, 45.0, 20.0, 20.0, 1.5), (3, 1, 99, 10.0, 10.0, 0.0, 5.0, 0.5), (4, 1, 99, 10.0, 10.0, 5.0, 5.0, -0.5)]
    got = detections.sanitize(spark.createDataFrame(rows, "pred_id long, image_id long, category_id int, x double, y double, w double, h double, score double"), images, 10)
    assert {(r.pred_id, r.category_id, r.x, r.y, r.w, r.h, r.score) for r in got.collect()} == {(2, 5, 0.0, 45.0, 20.0, 5.0, 1.0), (4, 0, 10.0, 10.0, 5.0, 5.0, 0.0)}


def test_ensemble_config_layouts(spark):
    new = predict.ensemble_config(spark, {"tta_flip": True, "models": [{"file": "x", "weight": 2}, {"name": "no file"}, {"file": "y", "tta_flip": False, "imgsz": 640}]})
    assert [tuple(r) for r in new.orderBy("model_id").collect()] == [(0, "A", "x", 1280, True, 2.0), (1, "C", "y", 640, False, 1.0)]
    old = predict.ensemble_config(spark, {"model_a": "x", "model_b": "y", "imgsz_b": 1536, "weights": [1.5], "tta_flip_models": [True]})
    assert [tuple(r) for r in old.orderBy("model_id").collect()] == [(0, "A", "x", 1280, True, 1.5), (1, "B", "y", 1536, False, 1.0)]


def test_batch_predict_runs_model_once_per_batch(spark):
    def factory():
        def score(pdf):
            import pandas as pd
            if (pdf["k"] == 13).any():
                raise RuntimeError("bad row")
            return pd.DataFrame({"n": [len(pdf)] * len(pdf)})
        return score
    df = spark.createDataFrame([(i,) for i in range(20)], "k long").coalesce(1)
    got = {r.k: (r.n, r.error) for r in predict.batch_predict(df, factory, "k", "n int", {"n": -1}, batch_size=10).collect()}
    assert got[0] == (10, None) and got[13] == (-1, "bad row") and got[15] == (1, None) and len(got) == 20


def test_rows_of_a_failed_batch_make_no_frame_of_their_own(monkeypatch):
    """A failed batch costs its model calls: one frame of answers, however many rows are tried alone."""
    def score(pdf):
        if (pdf["k"] % 3 == 0).any():
            raise RuntimeError(f"bad {len(pdf)}")
        return pdf[["k"]].rename(columns={"k": "n"})
    part = pd.DataFrame({"k": range(64)})
    joined = lambda *a, **k: pytest.fail("frames put together")
    monkeypatch.setattr(pd, "concat", joined)
    got = predict._answers(score, part, ["n"], {"n": None})
    assert [(None if pd.isna(n) else n, e) for n, e in zip(got["n"], got["error"], strict=True)] == [(None, "bad 1") if k % 3 == 0 else (k, None) for k in range(64)]
    got = predict._answers(lambda pdf: pdf.head(0).assign(n=1), part.head(2), ["n"], {"n": -1})
    assert got.values.tolist() == [[-1, "model returned another number of rows"]] * 2


def test_jitter_draws_four_numbers_a_try(spark, capsys):
    anns = spark.createDataFrame([(i, 1, 1, 10.0 * i, 5.0, 30.0, 20.0) for i in range(8)], ANN)
    out = sampling.jitter_boxes(anns, spark.createDataFrame([(1, "a.jpg", 400, 300)], IMG), pos=0.2, scale=0.25)
    out.explain()
    assert 0 < capsys.readouterr().out.count("md5(") <= 4
    assert out.count() > 8


def test_tiles_are_dealt_out_by_number(spark):
    """Tiles of many images are cut and counted by many tasks, however few bytes they take."""
    images = spark.range(3000).selectExpr("id AS image_id", "concat(id, '.jpg') AS file_name", "4000 AS width", "3000 AS height")
    anns = spark.createDataFrame([(1, 5, 1, 10.0, 10.0, 100.0, 100.0), (2, 5, 1, 2000.0, 900.0, 50.0, 50.0)], ANN)
    tiles = tiling.tile_counts(anns, images, 640, 480)
    held = tiles.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("n_annotations").alias("a")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(held) == parts and max(r.n for r in held) < 1.2 * sum(r.n for r in held) / parts
    assert sum(r.a for r in held) == tiling.tile_annotations(anns, images, 640, 480).count() > 0


def test_scatter_has_no_pattern(spark):
    n = 4000
    cols = [unit(F.col("id") * 4 + s, seed).alias(f"u{s}_{seed}") for s in range(4) for seed in (1, 2)]
    x = np.array(spark.range(n).select(*cols).toPandas())
    assert x.min() >= 0 and x.max() < 1 and np.abs(x.mean(0) - 0.5).max() < 0.03
    r = np.corrcoef(x.T) - np.eye(x.shape[1])
    assert np.abs(r).max() < 0.07
    assert np.abs(np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1]) < 0.07
    assert len(np.unique(x)) > x.size - 5


def test_rows_follow_paths_and_files(spark, tmp_path):
    short = [{"ann_id": 1, "old_cat": 5, "new_cat": 6}, {"ann_id": 1, "old_cat": 5, "new_cat": 7}]
    long = [{"ann_id": 1, "old_cat": 5, "new_cat": 8}] + [{"ann_id": k, "old_cat": 1, "new_cat": 2} for k in range(10, 400)]
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    for path, rows in ((a, short), (b, long)):
        (tmp_path / path).write_text(json.dumps(rows))
    for paths, winner in (([a, b], 8), ([b, a], 7)):
        read = readers.corrections_scan(spark, paths)
        last = ranking.last_wins(read.drop("source", "file"), ["ann_id"], "ordinal")
        assert last.where("ann_id = 1").first().new_cat == winner
    preds = [{"image_id": k, "category_id": 1, "bbox": [0, 0, 1, 1], "score": 0.5} for k in range(50)]
    (tmp_path / "p1.json").write_text(json.dumps(preds[:3]))
    (tmp_path / "p2.json").write_text(json.dumps(preds[3:]))
    got = readers.predictions_scan(spark, [str(tmp_path / "p1.json"), str(tmp_path / "p2.json")]).select("pred_id", "image_id").collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(50)]


def test_report_lists_keep_their_order_and_bound(spark, tmp_path):
    top = spark.createDataFrame([(i, (i * 7) % 10) for i in range(10)], "k int, v int").repartition(4)
    report = writers.json_report(spark.range(1).select(F.lit(3).alias("n")), top=4, best=(top, [F.col("v").desc()]))
    writers.write_report(report, str(tmp_path / "r"))
    text = next(p for p in (tmp_path / "r").glob("part-*")).read_text()
    assert [r["v"] for r in json.loads(text)["best"]] == [9, 8, 7, 6]


@pytest.mark.parametrize("before", [True, False])
def test_decoding_flips_before_or_after_the_clip(spark, before):
    raw = spark.createDataFrame([(1, 1, 20.0, 100.0, 80.0, 40.0, [0.1, 0.9]), (2, 1, 320.0, 320.0, 100.0, 60.0, [0.8, 0.1]), (3, 1, 9.0, 9.0, 1.0, 1.0, [0.1, 0.2])],
        "pred_id long, image_id long, cx double, cy double, w double, h double, class_scores array<double>")
    images = spark.createDataFrame([(1, 640, 640)], "image_id long, width int, height int")
    norm = {r.pred_id: [round(v * 640, 6) for v in (r.x1, r.y1, r.x2, r.y2)] for r in detections.decode_detections(raw, images, 640, 0.5, flipped=True, flip_before_clip=before).collect()}
    assert norm == {1: [580.0, 80.0, 640.0, 120.0], 2: [270.0, 290.0, 370.0, 350.0]}
    boxes = {r.pred_id: (r.category_id, r.x, r.w) for r in detections.decode_boxes(raw, images, 640, 0.5, flipped=True, flip_before_clip=before).collect()}
    # Clipped as a box, a corner left of the image moves without shrinking the width.
    assert boxes == {1: (1, 580.0, 60.0) if before else (1, 560.0, 80.0), 2: (0, 270.0, 100.0)}


def test_voters_see_every_row_once(spark, tmp_path):
    log = str(tmp_path / "seen")

    def voter(number):
        def factory():
            def vote(pdf):
                with open(f"{log}-{number}", "a") as f:
                    f.write("".join(f"{i}\n" for i in pdf["ann_id"]))
                if number == 2 and (pdf["ann_id"] == 3).any():
                    raise ValueError("x" * 300)
                return pdf.assign(match=True, reason="ok")[["match", "reason"]]
            return vote
        return factory

    seen = []

    def source(batches):
        for pdf in batches:
            with open(f"{log}-source", "a") as f:
                f.write("".join(f"{i}\n" for i in pdf["ann_id"]))
            yield pdf

    rows = spark.range(20).withColumnRenamed("id", "ann_id").mapInPandas(source, "ann_id bigint")
    got = {(r.ann_id, r.voter): (r.match, r.reason) for r in predict.multi_voter(rows, {1: voter(1), 2: voter(2)}, batch_size=5).collect()}
    assert len(got) == 40 and got[(3, 2)] == (None, "error: " + "x" * 50) and got[(4, 2)] == (True, "ok")
    seen = sorted(int(i) for i in open(f"{log}-source"))
    assert seen == list(range(20)) and sorted(int(i) for i in open(f"{log}-1")) == list(range(20))
    failed = predict.batch_predict(rows, voter(2), "ann_id", "match boolean, reason string", {"match": None, "reason": None}).where("error IS NOT NULL").collect()
    assert [(r.ann_id, r.error) for r in failed] == [(3, "x" * 300)]


def test_stages_have_their_own_statistics(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", None), ("c", None)]
    got = {r.stage: (r.mean_sec, r.p95_sec, r.max_sec) for r in audit.runtime_stats(spark.createDataFrame(rows, "stage string, seconds double"), stage="stage").collect()}
    assert got == {"a": (2.0, pytest.approx(2.9), 3.0), "b": (10.0, 10.0, 10.0), "c": (None, None, None)}

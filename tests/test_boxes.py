"""Order-dependent operators against plain-Python definitions, in both of their ways."""

import random

import pytest
from pyspark.sql import functions as F

from boxlore import session
from boxlore.operators import fusion, matching, metrics, ranking, spatial, suppression
from tests import brute


def make(seed, images=4, n=60, m=25, span=1500, classes=2, models=3):
    r = random.Random(seed)
    gts, preds = [], []
    for i in range(images):
        for _ in range(m):
            gts.append((len(gts), i, r.randrange(classes), float(r.randrange(span)), float(r.randrange(span)), float(r.randrange(80, 700)), float(r.randrange(80, 400))))
        for _ in range(n):
            _, _, c, x, y, w, h = gts[-1 - r.randrange(m)]
            jit = lambda: r.randrange(-60, 60)
            preds.append((len(preds), r.randrange(models), i, c if r.random() < 0.8 else r.randrange(classes), x + jit(), y + jit(), w + jit() / 2, h + jit() / 2, r.randrange(40) / 40))
    # exact copies with equal and different scores
    for p in preds[:20]:
        preds.append((len(preds), *p[1:8], r.choice([p[8], 0.5])))
    return preds, gts


PRED = "pred_id long, model_id int, image_id long, category_id int, x double, y double, w double, h double, score double"
GT = "gt_id long, image_id long, category_id int, x double, y double, w double, h double"


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


@pytest.mark.parametrize("seed,fold_limit,hot_rows", [(1, 2000, 5000), (2, 0, 5000), (3, 5, 1), (4, 2000, 3)])
@pytest.mark.parametrize("by_class", [False, True])
def test_greedy_match(spark, seed, fold_limit, hot_rows, by_class):
    preds, gts = make(seed)
    keys = ["image_id", "category_id"] if by_class else ["image_id"]
    got = matching.greedy_match(spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT), 0.4, keys, fold_limit=fold_limit, hot_rows=hot_rows, cell=300)
    got = {(r.pred_id, r.gt_id) for r in got.collect()}
    pk = (lambda p: (p[2], p[3])) if by_class else (lambda p: p[2])
    gk = (lambda g: (g[1], g[2])) if by_class else (lambda g: g[1])
    truth = groups(gts, gk)
    want = set()
    for k, ps in groups(preds, pk).items():
        want |= set(brute.match([(p[0], p[8], p[4:8]) for p in ps], [(g[0], g[3:7]) for g in truth.get(k, [])], 0.4).items())
    assert got == want and want


@pytest.mark.parametrize("seed,fold_limit,hot_rows", [(1, 2000, 5000), (2, 0, 5000), (3, 2000, 4), (4, 0, 2)])
def test_nms(spark, seed, fold_limit, hot_rows):
    preds, _ = make(seed, n=80, m=12)
    got = suppression.nms(spark.createDataFrame(preds, PRED), 0.45, fold_limit=fold_limit, hot_rows=hot_rows, cell=300)
    want = set()
    for ps in groups(preds, lambda p: (p[2], p[3])).values():
        want |= brute.nms([(p[0], p[8], p[4:8]) for p in ps], 0.45)
    assert {r.pred_id for r in got.collect()} == want


def test_nms_pile_of_near_copies(spark):
    r = random.Random(5)
    preds = [(i, 0, 7, 1, 100 + r.random(), 200 + r.random(), 300.0, 250.0, r.random()) for i in range(3000)]
    preds += [(3000 + i, 0, 7, 1, 900.0 + 5 * i, 100.0, 60.0, 60.0, r.random()) for i in range(60)]
    got = suppression.nms(spark.createDataFrame(preds, PRED), 0.5, hot_rows=100)
    assert {x.pred_id for x in got.collect()} == brute.nms([(p[0], p[8], p[4:8]) for p in preds], 0.5)


@pytest.mark.parametrize("best_fit", [True, False])
@pytest.mark.parametrize("hot_rows", [20000, 0])
def test_fusion(spark, best_fit, hot_rows):
    preds, _ = make(9, images=3, n=70, m=10, span=2500)
    preds = [p for p in preds if p[8] > 0]
    df = spark.createDataFrame(preds, PRED)
    weights = [1.0, 1.5, 2.0] if best_fit else [1.0, 1.0, 1.0]
    want = []
    for (img, cat), ps in groups(preds, lambda p: (p[2], p[3])).items():
        rows = sorted(((p[8] * weights[p[1]], p[1], p[4:8], p[0]) for p in ps), key=lambda t: (-t[0], t[3]))
        for c in brute.fuse([t[:3] for t in rows], 0.5, best_fit):
            tw = sum(rows[j][0] for j in c)
            centre = [sum(rows[j][0] * rows[j][2][k] for j in c) / tw for k in range(4)]
            seen = len(c) if best_fit else len({rows[j][1] for j in c})
            score = tw / len(c) * min(seen, 3) / (sum(weights) if best_fit else 3)
            want.append((img, cat, *[round(v, 5) for v in centre], round(score, 5), len(c)))
    if best_fit:
        got = fusion.wbf_weighted(df, weights, 0.5, hot_rows=hot_rows)
    else:
        got = fusion.wbf_sequential(df, 3, 0.5, source="model_id", hot_rows=hot_rows)
    got = [(r.image_id, r.category_id, *[round(v, 5) for v in (r.x, r.y, r.w, r.h, r.score)], r.members) for r in got.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("hot_rows", [20000, 0])
def test_fused_ids_are_those_of_the_first_members(spark, hot_rows):
    preds = [(i, 0, 1, 3, 600.0 * (i % 8), 700.0 * (i // 8), 100.0, 80.0, 0.5) for i in range(40)]
    preds += [(100 + i, 1, 1, 3, 600.0 * (i % 8) + 2, 700.0 * (i // 8), 100.0, 80.0, 0.5) for i in range(40)]
    preds += [(200, 0, 1, 3, 50.0, 50.0, 0.0, 5.0, 0.9), (201, 1, 1, 3, 50.0, 50.0, 0.0, 5.0, 0.8)]
    df = spark.createDataFrame(preds, PRED)
    fused = fusion.wbf_weighted(df, [1.0, 1.0], 0.5, hot_rows=hot_rows).collect()
    assert sorted((r.pred_id, r.members) for r in fused) == [(i, 2) for i in range(40)]
    first_fit = fusion.wbf_sequential(df, 2, 0.5, source="model_id", hot_rows=hot_rows)
    assert sorted(r.pred_id for r in first_fit.collect()) == [*range(40), 200, 201]
    capped = ranking.cap_per_group(first_fit.where("pred_id < 200"), ["image_id"], [F.col("score").desc(), F.col("pred_id").asc()], 5)
    assert sorted(r.pred_id for r in capped.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("cell", [64, 512, 5000])
def test_best_overlap_and_cells(spark, cell):
    preds, gts = make(11)
    rows = spatial.best_overlap(spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT), cell=cell).collect()
    assert len(rows) == len(gts)
    for r in rows:
        box = (r.x, r.y, r.w, r.h)
        options = [(-brute.iou(box, p[4:8]), p[0]) for p in preds if p[2] == r.image_id]
        best = min(options)
        assert (r.pred_id, pytest.approx(r.iou)) == ((best[1], -best[0]) if best[0] < 0 else (None, 0.0))


def test_ranked_matches_one_window(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(3), r.randrange(5) / 5, r.randrange(2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int, score double, v int")
    got = ranking.ranked(df, ["g"], [F.col("score").desc(), F.col("id").asc()], {"v": "total"}, slices=7).collect()
    for g in range(3):
        want = sorted([x for x in rows if x[1] == g], key=lambda x: (-x[2], x[0]))
        seen = {x.id: (x.rank, x.total) for x in got if x.g == g}
        total = 0
        for i, x in enumerate(want, 1):
            total += x[3]
            assert seen[x[0]] == (i, total)


def test_average_precision_random(spark):
    r = random.Random(8)
    rows, n_gt, want = [], [], {}
    for k in range(6):
        flags = [int(r.random() < 0.6) for _ in range(r.randrange(1, 60))]
        truth = sum(flags) + r.randrange(0, 10)
        n_gt.append((k, truth))
        want[k] = brute.ap(flags, truth)
        rows += [(k, 0, i, 1 - i / 100, f) for i, f in enumerate(flags)]
    n_gt += [(6, 4)]
    want[6] = 0.0
    got = metrics.average_precision(
        spark.createDataFrame(rows, "k int, image_id long, pred_id long, score double, is_tp int"), spark.createDataFrame(n_gt, "k int, n_gt long"), ["k"])
    assert {x.k: pytest.approx(x.ap) for x in got.collect()} == want


def test_recall_thresholds_compare_products(spark):
    for num, den in [(7, 20), (29, 100), (57, 100), (1, 1), (0, 3), (58, 100), (35, 100)]:
        v = num / den
        got = spark.range(1).select(metrics.thresholds_reached(F.lit(v)).alias("k")).first().k
        assert got == sum(v >= i * 0.01 for i in range(101)), v


def box(image, cat, x, y, w, h, score=None, idx=0):
    return (idx, 0, image, cat, float(x), float(y), float(w), float(h), score) if score is not None else (idx, image, cat, float(x), float(y), float(w), float(h))


CASES = {
    "perfect": ([(1, 0, 10, 10, 50, 50, 0.9)], [(1, 0, 10, 10, 50, 50)], 1.0, 1.0),
    "wrong class": ([(1, 1, 10, 10, 50, 50, 0.9)], [(1, 0, 10, 10, 50, 50)], 1.0, 0.0),
    "duplicates": ([(1, 0, 10, 10, 50, 50, 0.9), (1, 0, 11, 11, 50, 50, 0.8)], [(1, 0, 10, 10, 50, 50)], 1.0, 1.0),
    "fp above tp": ([(1, 0, 500, 500, 50, 50, 0.95), (1, 0, 10, 10, 50, 50, 0.9)], [(1, 0, 10, 10, 50, 50)], 0.5, 0.5),
    "low iou": ([(1, 0, 45, 45, 50, 50, 0.9)], [(1, 0, 10, 10, 50, 50)], 0.0, 0.0),
    "no predictions": ([], [(1, 0, 10, 10, 50, 50)], 0.0, 0.0),
    "no truth": ([(1, 0, 10, 10, 50, 50, 0.9)], [], 0.0, 0.0),
    "misses": ([(1, 0, 0, 0, 50, 50, 0.9)], [(1, 0, 0, 0, 50, 50), (1, 0, 100, 0, 50, 50), (1, 0, 200, 0, 50, 50)], 34 / 101, 34 / 101),
    "mixed": ([(1, 0, 0, 0, 50, 50, 0.9), (1, 1, 100, 0, 50, 50, 0.8)], [(1, 0, 0, 0, 50, 50), (1, 1, 100, 0, 50, 50), (1, 2, 200, 0, 50, 50)], 67 / 101, 2 / 3),
    "iou exactly at the threshold": ([(1, 0, 0, 0, 100, 50, 0.9)], [(1, 0, 0, 0, 50, 50)], 1.0, 1.0),
}


@pytest.mark.parametrize("name", CASES)
def test_scores_of_known_cases(spark, name):
    preds, gts, det, cls = CASES[name]
    p = spark.createDataFrame([box(*x, idx=i) for i, x in enumerate(preds)], PRED)
    g = spark.createDataFrame([box(*x, idx=i) for i, x in enumerate(gts)], GT)
    row = metrics.hybrid_score(p, g).first()
    assert row.detection_map == pytest.approx(det) and row.classification_map == pytest.approx(cls)
    assert row.hybrid == pytest.approx(0.7 * det + 0.3 * cls)


def test_result_does_not_depend_on_partitions(spark):
    preds, gts = make(21)
    p, g = spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT)
    seen = set()
    for n in ("1", "2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(round(v, 12) for v in metrics.hybrid_score(p, g).first()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_greedy_match_streams_what_rounds_leave(spark, monkeypatch):
    monkeypatch.setattr(matching, "WORTHWHILE", 1.1)  # no round ever counts as worthwhile
    preds, gts = make(6, images=2)
    got = matching.greedy_match(spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT), 0.3, fold_limit=0)
    want = set()
    for k in range(2):
        want |= set(brute.match([(p[0], p[8], p[4:8]) for p in preds if p[2] == k], [(g[0], g[3:7]) for g in gts if g[1] == k], 0.3).items())
    assert {(r.pred_id, r.gt_id) for r in got.collect()} == want and want


@pytest.mark.parametrize("name", ["nms", "sequential", "weighted", "suppress_then_fuse", "hybrid"])
def test_inputs_are_evaluated_once_and_nothing_stays(spark, tmp_path, name):
    preds, gts = make(31, images=2, n=20, m=8)
    log = tmp_path / "seen"

    def source(batches):
        for pdf in batches:
            with open(log, "a") as f:
                f.write("".join(f"{i}\n" for i in pdf["pred_id"]))
            yield pdf

    df = spark.createDataFrame(preds, PRED).mapInPandas(source, PRED)
    run = {
        "nms": lambda: suppression.nms(df, 0.5),
        "sequential": lambda: fusion.wbf_sequential(df, 3, 0.5, source="model_id"),
        "weighted": lambda: fusion.wbf_weighted(df, [1.0, 1.0, 1.0], 0.5),
        "suppress_then_fuse": lambda: fusion.nms_then_wbf(df.withColumn("pass_id", F.col("model_id")), 3, 0.5, 0.5),
        "hybrid": lambda: metrics.hybrid_score(df, spark.createDataFrame(gts, GT)),
    }[name]
    session.release(spark)
    tables = lambda: {t.tableName for t in spark.sql(f"SHOW TABLES IN {session.SCRATCH}").collect() if not t.isTemporary}
    before = tables() if spark.catalog.databaseExists(session.SCRATCH) else set()
    assert run().collect()
    assert sorted(map(int, log.read_text().split())) == sorted(p[0] for p in preds)
    session.release(spark)
    assert tables() == before


@pytest.mark.parametrize("limits", [{"fold_limit": 0}, {"fold_limit": 0, "hot_rows": 0}])
def test_suppression_of_long_chains_takes_few_jobs(spark, limits):
    jobs = []
    for n in (40, 200):
        preds = [(i, 0, 1, 1, 20.0 * i, 0.0, 60.0, 50.0, 1 - i / 1000) for i in range(n)]
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        got = suppression.nms(spark.createDataFrame(preds, PRED), 0.4, **limits).collect()
        assert {r.pred_id for r in got} == brute.nms([(p[0], p[8], p[4:8]) for p in preds], 0.4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}")))
    assert jobs[1] <= jobs[0] + 10


def test_predictions_without_a_match_stay_spread(spark):
    """They have no ground-truth id, and must not meet as one key."""
    preds = spark.range(4000).selectExpr("id AS pred_id", "0 AS model_id", "id % 50 AS image_id", "1 AS category_id", "5000D AS x", "id * 1D AS y", "10D AS w", "10D AS h", "0.5D AS score")
    gts = spark.createDataFrame([(1, 0, 1, 5000.0, 0.0, 10.0, 10.0), (2, 0, 2, 5000.0, 50.0, 10.0, 10.0), (3, 0, 2, 0.0, 0.0, 10.0, 10.0)], GT)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        status = matching.match_status(preds, gts)
        held = status.where("status = 'fp'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        rest = sorted((-1 if r.pred_id is None else r.pred_id, r.gt_id, r.status) for r in status.where("status <> 'fp'").collect())
        session.release(spark)
    assert rest == [(-1, 3, "missed"), (0, 1, "tp"), (50, 2, "wrong_class")]
    assert sum(r["count"] for r in held) == 3998 and max(r["count"] for r in held) < 2000

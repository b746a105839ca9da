"""Many settings at once, units of work, and boxes of any scale, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from boxlore.operators import cleaning, components, fusion, matching, metrics, settings, suppression
from boxlore.plans import sweeps
from boxlore.session import Scratch
from tests import brute
from tests.test_boxes import GT, PRED, groups, make

SCALES = {"fractions": (1 / 4000, 0.0), "negative": (1.0, -5000.0), "far": (1.0, 2_000_000.0), "tiny": (1e-6, 0.0)}


def moved(rows, at, scale):
    factor, shift = SCALES[scale]
    return [(*r[:at], r[at] * factor + shift, r[at + 1] * factor + shift, r[at + 2] * factor, r[at + 3] * factor, *r[at + 4 :]) for r in rows]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300) if i % 37] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    with Scratch(spark) as own:
        for local in (0, 60, 10**6):  # rounds alone, rounds and a task, a task alone
            got = components.components(spark.createDataFrame(links, "a long, b long"), own, local=local).collect()
            assert {x.id: x.component for x in got} == {i: root(i) for i in up} and len(own.names) <= 2
            own.close()
        assert components.components(spark.createDataFrame([], "a long, b long"), own).count() == 0


@pytest.mark.parametrize("scale", SCALES)
def test_joins_of_any_scale(spark, scale):
    preds, gts = make(6, images=2, n=60, m=20)
    big = (len(preds), 0, 0, 0, -50.0, -50.0, 3000.0, 3000.0, 0.99)
    preds, gts = moved([*preds, big], 4, scale), moved([*gts, (len(gts), 0, 0, 0.0, 0.0, 2500.0, 2600.0)], 3, scale)
    got = {(r.pred_id, r.gt_id) for r in matching.greedy_match(spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT), 0.4).collect()}
    want = set()
    for k, ps in groups(preds, lambda p: p[2]).items():
        want |= set(brute.match([(p[0], p[8], p[4:8]) for p in ps], [(g[0], g[3:7]) for g in gts if g[1] == k], 0.4).items())
    assert got == want and len(want) > 20
    # The smoothing in the denominator of suppression is an absolute area, so it is told by the same formula.
    kept = {r.pred_id for r in suppression.nms(spark.createDataFrame(preds, PRED), 0.45, hot_rows=5).collect()}
    assert kept == set().union(*(brute.nms([(p[0], p[8], p[4:8]) for p in ps], 0.45) for ps in groups(preds, lambda p: (p[2], p[3])).values()))


@pytest.mark.parametrize("scale,hot_rows", [("fractions", 0), ("negative", 20000), ("far", 0), ("tiny", 20000)])
def test_fusion_of_any_scale(spark, scale, hot_rows):
    preds, _ = make(12, images=2, n=60, m=8, span=3000, classes=1)
    preds = moved([p for p in preds if p[8] > 0], 4, scale)
    want = []
    for img, ps in groups(preds, lambda p: p[2]).items():
        rows = sorted(((p[8], p[1], p[4:8], p[0]) for p in ps), key=lambda t: (-t[0], t[3]))
        want += [(img, rows[c[0]][3], len(c)) for c in brute.fuse([t[:3] for t in rows], 0.5, True)]
    got = fusion.wbf_weighted(spark.createDataFrame(preds, PRED), [1.0, 1.0, 1.0], 0.5, hot_rows=hot_rows)
    assert sorted((r.image_id, r.pred_id, r.members) for r in got.collect()) == sorted(want)


def test_a_crowded_image_is_many_units(spark):
    r = random.Random(4)
    preds = [(i, 0, 1, 1, 500.0 * (i % 40) + r.random() * 60, 400.0 * (i // 40 % 10) + r.random() * 60, 150.0, 120.0, r.random()) for i in range(2000)]
    # A chain whose mean boxes wander: hulls touch where members do not.
    preds += [(5000 + i, 0, 1, 1, -1000.0 - 40 * i, 50.0 * (i % 3), 90.0, 300.0, r.random()) for i in range(40)]
    df = spark.createDataFrame(preds, PRED)
    units = fusion.hull_units(df, ["image_id", "category_id"]).groupBy("_unit").agg(
        F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2")).collect()
    assert sum(u.n for u in units) == len(preds) and len(units) == 401
    assert not any(a is not b and min(a.x2, b.x2) > max(a.x, b.x) and min(a.y2, b.y2) > max(a.y, b.y) for a in units for b in units)
    whole, cut = (sorted(tuple(x) for x in fusion.wbf_weighted(df, [1.0], 0.55, hot_rows=n).collect()) for n in (10**6, 0))
    assert [x[:3] for x in whole] == [x[:3] for x in cut] and all(a == pytest.approx(b) for a, b in zip(whole, cut, strict=True))


def test_walks_by_component(spark):
    chains = [(1, 100 * c + i, 100 * c + i + d, 1 - (100 * c + i) / 10_000, 0.9 - d / 10) for c in range(30) for i in range(20) for d in (0, 1)]
    pairs = spark.createDataFrame(chains, "image_id long, pred_id long, gt_id long, score double, iou double")
    whole, cut = (sorted(map(tuple, matching._walk(pairs, ["image_id"], limit).collect())) for limit in (10**6, 0))
    assert whole == cut and len(whole) == 600
    with Scratch(spark) as own:
        hot = pairs.select("image_id").distinct()
        assert components.in_units(pairs, hot, ["image_id"], ["pred_id"], ["gt_id"], own).select("_unit").distinct().count() == 30
        edges = pairs.select("image_id", F.col("pred_id").alias("hi"), (F.col("pred_id") + 1).alias("lo"), F.col("score").alias("s")).distinct()
        assert components.in_units(edges, hot, ["image_id"], ["hi"], ["lo"], own, one_kind=True).select("_unit").distinct().count() == 30
    lost = [sorted(map(tuple, suppression._walk(edges, ["image_id"], limit).collect())) for limit in (10**6, 0)]
    assert lost[0] == lost[1] and len(lost[0]) == 300


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 3, "limit": 0}])
def test_suppression_under_many_thresholds(spark, limits):
    preds, _ = make(7, images=3, n=90, m=8)
    thresholds = [0.3, 0.45, 0.6, 0.75]
    got = {r.pred_id: r._s for r in settings.suppress_settings(spark.createDataFrame(preds, PRED), thresholds, **limits).collect()}
    assert got.keys() == {p[0] for p in preds}
    for j, t in enumerate(thresholds):
        want = set().union(*(brute.nms([(p[0], p[8], p[4:8]) for p in ps], t) for ps in groups(preds, lambda p: (p[2], p[3])).values()))
        assert {i for i, s in got.items() if s >> j & 1} == want


def score(preds, gts):
    """Hybrid score of (id, image, class, box, score) rows by definition."""
    flags, by_class = [], {}
    for img in {p[1] for p in preds}:
        mine = [p for p in preds if p[1] == img]
        hit = brute.match([(p[0], p[4], p[3]) for p in mine], [(g[0], g[3:7]) for g in gts if g[1] == img], 0.5)
        flags += [(-p[4], img, p[0], int(p[0] in hit)) for p in mine]
        for c in {p[2] for p in mine}:
            own = [p for p in mine if p[2] == c]
            hit = brute.match([(p[0], p[4], p[3]) for p in own], [(g[0], g[3:7]) for g in gts if g[1] == img and g[2] == c], 0.5)
            by_class.setdefault(c, []).extend((-p[4], img, p[0], int(p[0] in hit)) for p in own)
    ap = lambda rows, n: brute.ap([f[-1] for f in sorted(rows)], n)
    classes = {g[2] for g in gts}
    return 0.7 * ap(flags, len(gts)) + 0.3 * sum(ap(by_class.get(c, []), sum(g[2] == c for g in gts)) for c in classes) / len(classes)


def data(spark, seed=8):
    preds, gts = make(seed, images=3, n=40, m=15)
    return preds, gts, spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT)


@pytest.mark.parametrize("rows", [1 << 20, 20])
def test_threshold_sweep(spark, rows, monkeypatch):
    monkeypatch.setattr(settings, "ROWS", rows)  # many slices of a curve
    monkeypatch.setattr(settings, "CELLS", 64 if rows == 20 else 1 << 21)
    preds, gts, p, g = data(spark)
    got = sweeps.threshold_sweep(p, g, [0.1, 0.4, 0.98], [0.3, 0.6], hot_rows=5 if rows == 20 else 5000).collect()
    assert len(got) == 6
    for r in got:
        sure = [x for x in preds if x[8] >= r.conf]
        kept = set().union(*(brute.nms([(x[0], x[8], x[4:8]) for x in ps], r.nms_iou) for ps in groups(sure, lambda x: (x[2], x[3])).values()))
        left = [(x[0], x[2], x[3], x[4:8], x[8]) for x in sure if x[0] in kept]
        assert r.n_preds == len(left) and r.hybrid == pytest.approx(score(left, gts))


def test_policy_sweep_has_three_outcomes_at_most(spark):
    preds, gts, p, g = data(spark)
    dets = p.withColumns({"cls": ((F.col("pred_id") * 7) % 3).cast("int"), "cls_conf": (F.col("pred_id") * 37 % 100) / 100})
    cls_ts, det_ts = [0.3, 0.5, 0.7, 0.8], [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98]
    grid = [("none", 0.0, 0.0), *sweeps.policy_grid(cls_ts, det_ts)]
    assert len(grid) > 64  # more than one word of bits
    seen = []
    real = settings.numbered
    try:
        settings.numbered = lambda rows: seen.append(real(rows)) or seen[-1]
        got = sweeps.policy_sweep(dets, g, cls_ts, det_ts).collect()
    finally:
        settings.numbered = real
    assert len(got) == len(grid) and seen[0].count() <= 3 * len(preds)
    answers = {r.pred_id: (r.cls, r.cls_conf) for r in dets.collect()}
    by = {(r.policy, r.cls_t, r.det_t): r for r in got}
    base = score([(x[0], x[2], x[3], x[4:8], x[8]) for x in preds], gts)
    for policy, c, d in (grid[0], grid[1], grid[3], grid[7], grid[12], grid[-1]):
        rows = []
        for x in preds:
            cls, conf = answers[x[0]]
            take = policy == "A" or policy in ("B", "C") and conf >= c or policy in ("D", "E") and conf >= c and x[8] < d
            rows.append((x[0], x[2], cls if take else x[3], x[4:8], x[8] * conf if policy == "C" and conf >= c else x[8]))
        r = by[policy, c, d]
        assert r.hybrid == pytest.approx(score(rows, gts)) and r.delta == pytest.approx(r.hybrid - base)


@pytest.mark.parametrize("hot_rows", [20000, 0])
def test_wbf_sweep(spark, hot_rows):
    preds, gts, p, g = data(spark)
    confs, ious, weights, caps = [0.05, 0.5], [0.4, 0.6], [[1.0, 1.0, 1.0], [1.0, 2.0, 0.5]], [5, 100]
    got = {(r.conf, r.wbf_iou, tuple(r.weights), r.max_preds): r for r in sweeps.wbf_sweep(p, g, confs, ious, weights, caps, hot_rows=hot_rows).collect()}
    assert len(got) == 16
    for (conf, t, w, cap), r in got.items():
        fused = []
        for (img, cat), ps in groups([x for x in preds if x[8] >= conf], lambda x: (x[2], x[3])).items():
            rows = sorted(((x[8] * w[x[1]], x[1], x[4:8], x[0]) for x in ps), key=lambda v: (-v[0], v[3]))
            for c in brute.fuse([v[:3] for v in rows], t, True):
                total = sum(rows[j][0] for j in c)
                box = tuple(sum(rows[j][0] * rows[j][2][k] for j in c) / total for k in range(4))
                fused.append((rows[c[0]][3], img, cat, box, total / len(c) * (min(len(c), 3) / sum(w))))
        kept = [x for rows in groups(fused, lambda x: x[1]).values() for x in sorted(rows, key=lambda x: (-x[4], x[0]))[:cap]]
        assert r.n_preds == len(kept) and r.hybrid == pytest.approx(score(kept, gts), abs=1e-9)


def test_no_detections_and_no_truth(spark):
    _, gts, p, g = data(spark)
    none = sweeps.threshold_sweep(p.where("false"), g, [0.1], [0.5]).collect()
    assert [(r.hybrid, r.n_preds) for r in none] == [(0.0, 0)]
    empty = sweeps.threshold_sweep(p, g.where("false"), [0.1], [0.5]).collect()
    assert empty[0].hybrid == 0.0 and empty[0].n_preds > 0


def test_blocks_of_references_have_a_bound(spark):
    """Class numbers that are all multiples of the number of blocks still fall into even blocks."""
    r = random.Random(6)
    crops = spark.createDataFrame([(i, 4 * (i % 12), [r.gauss(0, 1) for _ in range(6)]) for i in range(60)], "ann_id long, category_id int, embedding array<float>")
    cen = cleaning.reference_centroid(crops.where("ann_id < 40").select("category_id", "embedding"))
    one = {x.ann_id: x for x in cleaning.topk_similarity(crops, cen).collect()}
    many = {x.ann_id: x for x in cleaning.topk_similarity(crops, cen, max_numbers=18).collect()}
    assert one.keys() == many.keys() and len({x.top1_cat for x in one.values()}) > 5
    for k, x in one.items():
        assert [x[c] if isinstance(x[c], int) else pytest.approx(x[c]) for c in x.__fields__] == list(many[k])
    with pytest.raises(ValueError, match="centroids"):
        cleaning.topk_similarity(crops, cen.where("false"))


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_matching_of_settings_is_one_stream(spark, capsys):
    """Outcomes and pairs are sent once to where they meet: no join, and no second exchange."""
    preds, gts, p, g = data(spark)
    outcomes = settings.numbered(p.withColumns({"_box": F.col("pred_id"), "_b0": F.lit(1).cast("bigint")}))
    flagged = settings.match_settings(outcomes, sweeps._met(p, g, 0.5, "pred_id"), 1)
    plan = plan_of(flagged, capsys)
    assert "Join" not in plan and plan.count("Exchange") == 1
    cut = [settings.match_settings(outcomes, sweeps._met(p, g, 0.5, "pred_id"), 1, limit=n).collect() for n in (10**6, 0)]
    assert sorted(cut[0]) == sorted(cut[1]) and len(cut[0]) == len(preds) and 0 < sum(r._t0 for r in cut[0]) < len(preds)


def test_outcomes_of_a_box_match_alike_in_one_row(spark, capsys):
    """A box that is sent once with its scores matches as its outcomes do apart."""
    preds, gts, p, g = data(spark)
    bit = lambda k, score: p.withColumns({"score": score, "_b0": F.lit(1 << k).cast("bigint")})
    flat = bit(0, F.col("score")).unionByName(bit(1, F.col("score"))).unionByName(bit(2, F.col("score") / 2).where("pred_id % 3 = 0"))
    flat = flat.unionByName(bit(2, F.col("score")).where("pred_id % 3 = 1")).unionByName(bit(0, F.lit(None).cast("double")).where("pred_id = 4"))
    listed = settings.numbered(settings.by_box(flat, 3)).withColumn("_box", F.col("_o"))
    assert listed.count() == len(preds) and listed.agg(F.max(F.size("_scores"))).first()[0] >= 2
    same = ["image_id", "category_id", "pred_id", *"xywh", "score"]
    apart = settings.numbered(flat.groupBy(*same).agg(F.bit_or("_b0").alias("_b0"))).withColumn("_box", F.col("_o"))
    flagged = settings.match_settings(listed, sweeps._met(listed.withColumn("score", F.lit(0.0)), g, 0.5, "_box"), 3)
    plan = plan_of(flagged, capsys)
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    want = sorted(map(repr, settings.match_settings(apart, sweeps._met(apart, g, 0.5, "_box"), 3).collect()))
    assert sorted(map(repr, flagged.collect())) == want
    cut = settings.match_settings(listed, sweeps._met(listed.withColumn("score", F.lit(0.0)), g, 0.5, "_box"), 3, limit=0)
    assert sorted(map(repr, cut.collect())) == want


def test_passes_are_compared_where_they_are_stored(spark, capsys, monkeypatch):
    """Suppression and fusion of boxes stored in buckets of images send no row, and store none again."""
    preds, gts, p, g = data(spark)
    own = settings.owner(spark)
    dets = p.withColumnRenamed("model_id", "pass_id")
    kept = own.keep(dets.repartition(4, "image_id"), ("image_id", 4))
    before = len(own.names)
    some = kept.where("pass_id < 2")
    for method in ("nms", "concat_nms", "wbf", "nms_then_wbf"):
        before = len(own.names)
        here = fusion.dispatch(some, method, 2, stored=True, buckets=("image_id", 4))
        assert "Exchange" not in plan_of(here, capsys) and len(own.names) == before + (method == "nms_then_wbf")
        there = fusion.dispatch(dets.where("pass_id < 2"), method, 2)
        assert plan_of(there, capsys).count("Exchange") == 1
        assert sorted(map(repr, here.collect())) == sorted(map(repr, there.collect()))
    ways = [("nms", 1), ("concat_nms", 2), ("wbf", 2), ("nms_then_wbf", 3)]
    want = [metrics.hybrid_score(fusion.dispatch(dets.where(F.col("pass_id") < n), method, n), g).first().hybrid for method, n in ways]
    for limit in (settings.HOT_FUSION, 0):  # in buckets of images, and not
        monkeypatch.setattr(settings, "HOT_FUSION", limit)
        got = {r.config_id: r for r in sweeps.tta_compare(dets, g, ways).collect()}
        assert [got[i].hybrid for i in range(4)] == pytest.approx(want) and [got[i].delta for i in range(4)] == pytest.approx([x - want[0] for x in want])


def test_groups_are_counted_where_a_first_key_is_large(spark):
    rows = [(i % 3, i % 2 if i % 3 else 0) for i in range(60)] + [(None, 7)] * 25
    df = spark.createDataFrame(rows, "a int, b int")
    large = lambda limit: sorted(map(tuple, settings.hot_groups(df, ["a", "b"], limit).collect()), key=repr)
    assert settings.hot_groups(df, ["a", "b"], 25) is None and large(20) == [(None, 7)] and large(19) == [(0, 0), (None, 7)]


def test_slices_of_a_curve_are_read_where_they_lie(spark, capsys):
    """Both curves read one stored order, slice by slice, without another exchange of its rows."""
    preds, gts, p, g = data(spark)
    seen, real = [], settings.owner
    with pytest.MonkeyPatch.context() as patch:
        class Noted:
            def __init__(self, own):
                self.own = own

            def keep(self, df, *buckets):
                seen.append(self.own.keep(df, *buckets))
                return seen[-1]

        patch.setattr(settings, "owner", lambda s: Noted(real(s)))
        flagged = settings.materialise(p.select("image_id", "category_id", "pred_id", "score", *[F.lit(1).cast("bigint").alias(c) for c in ("_b0", "_t0", "_c0")]))
        per_class = settings.truth_counts(g, ["category_id"])
        settings.curves(flagged, per_class, per_class.agg(F.sum("n_gt").alias("n_gt")), 1)
    cut = seen[-1]
    assert "Exchange" not in plan_of(cut.groupBy("_slice").applyInArrow(settings._totals(1), "_slice int, _curve int, _group bigint, config_id int, n bigint, t bigint"), capsys)


def test_outcomes_of_policies_are_those_of_every_setting(spark):
    grid = [("none", 0.0, 0.0), *sweeps.policy_grid([0.3, 0.5, 0.7, 0.8], [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98])]
    rows = [(i, 0, c, s, cls, conf) for i, (c, s, cls, conf) in enumerate(
        (c, s, cls, conf) for c in (1, 2, None) for s in (0.0, 0.55, 0.9, None, float("nan")) for cls in (1, None) for conf in (0.2, 0.5, 0.75, 1.0, None))]
    boxes = spark.createDataFrame(rows, "pred_id long, image_id long, category_id int, score double, cls int, cls_conf double")
    got = {}
    for r in sweeps._policy_outcomes(boxes, grid).collect():
        for k in range(len(grid)):
            if (r[f"_b{k // 64}"] >> k % 64) & 1:
                assert (r.pred_id, k) not in got
                got[r.pred_id, k] = repr((r.category_id, r.score))
    want = {}
    for k, (policy, c, d) in enumerate(grid):
        category, score_ = fusion.fuse_class(policy, float(c), float(d))
        for r in boxes.select("pred_id", category.alias("c"), score_.alias("s")).collect():
            want[r.pred_id, k] = repr((r.c, r.s))
    assert got == want and len(grid) > 64


def test_suppression_of_ordinary_groups_sends_rows_once(spark, capsys, monkeypatch):
    preds, _ = make(9, images=3, n=90, m=8)
    odd = [(900, 0, None, 1, 0.0, 0.0, 9.0, 9.0, 0.5), (901, 0, None, 1, 0.0, 0.0, 9.0, 9.0, 0.4), (902, 0, 1, 1, 5.0, 5.0, 30.0, 30.0, None),
           (903, 0, 1, 1, 5.0, 5.0, 0.0, 30.0, 0.9), (904, 0, 1, 1, 5.0, 5.0, 30.0, 30.0, float("nan")), (preds[0][0], *preds[0][1:4], *(v + 1 for v in preds[0][4:8]), preds[0][8] / 2)]
    df = spark.createDataFrame([*preds, *odd], PRED)
    once, both = suppression.nms(df, 0.45), settings.suppress_settings(df, [0.3, 0.6])
    plan = plan_of(once, capsys)
    assert "Join" not in plan and plan.count("Exchange") == 1
    for module in (suppression, settings):
        monkeypatch.setattr(module, "in_doubles", lambda df: False)  # conflicting pairs are listed
    assert sorted(map(repr, once.collect())) == sorted(map(repr, suppression.nms(df, 0.45).collect()))
    assert sorted(map(repr, both.collect())) == sorted(map(repr, settings.suppress_settings(df, [0.3, 0.6]).collect()))


def test_weightings_share_an_exchange(spark, capsys):
    _, _, p, _ = data(spark)
    plan = plan_of(settings.fuse_settings(p, [0.1], [0.5], [[1.0, 1.0, 1.0], [1.0, 2.0, 0.5]]), capsys)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # boxes are listed per weighting after it


def test_equal_rows_of_a_curve_have_one_order(spark):
    """Of rows that share image, id and score those that match come first, however they arrive."""
    rows = [(0, 1, 5, 0.5, 1, 1, 1), (0, 1, 5, 0.5, 1, 0, 0)]
    truth = spark.createDataFrame([(1, 1)], "category_id int, n_gt long")
    for some in (rows, rows[::-1]):
        flagged = spark.createDataFrame(some, "image_id long, category_id int, pred_id long, score double, _b0 long, _t0 long, _c0 long").coalesce(1)
        det, cls, sizes = settings.curves(flagged, truth, truth.select("n_gt"), 1)
        assert [r.ap for r in det.collect()] == [1.0] and [r.ap for r in cls.collect()] == [1.0] and [r.n_preds for r in sizes.collect()] == [2]

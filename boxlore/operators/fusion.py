"""Weighted fusion of boxes, and fusion of detector and classifier classes.

A fused box moves with every member it takes in, so boxes that may meet have to be seen in score
order. It never leaves the hull of its members, so boxes fall apart into exact units of work:
touching boxes are united, and united boxes whose hulls touch are united again, until all hulls
are disjoint. (Touching pairs alone are not enough: a mean box can reach what no member touches.)
Groups of ordinary size are one row each, sorted inside; small ones without any touching pair are
found in the JVM and need no clusters. Very large groups are cut into their units, and a task walks through the sorted
stream of a unit and holds only its open clusters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxlore.functions import geometry as G
from boxlore.operators.components import components
from boxlore.operators.matching import hot_groups
from boxlore.operators.spatial import CELL, cell_index, level_of, overlapping
from boxlore.operators.suppression import nms
from boxlore.session import materialise, owner

HOT_ROWS = 20000
PAIRS_NATIVE = 12  # groups up to this many rows are searched for touching pairs in the JVM
SCANNED = 24  # open clusters beyond this number are found through cells
WIDEST = 64  # cells a cluster may fill before it is looked at for every box instead


class _Clusters:
    """Open clusters of one unit: looked through one by one while few, then found by cells."""

    def __init__(self, min_iou: float, best_fit: bool):
        self.min_iou, self.best_fit = min_iou, best_fit
        self.boxes: list[tuple] = []
        self.seeds: list = []
        self.sums: list[list] = []
        self.cells: dict[tuple, set] | None = None
        self.wide: set[int] = set()
        self.cell = 1.0

    def _touched(self, box) -> list[tuple] | None:
        x, y, w, h = box
        i, j, k, l = x // self.cell, (x + w) // self.cell, y // self.cell, (y + h) // self.cell  # noqa: E741
        if (j - i + 1) * (l - k + 1) > WIDEST:
            return None
        return [(p, q) for p in range(int(i), int(j) + 1) for q in range(int(k), int(l) + 1)]

    def _list(self, k: int, box) -> None:
        touched = self._touched(box)
        if touched is None:
            self.wide.add(k)
        else:
            for c in touched:
                self.cells.setdefault(c, set()).add(k)

    def _unlist(self, k: int, box) -> None:
        touched = self._touched(box)
        if touched is None:
            self.wide.discard(k)
        else:
            for c in touched:
                self.cells[c].discard(k)

    def _near(self, box):
        if self.cells is None:
            return range(len(self.boxes))
        touched = self._touched(box)
        if touched is None:
            return range(len(self.boxes))
        near = set(self.wide)
        for c in touched:
            near |= self.cells.get(c, set())
        return sorted(near)

    def _find(self, x, y, w, h):
        found, level = None, self.min_iou
        x2, y2, area = x + w, y + h, w * h
        for k in self._near((x, y, w, h)):
            cx, cy, cw, ch = self.boxes[k]
            iw = min(x2, cx + cw) - max(x, cx)
            if iw <= 0:
                continue
            ih = min(y2, cy + ch) - max(y, cy)
            if ih <= 0:
                continue
            inter = iw * ih  # above 0, so the union is too
            iou = inter / (area + cw * ch - inter)
            if self.best_fit:
                if iou > level:
                    found, level = k, iou
            elif iou >= level:
                return k
        return found

    def best(self, x, y, w, h):
        """The cluster of highest IoU, the earliest of equals, and that IoU; None if nothing touches."""
        self.min_iou, self.best_fit = 0.0, True
        k = self._find(x, y, w, h)
        if k is None:
            return None, 0.0
        cx, cy, cw, ch = self.boxes[k]
        inter = (min(x + w, cx + cw) - max(x, cx)) * (min(y + h, cy + ch) - max(y, cy))
        return k, inter / (w * h + cw * ch - inter)

    def copy(self) -> _Clusters:
        out = _Clusters(self.min_iou, self.best_fit)
        out.boxes, out.seeds, out.wide, out.cell = list(self.boxes), list(self.seeds), set(self.wide), self.cell
        out.sums = [[*s[:6], set(s[6])] for s in self.sums]
        out.cells = None if self.cells is None else {c: set(v) for c, v in self.cells.items()}
        return out

    def add(self, x, y, w, h, weight, source, pred_id):
        self.put(self._find(x, y, w, h), x, y, w, h, weight, source, pred_id)

    def put(self, k, x, y, w, h, weight, source, pred_id):
        """Take a box into cluster ``k``, or open one for it."""
        if k is None:
            self.boxes.append((x, y, w, h))
            self.seeds.append(pred_id)
            self.sums.append([weight * x, weight * y, weight * w, weight * h, weight, 1, {source}])
            if self.cells is not None:
                self._list(len(self.boxes) - 1, (x, y, w, h))
            elif len(self.boxes) > SCANNED:
                self.cell = 2 * sum(max(b[2], b[3]) for b in self.boxes) / len(self.boxes) or 1.0
                self.cells = {}
                for i, b in enumerate(self.boxes):
                    self._list(i, b)
            return
        s = self.sums[k]
        s[0] += weight * x
        s[1] += weight * y
        s[2] += weight * w
        s[3] += weight * h
        s[4] += weight
        s[5] += 1
        s[6].add(source)
        if s[4] > 0:
            before, self.boxes[k] = self.boxes[k], (s[0] / s[4], s[1] / s[4], s[2] / s[4], s[3] / s[4])
            if self.cells is not None:
                self._unlist(k, before)
                self._list(k, self.boxes[k])

    def rows(self):
        for seed, box, s in zip(self.seeds, self.boxes, self.sums):
            yield (seed, *box, s[4], s[5], len(s[6]))


_FUSED = ["cluster", "x", "y", "w", "h", "weight_sum", "members", "sources"]
_KINDS = [pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.int64()]


def _made(keys: list[pa.Array], names: Sequence[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _FUSED]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]], names=[*names, *_FUSED])


def _fuse_groups(keys: list[str], best_fit: bool):
    """Whole groups: rows ``keys, m`` with the members in order; those ``_apart`` are their own clusters, null gets none."""

    def alone(groups: pa.RecordBatch) -> pa.RecordBatch:
        m = groups.column("m")
        flat, of = m.flatten(), np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy()))
        where, one = pa.array(of), pa.array(np.ones(len(of), np.int64))
        columns = [flat.field(c) for c in ("pred_id", "x", "y", "w", "h", "weight")]
        return pa.RecordBatch.from_arrays([*[groups.column(k).take(where) for k in keys], *columns, one, one], names=[*keys, *_FUSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = batch.column("_apart")
            yield alone(batch.filter(apart))
            batch = batch.filter(pa.compute.invert(apart))
            m = batch.column("m")
            flat = m.flatten()
            ends = np.cumsum(np.diff(m.offsets.to_numpy())).tolist()
            members = list(zip(*(flat.field(c).to_pylist() for c in ("x", "y", "w", "h", "weight", "source", "pred_id")), strict=True))
            rows, of, at = [], [], 0
            for g, (end, min_iou) in enumerate(zip(ends, batch.column("_min_iou").to_pylist(), strict=True)):
                clusters = _Clusters(min_iou, best_fit)
                for values in members[at:end]:
                    clusters.add(*values)
                before = len(rows)
                rows.extend(clusters.rows())
                of += [g] * (len(rows) - before)
                at = end
            where = pa.array(of, pa.int64())
            yield _made([batch.column(k).take(where) for k in keys], keys, rows)

    return run


def _fuse_streams(keys: list[str], kinds: list[pa.DataType], best_fit: bool):
    """Sorted streams of boxes: a unit's open clusters are all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, clusters, of, rows = None, None, [], []

        def close():
            before = len(rows)
            rows.extend(clusters.rows())
            of.extend([current[:-1]] * (len(rows) - before))

        def out() -> pa.RecordBatch:
            return _made([pa.array(c, k) for c, k in zip(zip(*of, strict=True), kinds, strict=True)], keys, rows)

        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in (*keys, "_unit")), strict=True)
            cols = [batch.column(c).to_pylist() for c in ("x", "y", "w", "h", "_weight", "_source", "pred_id", "_min_iou")]
            for key, *values, min_iou in zip(groups, *cols, strict=True):
                if key != current:
                    if clusters is not None:
                        close()
                    current, clusters = key, _Clusters(min_iou, best_fit)
                    if len(rows) > 5000:
                        yield out()
                        of, rows = [], []
                clusters.add(*values)
        if clusters is not None:
            close()
            yield out()

    return run


def hull_units(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_unit``: boxes of different units never meet, whatever they are fused to.

    Boxes that lie in the same small cells with all four sides are one to begin with, so a pile of
    near-copies is never paired with itself. Boxes without area are units of their own.
    """
    keys, own = list(keys), owner(rows.sparkSession)
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    level = level_of(F.col("w"), F.col("h"))
    side = [cell_index(v, level, CELL / 16) for v in (F.col("x"), F.col("y"), x2, y2)]
    flat = ~((F.col("w") > 0) & (F.col("h") > 0))
    rows = rows.withColumn("_stack", F.when(flat, F.xxhash64(*keys, F.lit("alone"), "pred_id")).otherwise(F.xxhash64(*keys, level, *side)))
    hull = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(x2) - F.min("x")).alias("w"), (F.max(y2) - F.min("y")).alias("h")]
    hulls = own.keep(rows.where(~flat).groupBy(*keys, F.col("_stack").alias("u")).agg(*hull))
    names = hulls.select(F.col("u").alias("_stack"), F.col("u").alias("_unit")).distinct()
    while True:
        met = own.keep(overlapping(hulls, hulls, keys, condition=F.col("a_u") < F.col("b_u")).select("a_u", "b_u"))
        if met.isEmpty():
            break
        joint = own.keep(components(met, own, "a_u", "b_u").select(F.col("id").alias("u"), "component"))
        hulls = own.keep(hulls.join(joint, "u", "left").groupBy(*keys, F.coalesce("component", "u").alias("u")).agg(*hull))
        names = own.keep(names.join(joint.withColumnRenamed("u", "_unit"), "_unit", "left").select("_stack", F.coalesce("component", "_unit").alias("_unit")))
    return rows.join(names, "_stack", "left").withColumn("_unit", F.coalesce("_unit", "_stack")).drop("_stack")


def _touching(m: Column) -> Column:
    """Whether two boxes of an array of members have an area in common."""
    meet = lambda p, q: (p["pred_id"] < q["pred_id"]) & (F.least(p["x"] + p["w"], q["x"] + q["w"]) > F.greatest(p["x"], q["x"])) & (F.least(p["y"] + p["h"], q["y"] + q["h"]) > F.greatest(p["y"], q["y"]))
    return F.exists(m, lambda p: F.exists(m, lambda q: meet(p, q)))


def cluster_boxes(
    dets: DataFrame, weight: Column, source: str, min_iou: float | Column, keys: Sequence[str], *, best_fit: bool, hot_rows: int = HOT_ROWS,
    stored: bool = False, buckets: tuple[str, int] | None = None,
) -> DataFrame:
    """Online clusters per key: ``keys, cluster, x, y, w, h, weight_sum, members, sources``.

    ``best_fit``: join the cluster of highest IoU above ``min_iou``; otherwise the earliest
    cluster at or above it. ``min_iou`` may be a column that is constant per group. ``cluster`` is
    the ``pred_id`` of the box that opened the cluster, so neither the order of groups nor cutting
    a group changes it. Boxes without area touch nothing and stay alone. The input is evaluated once
    and stored, in ``buckets`` if it lies so already, unless it is read from a table (``stored``).
    """
    if not isinstance(min_iou, Column):
        if min_iou <= 0:
            raise ValueError("min_iou must be above 0: boxes that do not touch are never fused")
        min_iou = F.lit(float(min_iou))
    keys = list(keys)
    rows = dets.select(
        *keys, F.col("pred_id").cast("bigint").alias("pred_id"), *[F.col(c).cast("double").alias(c) for c in "xywh"], weight.cast("double").alias("_weight"),
        F.col(source).alias("_source"), min_iou.alias("_min_iou"))
    rows = rows if stored else owner(rows.sparkSession).keep(rows, buckets)
    hot = hot_groups(rows, keys, hot_rows)
    fields = {f.name: f for f in rows.schema.fields}
    fused = [T.StructField("cluster", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in _FUSED[1:6]], T.StructField("members", T.LongType()), T.StructField("sources", T.LongType())]
    schema = T.StructType([*[fields[k] for k in keys], *fused])
    calm = rows if hot is None else rows.join(hot, keys, "left_anti")
    member = F.struct((-F.col("_weight")).alias("less"), "pred_id", *"xywh", F.col("_weight").alias("weight"), F.col("_source").alias("source"))
    groups = calm.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("_min_iou").alias("_min_iou"))
    groups = groups.withColumn("_apart", (F.size("m") == 1) | ((F.size("m") <= PAIRS_NATIVE) & ~_touching(F.col("m"))))
    out = groups.mapInArrow(_fuse_groups(keys, best_fit), schema)
    if hot is None:
        return out
    at = [*keys, "_unit"]
    crowd = hull_units(rows.join(hot, keys, "left_semi"), keys)
    ordered = crowd.repartition(*at).sortWithinPartitions(*at, F.col("_weight").desc(), F.col("pred_id").asc())
    kinds = [f.type for f in to_arrow_schema(T.StructType([fields[k] for k in keys]))]
    return out.unionByName(ordered.mapInArrow(_fuse_streams(keys, kinds, best_fit), schema))


def fused_id(clusters: DataFrame) -> DataFrame:
    """The ``pred_id`` of a fused box: that of its first member."""
    return clusters.withColumn("pred_id", F.col("cluster"))


def wbf_sequential(
    dets: DataFrame, n_passes: int, min_iou: float = 0.55, min_passes: int = 1,
    keys: Sequence[str] = ("image_id", "category_id"), source: str = "pass_id", **options,
) -> DataFrame:
    """First-fit fusion over passes; score is the mean times the share of passes seen."""
    clusters = cluster_boxes(dets, F.col("score"), source, min_iou, keys, best_fit=False, **options)
    seen = F.least(F.col("sources"), F.lit(n_passes))
    return fused_id(clusters.where(F.col("sources") >= min_passes)).select(
        *keys, "pred_id", *"xywh",
        (F.col("weight_sum") / F.col("members") * seen / F.lit(n_passes)).alias("score"), "members")


def wbf_weighted(
    dets: DataFrame, weights: Sequence[float], min_iou: float | Column = 0.55, skip: float = 0.0,
    keys: Sequence[str] = ("image_id", "category_id"), source: str = "model_id", **options,
) -> DataFrame:
    """Best-fit fusion of models with weights (the published weighted-boxes-fusion rule).

    ``weights[i]`` belongs to model ``i``. Scores below ``skip`` are left out before weighting.
    Fused score: mean weighted score times ``min(members, models) / sum(weights)``. Boxes without
    area are left out.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.col("score") * F.element_at(table, (F.col(source) + 1).cast("int"))
    usable = dets.where((F.col("score") >= skip) & (F.col("w") > 0) & (F.col("h") > 0))
    clusters = cluster_boxes(usable, weight, source, min_iou, keys, best_fit=True, **options)
    return fused_id(clusters).select(
        *keys, "pred_id", *"xywh",
        (F.col("weight_sum") / F.col("members") * F.least(F.col("members"), F.lit(len(weights))) / F.lit(float(sum(weights)))).alias("score"),
        "members")


def nms_then_wbf(dets: DataFrame, n_passes: int, nms_iou: float, min_iou: float, *, stored: bool = False, **options) -> DataFrame:
    """Suppress inside every pass, then fuse the passes. ``stored``: ``dets`` is read from a table."""
    kept = nms(dets, nms_iou, ["image_id", "category_id", "pass_id"], stored=stored)
    return wbf_sequential(kept, n_passes, min_iou, **options)


def tile_fusion(dets: DataFrame, method: str, threshold: float, cap: int | None = None) -> DataFrame:
    """Detections in tile coordinates to image coordinates, fused across tiles, best ``cap`` kept.

    For ``wbf`` all tiles count as one model.
    """
    from boxlore.operators.ranking import cap_per_group

    moved = dets.withColumns(dict(zip("xywh", G.tile_to_image(G.box_of(), F.col("tile_x"), F.col("tile_y")))))
    if method == "nms":
        out = nms(moved, threshold).select("image_id", "category_id", "pred_id", *"xywh", "score")
    elif method == "wbf":
        one = moved.withColumn("model_id", F.lit(0))
        out = wbf_weighted(one, [1.0], threshold).select("image_id", "category_id", "pred_id", *"xywh", "score")
    else:
        raise ValueError(f"unknown method {method!r}")
    if cap is None:
        return out
    return cap_per_group(out, ["image_id"], [F.col("score").desc(), F.col("pred_id").asc()], cap)


def dispatch(
    dets: DataFrame, method: str, n_passes: int, nms_iou: float = 0.5, wbf_iou: float = 0.55, *, stored: bool = False, buckets: tuple[str, int] | None = None
) -> DataFrame:
    """Choose the fusion of several passes by name.

    With one pass every method but ``concat_nms`` is plain suppression; an unknown name
    suppresses the first pass only. ``stored``: ``dets`` is read from a table, in ``buckets`` by a
    column or not, and is not stored again.
    """
    cols = ["image_id", "category_id", "pred_id", *"xywh", "score"]
    if method == "concat_nms":
        return nms(dets, nms_iou, stored=stored).select(*cols)
    if n_passes == 1 or method not in ("wbf", "nms_then_wbf"):
        return nms(dets.where(F.col("pass_id") == 0), nms_iou, stored=stored).select(*cols)
    if method == "wbf":
        fused = wbf_sequential(dets, n_passes, wbf_iou, stored=stored)
    else:
        fused = nms_then_wbf(dets, n_passes, nms_iou, wbf_iou, stored=stored, buckets=buckets)
    return fused.select(*cols)


def fuse_class(policy: Column | str, cls_t: Column | float, det_t: Column | float) -> tuple[Column, Column]:
    """Class and score out of detector (``category_id, score``) and classifier (``cls, cls_conf``)."""
    policy = F.lit(policy) if isinstance(policy, str) else policy
    cls_t = F.lit(cls_t) if not isinstance(cls_t, Column) else cls_t
    det_t = F.lit(det_t) if not isinstance(det_t, Column) else det_t
    sure, weak = F.col("cls_conf") >= cls_t, F.col("score") < det_t
    take = (policy == "A") | (policy.isin("B", "C") & sure) | (policy.isin("D", "E") & sure & weak)
    return (
        F.when(take, F.col("cls")).otherwise(F.col("category_id")),
        F.when((policy == "C") & sure, F.col("score") * F.col("cls_conf")).otherwise(F.col("score")),
    )


def fuse_class_runtime(policy: str, cls_t: float, det_t: float, n_classes: int, score_formula: str = "det_score") -> tuple[Column, Column]:
    """Run-time variant: the score formula has the last word, classes out of range fall back."""
    category, score = fuse_class(policy, cls_t, det_t)
    if score_formula == "det_x_cls":
        score = F.col("score") * F.col("cls_conf")
    elif score_formula == "det_score":
        score = F.col("score")
    return G.clamp_category(category, n_classes, F.col("category_id")), score


def override_class(min_conf: float, n_classes: int, always: bool = False) -> Column:
    take = F.lit(always) | (F.col("cls_conf") >= min_conf)
    return F.when(take & (F.col("cls") >= 0) & (F.col("cls") < n_classes), F.col("cls")).otherwise(F.col("category_id"))


def attach_classifier(dets: DataFrame, classifier: DataFrame) -> DataFrame:
    """Classifier answer per detection by id; detections without one get class 0 and confidence 0."""
    joined = dets.join(classifier, "pred_id", "left")
    return joined.withColumns({"cls": F.coalesce("cls", F.lit(0)), "cls_conf": F.coalesce("cls_conf", F.lit(0.0))})

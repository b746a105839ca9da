"""Non-maximum suppression per (image, class).

A box stays unless a better box that stays overlaps it above the threshold. Order: score
descending, then ``pred_id``.

Where all groups are of ordinary size, their rows are sent once, sorted, and a task compares and
decides many groups at a time. Where some are very large, conflicting pairs are listed; boxes
without conflicts never enter the decision. Conflicts are decided by a native fold, or in
distributed rounds when a group has many; what rounds no longer shrink is a sorted stream, per
connected component where it is long. Very large
groups are peeled first: the best box of every small cell (an eighth to half a box wide) is
compared with its surroundings, which is linear in the group, and a pile of near-copies goes in
one round. No group is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlore.functions import geometry as G
from boxlore.operators.components import in_units
from boxlore.operators.matching import FOLD_LIMIT, HOT_ROWS, UNIT_LIMIT, WORTHWHILE, hot_groups
from boxlore.operators.spatial import CELL, FARTHEST, cell_index, level_of, overlapping
from boxlore.session import materialise, owner


def _before(a: str, b: str) -> Column:
    """Box ``a`` has priority over box ``b``."""
    sa, sb = F.col(f"{a}_score"), F.col(f"{b}_score")
    return (sa > sb) | ((sa == sb) & (F.col(f"{a}_pred_id") < F.col(f"{b}_pred_id")))


def peel_cell() -> list[Column]:
    """Small cells, by the size of the box: ``_fl, _fx, _fy``."""
    level = F.coalesce(level_of(F.col("w"), F.col("h")), F.lit(0))
    at = lambda v: cell_index(v, level, CELL / 16)
    return [level.alias("_fl"), at(F.col("x") + F.col("w") / 2).alias("_fx"), at(F.col("y") + F.col("h") / 2).alias("_fy")]


def _conflict(threshold: float) -> Column:
    return G.iou_eps(G.box_of("a_"), G.box_of("b_")) > threshold


def nms(
    preds: DataFrame,
    threshold: float,
    keys: Sequence[str] = ("image_id", "category_id"),
    *,
    fold_limit: int = FOLD_LIMIT,
    hot_rows: int = HOT_ROWS,
    cell: float = CELL,
    stored: bool = False,
) -> DataFrame:
    """The surviving rows of ``preds``, all columns kept. ``preds`` is evaluated once and stored, unless it is read from a table (``stored``)."""
    keys = list(keys)
    preds = preds if stored else materialise(preds)
    boxes = preds.select(*keys, "pred_id", "score", *"xywh")
    hot = hot_groups(boxes, keys, hot_rows)
    if hot is None and in_doubles(preds):
        return in_groups(preds, [threshold], keys).where("_s <> 0").select(*keys, *[c for c in preds.columns if c not in keys])
    dropped = None
    if hot is not None:
        boxes, dropped = _peel(boxes, hot, threshold, keys, hot_rows, cell)
    edges = materialise(
        overlapping(boxes, boxes, keys, cell=cell, condition=_before("a", "b") & _conflict(threshold))
        .select(*keys, F.col("a_score").alias("s"), F.col("a_pred_id").alias("hi"), F.col("b_pred_id").alias("lo"))
    )
    losers = _losers(edges, keys, fold_limit)
    dropped = losers if dropped is None else dropped.unionByName(losers)
    return preds.join(dropped, [*keys, "pred_id"], "left_anti")


def in_doubles(preds: DataFrame) -> bool:
    """Whether NumPy computes with boxes and scores as Spark does."""
    kinds = dict(preds.dtypes)
    return all(kinds[c] == "double" for c in (*"xywh", "score")) and "_s" not in kinds


def in_groups(preds: DataFrame, thresholds: Sequence[float], keys: list[str]) -> DataFrame:
    """``preds`` with ``_s``: the thresholds, as bits, under which a box stays. No group is very large.

    Rows are sent once, or not at all if they are stored in buckets by some of the keys; a task
    holds a batch and the group that its end cuts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).drop_columns(["_place"])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            new = _group_starts(rows, keys)
            last = int(np.flatnonzero(new)[-1])
            held = rows.slice(last)
            if last:
                yield from decided(rows.slice(0, last), new[:last])
        if held is not None:
            yield from decided(held, _group_starts(held, keys))

    def decided(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        stays = (1 << len(thresholds)) - 1 - _lost_in(rows.combine_chunks(), np.cumsum(new), thresholds)
        yield from rows.append_column("_s", pa.array(stays, pa.int64())).combine_chunks().to_batches()

    # A window hands on rows in its own order, and sends them only where they do not lie together yet.
    ordered = preds.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("pred_id"))))
    return ordered.mapInArrow(run, T.StructType([*preds.schema.fields, T.StructField("_s", T.LongType())]))


def _group_starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row opens a group; a null key is equal to nothing."""
    same = np.ones(rows.num_rows - 1, bool)
    for k in keys:
        column = rows.column(k)
        same &= pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy()
    return np.concatenate([[True], ~same])


def _lost_in(rows: pa.Table, group: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Thresholds, as bits, under which each row is lost; rows are in order inside their groups."""
    lost_bits = np.zeros(len(group), np.int64)
    x, y, w, h, score = (rows.column(c).to_numpy() for c in (*"xywh", "score"))
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        x2, y2, area = x + w, y + h, w * h
        fit = (w > 0) & (h > 0) & (np.maximum.reduce([np.abs(x), np.abs(y), w, h]) < FARTHEST) & pc.is_valid(rows.column("score")).to_numpy()
        a, found = np.arange(len(group)), []
        for d in range(1, len(group)):
            a = a[: np.searchsorted(a, len(group) - d)]
            a = a[group[a] == group[a + d]]
            if not len(a):
                break
            i = a[fit[a] & fit[a + d]]
            j = i + d
            near = (x[i] < x2[j]) & (x[j] < x2[i]) & (y[i] < y2[j]) & (y[j] < y2[i])
            i, j = i[near], j[near]
            inter = (np.minimum(x2[i], x2[j]) - np.maximum(x[i], x[j])) * (np.minimum(y2[i], y2[j]) - np.maximum(y[i], y[j]))
            iou = inter / (area[i] + area[j] - inter + 1e-6)
            beaten = sum(((iou > t).astype(np.int64) << k for k, t in enumerate(thresholds)), np.zeros(len(i), np.int64))
            hit = beaten != 0
            found.append((i[hit], j[hit], beaten[hit]))
    if not found:
        return lost_bits
    i, j, beaten = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(i):
        return lost_bits
    ids = rows.column("pred_id")
    # Of equal scores the smaller id is better; rows that share an id are lost together.
    tie = (score[i] == score[j]) | (np.isnan(score[i]) & np.isnan(score[j]))
    other = pc.fill_null(pc.not_equal(ids.take(pa.array(i)), ids.take(pa.array(j))), False).to_numpy()
    keep = np.flatnonzero(~tie | other)
    keep = keep[np.argsort(i[keep], kind="stable")]
    touched = np.isin(group, group[i])
    name = dict(zip(np.flatnonzero(touched).tolist(), ids.filter(pa.array(touched)).to_pylist(), strict=True))
    lost: dict[tuple, int] = {}
    for g, p, q, e in zip(group[i[keep]].tolist(), i[keep].tolist(), j[keep].tolist(), beaten[keep].tolist(), strict=True):
        hit = e & ~lost.get((g, name[p]), 0)
        if hit and name[q] is not None:
            lost[g, name[q]] = lost.get((g, name[q]), 0) | hit
    for row, value in name.items():
        lost_bits[row] = lost.get((int(group[row]), value), 0)
    return lost_bits


def _losers(edges: DataFrame, keys: list[str], fold_limit: int) -> DataFrame:
    hot = hot_groups(edges, keys, fold_limit)
    if hot is None:
        return _fold(edges, keys)
    out = _fold(edges.join(hot, keys, "left_anti"), keys)
    live = materialise(edges.join(hot, keys, "left_semi"))
    left = live.count()
    while left:
        # Boxes nothing undecided stands above are final; so is the loss of whatever they hit.
        winners = live.select(*keys, F.col("hi").alias("id")).distinct().join(
            live.select(*keys, F.col("lo").alias("id")).distinct(), [*keys, "id"], "left_anti")
        lost = materialise(
            live.join(winners.withColumnRenamed("id", "hi"), [*keys, "hi"], "left_semi").select(*keys, F.col("lo").alias("pred_id")).distinct()
        )
        out = out.unionByName(lost)
        # Edges from a final winner end in a loser, so removing edges at losers removes those too.
        live = materialise(
            live.join(lost.withColumnRenamed("pred_id", "hi"), [*keys, "hi"], "left_anti")
            .join(lost.withColumnRenamed("pred_id", "lo"), [*keys, "lo"], "left_anti")
        )
        before, left = left, live.count()
        if left > before * (1 - WORTHWHILE):
            return out.unionByName(_walk(live, keys))
    return out


def _walk(edges: DataFrame, keys: list[str], limit: int = UNIT_LIMIT) -> DataFrame:
    """Decide edges as a stream, best box first; a task holds only the ids already lost.

    For long chains of boxes, which rounds decide one box at a time: when a box comes up, all
    edges into it are behind. In groups of more than ``limit`` edges, chains that share no box are
    work for different tasks.
    """
    at = [*keys, "_unit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lost = None, set()
        for pdf in batches:
            out = []
            for key, hi, lo in zip(zip(*(pdf[k].tolist() for k in at)), pdf["hi"].tolist(), pdf["lo"].tolist()):
                if key != current:
                    current, lost = key, set()
                if hi not in lost and lo not in lost:
                    lost.add(lo)
                    out.append((*key[:-1], lo))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "pred_id"])

    fields = {f.name: f for f in edges.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], T.StructField("pred_id", fields["lo"].dataType)])
    units = in_units(edges, hot_groups(edges, keys, limit), keys, ["hi"], ["lo"], owner(edges.sparkSession), one_kind=True)
    return units.repartition(*at).sortWithinPartitions(*at, F.col("s").desc(), F.col("hi").asc()).mapInPandas(run, schema)


def _fold(edges: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "hi", "lo")))

    def step(acc, e):
        skip = F.array_contains(acc, e["hi"]) | F.array_contains(acc, e["lo"])
        return F.when(skip, acc).otherwise(F.array_append(acc, e["lo"]))

    kind = dict(edges.dtypes)["hi"]
    return edges.groupBy(*keys).agg(ordered.alias("e")).select(
        *keys, F.explode(F.aggregate("e", F.array().cast(f"array<{kind}>"), step)).alias("pred_id")
    )


def _peel(boxes: DataFrame, hot: DataFrame, threshold: float, keys: list[str], hot_rows: int, cell: float):
    """Decide boxes of very large groups until every group is of ordinary size.

    Returns the boxes still open and the ids already suppressed. Boxes decided to stay have
    already removed everything they conflict with, so they need no further part.
    """
    calm = boxes.join(hot, keys, "left_anti")
    live = boxes.join(hot, keys, "left_semi")
    suppressed, left = None, live.count()
    while True:
        best = F.min(F.struct((-F.col("score")).alias("k"), "pred_id", "score", *"xywh")).alias("b")
        heads = live.groupBy(*keys, *peel_cell()).agg(best).select(
            *keys, "b.pred_id", "b.score", *[f"b.{c}" for c in "xywh"])
        near = materialise(
            overlapping(heads, live, keys, cell=cell, condition=_conflict(threshold) & (F.col("a_pred_id") != F.col("b_pred_id")))
            .select(*keys, F.col("a_pred_id").alias("head"), F.col("b_pred_id").alias("pred_id"), _before("b", "a").alias("above"))
        )
        blocked = near.where("above").select(*keys, "head").distinct()
        kept = materialise(heads.select(*keys, F.col("pred_id").alias("head")).join(blocked, [*keys, "head"], "left_anti"))
        lost = materialise(near.join(kept, [*keys, "head"], "left_semi").select(*keys, "pred_id").distinct())
        suppressed = lost if suppressed is None else suppressed.unionByName(lost)
        gone = lost.unionByName(kept.withColumnRenamed("head", "pred_id"))
        live = materialise(live.join(gone, [*keys, "pred_id"], "left_anti"))
        hot = hot_groups(live, keys, hot_rows)
        before, left = left, live.count()
        if hot is None or left > before * (1 - WORTHWHILE):  # not a pile: pairs are few
            return calm.unionByName(live), suppressed
        calm = calm.unionByName(live.join(hot, keys, "left_anti"))
        live = live.join(hot, keys, "left_semi")


def concat_nms(passes: DataFrame, threshold: float, **options) -> DataFrame:
    """Passes are rows of one table; suppress across them."""
    return nms(passes, threshold, **options)


def merge_flip(original: DataFrame, flipped: DataFrame, threshold: float, **options) -> DataFrame:
    """Original and flipped pass together; images the flipped pass found nothing in stay as they were."""
    both = original.join(flipped.select("image_id").distinct(), "image_id", "left_semi")
    untouched = original.join(flipped.select("image_id").distinct(), "image_id", "left_anti")
    return nms(both.unionByName(flipped), threshold, **options).unionByName(untouched)

"""One-to-one matching of predictions to ground truth.

Predictions, best score first, take the free ground-truth box of highest IoU. Order of
equals: predictions by ``pred_id``, ground truth by ``gt_id``.

Groups with few candidate pairs are decided by one native array fold. Larger groups are
decided in rounds of two combinable aggregates: a pair whose prediction wants that box most,
and whose box is wanted by no better prediction, is final; everything it touches leaves. When
rounds stop paying, the rest is a sorted stream that keeps only the ids taken, of a group or,
where much is left of it, of each connected component. All ways give the same matching, so the limits only choose the
cheaper one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.operators.components import in_units
from boxlore.operators.ranking import ranked
from boxlore.operators.spatial import CELL, iou_join, overlapping
from boxlore.session import materialise, owner

FOLD_LIMIT = 20000
HOT_ROWS = 5000
# Rounds go on while each decides at least this share of the remaining pairs.
WORTHWHILE = 0.2
# What is left of a group is streamed by one task up to this many pairs, by components beyond.
UNIT_LIMIT = 100_000


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. Counts combine before the shuffle.

    Most groups are small and many: where no value of the first key has more rows, they are not counted.
    """
    for some in ([keys[0]], keys):
        sizes = df.groupBy(*some).count()
        largest = sizes.agg(F.max("count")).first()[0] or 0
        if largest <= limit or len(some) == len(keys):
            break
    return None if largest <= limit else materialise(sizes.where(F.col("count") > limit).select(*keys))


def greedy_match(
    preds: DataFrame,
    gts: DataFrame,
    min_iou: float,
    keys: Sequence[str] = ("image_id",),
    *,
    fold_limit: int = FOLD_LIMIT,
    hot_rows: int = HOT_ROWS,
    cell: float = CELL,
) -> DataFrame:
    """Matched pairs ``keys, pred_id, gt_id``. Add ``category_id`` to ``keys`` to match inside classes."""
    pairs = candidate_pairs(preds, gts, min_iou, keys, hot_rows=hot_rows, cell=cell)
    return resolve_pairs(pairs, keys, fold_limit)


def candidate_pairs(
    preds: DataFrame, gts: DataFrame, min_iou: float, keys: Sequence[str] = ("image_id",), *, hot_rows: int = HOT_ROWS, cell: float = CELL
) -> DataFrame:
    """Stored pairs at or above the IoU. They also serve matching inside classes: filter on equal classes."""
    keys = list(keys)
    classes = [] if "category_id" in keys or "category_id" not in preds.columns else ["category_id"]
    narrow = preds.select(*keys, "pred_id", "score", *classes, *"xywh")
    if hot_groups(narrow, keys, hot_rows) is not None:
        narrow = _without_surplus_copies(narrow, gts, min_iou, keys, classes, hot_rows, cell)
    return materialise(iou_join(narrow, gts, min_iou, keys, cell=cell))


def resolve_pairs(pairs: DataFrame, keys: Sequence[str], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Decide stored candidate pairs ``keys, pred_id, gt_id, score, iou``."""
    keys = list(keys)
    hot = hot_groups(pairs, keys, fold_limit)
    if hot is None:
        return _fold(pairs, keys)
    done = _fold(pairs.join(hot, keys, "left_anti"), keys)
    live = materialise(pairs.join(hot, keys, "left_semi"))
    left = live.count()
    while True:
        live = _without_hopeless(live, keys)
        won = materialise(_mutual_best(live, keys))
        done = done.unionByName(won)
        live = materialise(
            live.join(won.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti")
            .join(won.select(*keys, "gt_id"), [*keys, "gt_id"], "left_anti")
        )
        before, left = left, live.count()
        if left > before * (1 - WORTHWHILE):
            return done.unionByName(_walk(live, keys))
        hot = hot_groups(live, keys, fold_limit)
        if hot is None:
            return done.unionByName(_fold(live, keys))
        done = done.unionByName(_fold(live.join(hot, keys, "left_anti"), keys))
        live = materialise(live.join(hot, keys, "left_semi"))
        left = live.count()


def _walk(pairs: DataFrame, keys: list[str], limit: int = UNIT_LIMIT) -> DataFrame:
    """Decide pairs in order as a sorted stream; a task holds only the ids already taken.

    For what rounds no longer shrink: long chains of boxes that wait for one another. In groups of
    more than ``limit`` pairs, chains that share no box are work for different tasks.
    """
    at = [*keys, "_unit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, preds, gts = None, set(), set()
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c].tolist() for c in [*at, "pred_id", "gt_id"])):
                if row[:-2] != current:
                    current, preds, gts = row[:-2], set(), set()
                if row[-2] not in preds and row[-1] not in gts:
                    preds.add(row[-2])
                    gts.add(row[-1])
                    out.append(row)
            if out:
                yield pd.DataFrame(out, columns=[*at, "pred_id", "gt_id"])

    rows = pairs.select(*keys, F.col("pred_id").cast("bigint").alias("pred_id"), F.col("gt_id").cast("bigint").alias("gt_id"), "score", "iou")
    rows = in_units(rows, hot_groups(rows, keys, limit), keys, ["pred_id"], ["gt_id"], owner(rows.sparkSession))
    order = [*at, F.col("score").desc(), F.col("pred_id").asc(), F.col("iou").desc(), F.col("gt_id").asc()]
    schema = rows.select(*at, "pred_id", "gt_id").schema
    return rows.repartition(*at).sortWithinPartitions(*order).mapInPandas(run, schema).drop("_unit")


def _fold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pred_id", (-F.col("iou")).alias("i"), "gt_id")))
    none = F.array().cast("array<bigint>")

    def step(acc, p):
        taken = F.array_contains(acc["p"], p["pred_id"]) | F.array_contains(acc["g"], p["gt_id"])
        return F.when(taken, acc).otherwise(
            F.struct(F.array_append(acc["p"], p["pred_id"]).alias("p"), F.array_append(acc["g"], p["gt_id"]).alias("g"))
        )

    ids = pairs.withColumn("pred_id", F.col("pred_id").cast("bigint")).withColumn("gt_id", F.col("gt_id").cast("bigint"))
    folded = ids.groupBy(*keys).agg(ordered.alias("c")).select(
        *keys, F.aggregate("c", F.struct(none.alias("p"), none.alias("g")), step).alias("m")
    )
    return folded.select(*keys, F.inline(F.arrays_zip(F.col("m.p").alias("pred_id"), F.col("m.g").alias("gt_id"))))


def _without_hopeless(live: DataFrame, keys: list[str]) -> DataFrame:
    """Drop predictions that must come too late.

    Of predictions with the same set of partners the k-th best can match only if all better ones
    did, and all of those within that set: ranks beyond its size never match. A pile of similar
    predictions over a few boxes thus shrinks to as many predictions as there are boxes. A set is
    the sorted list of the boxes one prediction overlaps.
    """
    sets = live.groupBy(*keys, "pred_id", "score").agg(F.array_sort(F.collect_set("gt_id")).alias("_set"))
    places = ranked(sets, [*keys, "_set"], [F.col("score").desc(), F.col("pred_id").asc()], rank="_rank")
    late = places.where(F.col("_rank") > F.size("_set")).select(*keys, "pred_id")
    return materialise(live.join(late, [*keys, "pred_id"], "left_anti"))


def _mutual_best(live: DataFrame, keys: list[str]) -> DataFrame:
    wants = live.groupBy(*keys, "pred_id").agg(F.min(F.struct((-F.col("iou")).alias("k"), "gt_id")).alias("b"))
    wants = wants.select(*keys, "pred_id", F.col("b.gt_id").alias("gt_id"))
    first = live.groupBy(*keys, "gt_id").agg(F.min(F.struct((-F.col("score")).alias("k"), "pred_id")).alias("b"))
    first = first.select(*keys, "gt_id", F.col("b.pred_id").alias("pred_id"))
    return wants.join(first, [*keys, "gt_id", "pred_id"]).select(
        *keys, F.col("pred_id").cast("bigint").alias("pred_id"), F.col("gt_id").cast("bigint").alias("gt_id")
    )


def _without_surplus_copies(preds, gts, min_iou, keys, classes, copies, cell) -> DataFrame:
    """Drop copies of one box that can never match.

    Copies of one class want the same boxes in the same order, so the k-th best copy matches
    only if all better ones did: ranks beyond the number of partners are certain misses, with
    classes and without. They stay in the result as unmatched, they only leave the pair list.
    """
    where = [*keys, *classes, *"xywh"]
    copied = materialise(preds.groupBy(*where).count().where(F.col("count") > copies).drop("count"))
    if copied.isEmpty():
        return preds
    spots = [*keys, *"xywh"]
    partners = overlapping(
        copied.select(*spots).distinct(), gts.select(*keys, "gt_id", *"xywh"), keys, cell=cell,
        condition=G.iou(G.box_of("a_"), G.box_of("b_")) >= min_iou,
    ).groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in "xywh"]).agg(F.count("*").alias("partners"))
    ranks = ranked(preds.join(copied, where, "left_semi"), where, [F.col("score").desc(), F.col("pred_id").asc()], rank="_rank")
    useful = ranks.join(partners, spots).where(F.col("_rank") <= F.col("partners")).select(*preds.columns)
    return preds.join(copied, where, "left_anti").unionByName(useful)


def with_match(preds: DataFrame, matches: DataFrame, flag: str = "is_tp") -> DataFrame:
    """All predictions with a 0/1 column telling whether they matched."""
    on = [c for c in matches.columns if c != "gt_id"]
    return preds.join(matches.select(*on, F.lit(1).alias(flag)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def match_status(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, **options) -> DataFrame:
    """``tp`` / ``wrong_class`` / ``fp`` per prediction and ``missed`` per free ground-truth box."""
    matches = materialise(greedy_match(preds, gts, min_iou, **options))
    truth = gts.select("gt_id", F.col("category_id").alias("gt_category"))
    # Matches get their class first: all predictions without a match would meet as one null gt_id.
    hits = matches.select("pred_id", "gt_id").join(truth, "gt_id", "left")
    seen = preds.select("image_id", "pred_id", "category_id").join(hits, "pred_id", "left")
    seen = seen.select(
        "image_id", "pred_id", "gt_id",
        F.when(F.col("gt_id").isNull(), "fp").when(F.col("gt_category") == F.col("category_id"), "tp").otherwise("wrong_class").alias("status"),
    )
    missed = gts.join(matches.select("gt_id"), "gt_id", "left_anti").select(
        "image_id", F.lit(None).cast("bigint").alias("pred_id"), "gt_id", F.lit("missed").alias("status")
    )
    return seen.unionByName(missed)


def matched_pairs(preds: DataFrame, gts: DataFrame, min_iou: float = 0.5, **options) -> DataFrame:
    """Matched pairs with both classes, ignoring class while matching."""
    matches = greedy_match(preds, gts, min_iou, **options)
    return (
        matches.join(preds.select("pred_id", F.col("category_id").alias("det_class"), "score"), "pred_id")
        .join(gts.select("gt_id", F.col("category_id").alias("gt_class")), "gt_id")
        .select("image_id", "pred_id", "gt_id", "det_class", "gt_class", "score")
    )

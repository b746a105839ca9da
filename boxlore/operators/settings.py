"""Scores of many settings at once, without a copy of the data per setting.

A detection has few distinct outcomes (class, score, box) under all settings. An outcome is one
row with the set of settings that choose it, as bits in columns ``_b0, _b1, ...`` of 64 each.
Matching and suppression go through outcomes once, best first: of a ground-truth box or a rival
they keep the settings that have taken it, and an outcome takes what is free in its own settings.
A setting picks one outcome per detection, so this is each setting's own greedy order. Curves
count bits. Truth is only ever counted once, and tables grow with outcomes, not with settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxlore.functions import geometry as G
from boxlore.operators.components import in_units
from boxlore.operators.fusion import HOT_ROWS as HOT_FUSION
from boxlore.operators.fusion import _Clusters, hull_units
from boxlore.operators.matching import HOT_ROWS, UNIT_LIMIT, WORTHWHILE, hot_groups
from boxlore.operators.metrics import _ap_of_steps, hybrid_of, truth_counts
from boxlore.operators.spatial import overlapping
from boxlore.operators.suppression import _before, in_doubles, in_groups, peel_cell
from boxlore.session import Scratch, materialise, owner

WORD = (1 << 64) - 1
ROWS = 1 << 20  # of a slice of a curve
FEW = 1_000_000  # classes whose truth counts are sent to every task
CELLS = 1 << 21  # rows times settings that a task unpacks at a time


def words(n: int, prefix: str = "_b") -> list[str]:
    return [f"{prefix}{k}" for k in range(-(-n // 64))]


def bits_at(numbers: Sequence[int], prefix: str = "_b", n: int = 0) -> list[int]:
    """The words of a fixed set of numbers below ``n``, as signed numbers of 64 bits."""
    value = sum(1 << k for k in set(numbers))
    return [((value >> 64 * k & WORD) ^ 1 << 63) - (1 << 63) for k in range(len(words(n, prefix)))]


def bits_of(n: int, cases: Sequence[tuple[Column, Sequence[int]]]) -> list[Column]:
    """The words of the union of the sets of numbers whose condition holds, by plain bit operations."""
    out = [F.lit(0).cast("bigint") for _ in words(n)]
    for holds, numbers in cases:
        for k, word in enumerate(bits_at(numbers, n=n)):
            if word:
                out[k] = out[k].bitwiseOR(F.when(holds, F.lit(word).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def bits_moved(bits: Column, width: int, firsts: Sequence[tuple[Column, int]], n: int) -> list[Column]:
    """The words of a set of ``width`` bits put at each place of ``firsts`` whose condition holds."""
    none = F.lit(0).cast("bigint")
    out = []
    for k in range(len(words(n))):
        word = none
        for holds, first in firsts:
            by = first - 64 * k
            if -width < by < 64:
                moved = F.call_function("shiftleft", bits, F.lit(by)) if by >= 0 else F.call_function("shiftrightunsigned", bits, F.lit(-by))
                word = word.bitwiseOR(F.when(holds, moved).otherwise(none))
        out.append(word)
    return out


def numbered(outcomes: DataFrame, own: Scratch | None = None) -> DataFrame:
    """Outcomes stored with a number ``_o`` each."""
    return (own or owner(outcomes.sparkSession)).keep(outcomes.withColumn("_o", F.monotonically_increasing_id()))


def by_box(outcomes: DataFrame, n: int) -> DataFrame:
    """Distinct outcomes, one row a box: ``_scores`` has its scores with their settings."""
    keys, b = ["image_id", "category_id", "pred_id"], words(n)
    box = [*keys, *"xywh"]
    distinct = outcomes.repartition(*keys).groupBy(*box, "score").agg(*[F.bit_or(c).alias(c) for c in b])
    return distinct.groupBy(*box).agg(F.collect_list(F.struct("score", *b)).alias("_scores"))


def _number(low: list[list[int]]) -> list[int]:
    """Words of 64 bits, column by column, as one Python integer per row."""
    out = [x & WORD for x in low[0]]
    for k, word in enumerate(low[1:], 1):
        out = [a | (x & WORD) << 64 * k for a, x in zip(out, word, strict=True)]
    return out


def _split(values: list[int], n: int) -> list[pa.Array]:
    words_ = [[(v >> 64 * k) & WORD for v in values] for k in range(-(-n // 64))]
    return [pa.array(np.array(w, np.uint64).view(np.int64)) for w in words_]


def any_of(names: Sequence[str]) -> Column:
    return F.array_max(F.array(*[F.when(F.col(c) != 0, 1).otherwise(0) for c in names])) == 1


def suppress_settings(
    preds: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("image_id", "category_id"), *, hot_rows: int = HOT_ROWS, limit: int = UNIT_LIMIT
) -> DataFrame:
    """``preds`` with ``_s``: the thresholds (at most 63, as bits) under which suppression keeps the box.

    Conflicts are listed once, with the thresholds they exceed. Very large groups are peeled once
    for all thresholds: the best box of every small cell that no better one conflicts with at any
    threshold is final, and takes from its neighbours the thresholds they lose.
    """
    n, keys = len(thresholds), list(keys)
    if n > 63:
        raise ValueError("at most 63 thresholds")
    preds = materialise(preds)
    if hot_groups(preds, keys, hot_rows) is None and in_doubles(preds):
        return in_groups(preds, thresholds, keys)
    iou = G.iou_eps(G.box_of("a_"), G.box_of("b_"))
    beaten = sum((F.when(iou > t, 1 << j).otherwise(0) for j, t in enumerate(thresholds)), F.lit(0)).cast("bigint")
    both = F.col("a_alive").bitwiseAND(F.col("b_alive")).bitwiseAND(beaten)
    open_ = preds.select(*keys, "pred_id", "score", *"xywh", F.lit((1 << n) - 1).cast("bigint").alias("alive"))
    hot = hot_groups(open_, keys, hot_rows)
    state = None
    if hot is not None:
        open_, done = _peel_settings(open_, hot, min(thresholds), both, keys, hot_rows)
        state = materialise(open_.select(*keys, "pred_id", "alive").unionByName(done))
    edges = materialise(overlapping(open_, open_, keys, condition=_before("a", "b") & (iou > min(thresholds))).select(
        *keys, F.col("a_score").alias("s"), F.col("a_pred_id").alias("hi"), F.col("b_pred_id").alias("lo"), both.alias("e")).where("e <> 0"))
    lost = _lose(edges, keys, limit)
    stays = preds if state is None else preds.join(state, [*keys, "pred_id"])
    alive = F.lit((1 << n) - 1).cast("bigint") if state is None else F.col("alive")
    out = stays.join(lost, [*keys, "pred_id"], "left")
    return out.select(*preds.columns, alive.bitwiseAND(F.bitwise_not(F.coalesce("_lost", F.lit(0).cast("bigint")))).alias("_s"))


def _lose(edges: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per box the settings it loses, from edges in the order of their better boxes."""
    units = in_units(edges, hot_groups(edges, keys, limit), keys, ["hi"], ["lo"], owner(edges.sparkSession), one_kind=True)
    at = [*keys, "_unit"]
    fields = {f.name: f for f in edges.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], T.StructField("pred_id", fields["lo"].dataType), T.StructField("_lost", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lost, out = None, {}, []
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in at), strict=True)
            for key, hi, lo, e in zip(groups, *(batch.column(c).to_pylist() for c in ("hi", "lo", "e")), strict=True):
                if key != current:
                    out += [(*current[:-1], *x) for x in lost.items()]
                    current, lost = key, {}
                    if len(out) > 10000:
                        yield made(out)
                        out = []
                hit = e & ~lost.get(hi, 0)
                if hit:
                    lost[lo] = lost.get(lo, 0) | hit
        out += [(*current[:-1], *x) for x in lost.items()]
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    ordered = units.repartition(*at).sortWithinPartitions(*at, F.desc("s"), F.asc("hi"))
    return ordered.mapInArrow(run, schema)


def _peel_settings(boxes: DataFrame, hot: DataFrame, least: float, both: Column, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Boxes still open, with the settings they live in, and those decided (``alive`` 0: lost in all)."""
    calm, live = boxes.join(hot, keys, "left_anti"), materialise(boxes.join(hot, keys, "left_semi"))
    iou = G.iou_eps(G.box_of("a_"), G.box_of("b_"))
    done, left = None, live.count()
    while True:
        best = F.min(F.struct((-F.col("score")).alias("k"), "pred_id", "score", *"xywh", "alive")).alias("b")
        heads = live.groupBy(*keys, *peel_cell()).agg(best).select(*keys, "b.pred_id", "b.score", *[f"b.{c}" for c in "xywh"], "b.alive")
        near = materialise(overlapping(heads, live, keys, condition=(iou > least) & (F.col("a_pred_id") != F.col("b_pred_id"))).select(
            *keys, F.col("a_pred_id").alias("head"), F.col("b_pred_id").alias("pred_id"), _before("b", "a").alias("above"), both.alias("e")).where("e <> 0"))
        blocked = near.where("above").select(*keys, "head").distinct()
        kept = materialise(heads.select(*keys, F.col("pred_id").alias("head")).join(blocked, [*keys, "head"], "left_anti"))
        hits = near.join(kept, [*keys, "head"], "left_semi").groupBy(*keys, "pred_id").agg(F.bit_or("e").alias("_e"))
        final = kept.select(*keys, F.col("head").alias("pred_id"), F.lit(True).alias("_final"))
        rest = live.join(final, [*keys, "pred_id"], "left").join(hits, [*keys, "pred_id"], "left")
        rest = materialise(rest.withColumn("alive", F.col("alive").bitwiseAND(F.bitwise_not(F.coalesce("_e", F.lit(0).cast("bigint"))))).drop("_e"))
        decided = rest.where("_final OR alive = 0").select(*keys, "pred_id", "alive")
        done = decided if done is None else done.unionByName(decided)
        live = rest.where("_final IS NULL AND alive <> 0").drop("_final")
        before, left = left, live.count()
        hot = hot_groups(live, keys, hot_rows)
        if hot is None or left > before * (1 - WORTHWHILE):  # not a pile: pairs are few
            return calm.unionByName(live), done
        calm = calm.unionByName(live.join(hot, keys, "left_anti"))
        live = live.join(hot, keys, "left_semi")


def fuse_settings(
    dets: DataFrame, confs: Sequence[float], ious: Sequence[float], weights: Sequence[Sequence[float]], *, source: str = "model_id", hot_rows: int = HOT_FUSION
) -> DataFrame:
    """Best-fit fusion under every score bound, threshold and weighting: distinct fused boxes with their settings.

    Setting (c, t, w) is number ``(c * len(ious) + t) * len(weights) + w``. A weighting decides the
    order of boxes and is a pass of its own; bounds and thresholds share a pass until a box parts
    them: then what is fused so far is copied, and each part goes on with its settings.
    """
    n, n_w = len(confs) * len(ious) * len(weights), len(weights)
    b = words(n)
    usable = dets.where((F.col("score") >= min(confs)) & (F.col("w") > 0) & (F.col("h") > 0))
    usable = materialise(usable.select("image_id", "category_id", F.col("pred_id").cast("bigint").alias("pred_id"), F.col(source).alias("_source"), "score", *"xywh"))
    keys = ["image_id", "category_id"]
    hot = hot_groups(usable, keys, hot_rows)
    units = usable.withColumn("_unit", F.lit(0).cast("bigint"))
    if hot is not None:
        units = units.join(hot, keys, "left_anti").unionByName(hull_units(usable.join(hot, keys, "left_semi"), keys))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    # Boxes are sent once and listed per weighting where they arrive.
    rows = units.repartition(*keys, "_unit").withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(n_w - 1))))
    rows = rows.withColumn("_weight", F.col("score") * F.element_at(F.element_at(table, F.col("_w") + 1), (F.col("_source") + 1).cast("int")))
    # Bits of one weighting: bound by bound, threshold by threshold.
    above = [sum(1 << (i * len(ious) + j) for i in range(len(confs)) for j, t in enumerate(ious) if t == limit) for limit in ious]
    reach = [sum(1 << (i * len(ious) + j) for j in range(len(ious))) for i in range(len(confs))]
    every = (1 << len(confs) * len(ious)) - 1
    share = [(len(w), float(sum(w))) for w in weights]

    def fused(states, w: int) -> Iterator[tuple]:
        found: dict[tuple, int] = {}
        for bits, clusters in states:
            for seed, *box, total, members, _ in clusters.rows():
                key = (seed, *box, total / members * (min(members, share[w][0]) / share[w][1]))
                found[key] = found.get(key, 0) | bits
        for key, bits in found.items():
            yield (*key, sum(1 << (k * n_w + w) for k in range(bits.bit_length()) if bits >> k & 1))

    def step(states, x, y, w, h, weight, src, pred, score):
        takes = sum(r for r, c in zip(reach, confs, strict=True) if score >= c)
        out = []
        for bits, clusters in states:
            take, rest = bits & takes, bits & ~takes
            if rest:
                out.append((rest, clusters))
            if not take:
                continue
            k, iou = clusters.best(x, y, w, h)
            joins = take & sum(a for a, t in zip(above, ious, strict=True) if iou > t) if k is not None else 0
            parts = [(p, at) for p, at in ((joins, k), (take & ~joins, None)) if p]
            for i, (part, at) in enumerate(parts):
                own = clusters if not rest and i == len(parts) - 1 else clusters.copy()
                own.put(at, x, y, w, h, weight, src, pred)
                out.append((part, own))
        return out

    fields = {f.name: f for f in usable.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], T.StructField("pred_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (*"xywh", "score")], *[T.StructField(c, T.LongType()) for c in b]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, out = None, [], []
        for batch in batches:
            groups = zip(*(_listed(batch.column(c)) for c in (*keys, "_unit", "_w")), strict=True)
            cols = [_listed(batch.column(c)) for c in (*"xywh", "_weight", "_source", "pred_id", "score")]
            for key, *values in zip(groups, *cols, strict=True):
                if key != current:
                    if states:
                        out += [(*current[:2], *r) for r in fused(states, current[3])]
                    current, states = key, [(every, _Clusters(0.0, True))]
                    if len(out) > 5000:
                        yield made(out)
                        out = []
                states = step(states, *values)
        if states:
            out += [(*current[:2], *r) for r in fused(states, current[3])]
        if out:
            yield made(out)

    def made(rows_: list[tuple]) -> pa.RecordBatch:
        *columns, bits = zip(*rows_, strict=True)
        return pa.RecordBatch.from_arrays([*[pa.array(x, f.type) for x, f in zip(columns, arrow, strict=False)], *_split(bits, n)], schema=arrow)

    at = [*keys, "_unit", "_w"]
    ordered = rows.sortWithinPartitions(*at, F.desc("_weight"), F.asc("pred_id"))
    return ordered.mapInArrow(run, schema)


def cap_settings(outcomes: DataFrame, n: int, caps: Sequence[int], group: str = "image_id") -> DataFrame:
    """Outcomes under settings and caps: setting i with cap j is number ``i * len(caps) + j``.

    A cap keeps a setting's best rows per group (ties: ``pred_id``). A task counts along a group's
    order and holds one number per setting.
    """
    b, m = words(n), n * len(caps)
    rest = [c for c in outcomes.columns if c not in b]
    out = T.StructType([*[f for f in outcomes.schema.fields if f.name in rest], *[T.StructField(c, T.LongType()) for c in words(m)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, np.zeros(n, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = table.column(group).to_numpy()
            on = _unpacked(table, b, n)
            place = np.cumsum(on, 0, dtype=np.int64)
            first = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            base = np.concatenate([count[None], -np.where(first[:, None] > 0, place[first - 1], 0)])
            place += base[np.searchsorted(first, np.arange(len(keys)), side="right")]
            last, count = keys[-1], place[-1]
            fits = np.stack([on.astype(bool) & (place <= c) for c in caps], 2).reshape(len(keys), m)
            wide = np.zeros((len(keys), 64 * len(words(m))), bool)
            wide[:, :m] = fits
            packed = np.packbits(wide, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(packed[:, k].copy()) for k in range(packed.shape[1])]], names=[*rest, *words(m)])

    ordered = outcomes.repartition(group).sortWithinPartitions(group, F.desc("score"), F.asc("pred_id"))
    return ordered.mapInArrow(run, out).where(any_of(words(m)))


def _listed(column: pa.Array) -> list:
    """Values as Python numbers; by way of NumPy unless some are null, which takes a tenth of the time."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    return column.to_numpy().tolist()


def match_settings(outcomes: DataFrame, pairs: DataFrame, n: int, *, limit: int = UNIT_LIMIT) -> DataFrame:
    """Outcomes with the settings in which they match: ``_t*`` whatever the class, ``_c*`` inside it.

    ``outcomes``: ``image_id, pred_id, category_id, score, _o, _b*`` and the key ``_box``;
    ``pairs``: ``image_id, _box, gt_id, gt_class, iou`` at or above the limit. Pairs and outcomes of
    an image meet in one sorted stream, pairs first, so they are shuffled once and never joined.
    Instead of ``score, _b*``, outcomes may have the ``_scores`` of :func:`by_box`: then a box is
    sent once, and its outcomes are listed where it arrives. Images with more than ``limit`` pairs or outcomes are decided component by component.
    """
    b, hit_any, hit_class = words(n), words(n, "_t"), words(n, "_c")
    own = owner(outcomes.sparkSession)
    narrow = pairs.select("image_id", "_box", "gt_id", "gt_class", "iou")
    listed = "_scores" in outcomes.columns
    own_columns = ["_scores"] if listed else ["score", *b]
    rows = outcomes.select("image_id", "category_id", "pred_id", *own_columns, "_box", "_o")
    hot = hot_groups(narrow, ["image_id"], limit)
    none = F.lit(0).cast("bigint")
    units = in_units(narrow, hot, ["image_id"], ["_box"], ["gt_id"], own)
    large = hot if hot is not None else hot_groups(rows, ["image_id"], limit)
    if large is None:
        rows = rows.withColumn("_unit", none)
    else:
        # A box lies in one component; what has no pair goes anywhere, but not to one task.
        of_box = units.join(large, "image_id", "left_semi").select("image_id", "_box", "_unit").distinct()
        many = rows.join(large, "image_id", "left_semi").join(of_box, ["image_id", "_box"], "left")
        many = many.withColumn("_unit", F.coalesce("_unit", F.xxhash64("_o"))).select(*rows.columns, "_unit")
        rows = rows.join(large, "image_id", "left_anti").withColumn("_unit", none).unionByName(many)
    zero = lambda c: F.lit(0).cast(dict(rows.dtypes)[c]).alias(c)
    score = F.lit(None).cast("double") if listed else F.col("score").cast("double")
    lists = [F.lit(None).cast(rows.schema["_scores"].dataType).alias("_scores")] if listed else [zero(c) for c in b]
    stream = units.select(
        "image_id", "_unit", F.lit(0).alias("_kind"), "_box", F.col("gt_id").cast("bigint").alias("gt_id"), F.col("gt_class").alias("category_id"),
        F.col("iou").cast("double").alias("_s"), zero("pred_id"), zero("_o"), *lists,
    ).unionByName(rows.select(
        "image_id", "_unit", F.lit(1).alias("_kind"), "_box", none.alias("gt_id"), "category_id", score.alias("_s"), "pred_id", "_o", *own_columns[-len(lists):]))
    at = ["image_id", "_unit"]
    stream = stream.repartition(*at)
    if listed:
        e = F.col("_e")
        stream = stream.withColumn("_e", F.explode_outer("_scores")).withColumns({
            "_s": F.when(F.col("_kind") == 0, F.col("_s")).otherwise(e["score"].cast("double")), **{c: F.coalesce(e[c], none) for c in b}}).drop("_e", "_scores")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = unit = None
        found: dict = {}
        taken: dict = {}
        taken_class: dict = {}
        for batch in batches:
            won, won_class = [], []
            cols = [_listed(batch.column(c)) for c in (*at, "_kind", "_box", "gt_id", "category_id")]
            low = [_listed(batch.column(c)) for c in b]
            for img, u, kind, box, gt, own_class, active in zip(*cols, low[0] if len(low) == 1 else _number(low), strict=True):
                if u != unit or img != image:
                    image, unit = img, u
                    found, taken, taken_class = {}, {}, {}
                if not kind:
                    if box is not None:
                        found.setdefault(box, []).append((gt, own_class))
                    continue
                any_ = class_ = 0
                left = left_class = active
                for gt, gt_class in found.get(box, ()):
                    if left:
                        got = left & ~taken.get(gt, 0)
                        if got:
                            taken[gt] = taken.get(gt, 0) | got
                            left ^= got
                            any_ |= got
                    if left_class and own_class == gt_class and gt_class is not None:
                        got = left_class & ~taken_class.get(gt, 0)
                        if got:
                            taken_class[gt] = taken_class.get(gt, 0) | got
                            left_class ^= got
                            class_ |= got
                won.append(any_)
                won_class.append(class_)
            if won:
                mine = batch.filter(pa.compute.equal(batch.column("_kind"), 1))
                yield pa.RecordBatch.from_arrays([*[mine.column(c) for c in ("image_id", "category_id", "pred_id", "_s", *b)], *_split(won, n), *_split(won_class, n)], names=[*kept, *hit_any, *hit_class])

    kept = ["image_id", "category_id", "pred_id", "score", *b]
    fields = {f.name: f for f in stream.schema.fields}
    schema = T.StructType([*[T.StructField(c, fields["_s" if c == "score" else c].dataType) for c in kept], *[T.StructField(c, T.LongType()) for c in (*hit_any, *hit_class)]])
    order = [*at, "_kind", F.desc("_s"), F.asc("pred_id"), F.asc("_o"), F.asc("gt_id")]
    return stream.sortWithinPartitions(*order).mapInArrow(run, schema)


def _unpacked(table: pa.Table, names: Sequence[str], n: int) -> np.ndarray:
    """Rows by settings, 0 or 1."""
    both = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], 1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(len(both), -1), axis=1, bitorder="little")[:, :n]


def _reached(recall: np.ndarray) -> np.ndarray:
    """How many of the recall thresholds i * 0.01 each recall reaches."""
    near = np.floor(recall * 100).astype(np.int64)
    fits = lambda i: (i <= 100) & (i * 0.01 <= recall)
    return np.where(fits(near + 1), near + 2, np.where(fits(near), near + 1, np.where(fits(near - 1), near, np.maximum(near - 1, 0))))


def _in_order(rows: pa.Table, words_: Sequence[str], flags: Sequence[str], by_class: bool) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Groups and truth of a slice's rows in curve order, and their words of bits: all rows as group 0, or class by class.

    Of rows that share even their id those that match come first, as matching went through them.
    """
    if by_class:
        rows = rows.filter(pa.compute.is_valid(rows.column("n_gt")))
    columns = [-np.bitwise_or.reduce([rows.column(c).to_numpy() != 0 for c in flags]).astype(np.int8)]
    columns += [rows.column("pred_id").to_numpy(), rows.column("image_id").to_numpy(), -rows.column("score").to_numpy()]
    if by_class:
        columns.append(rows.column("category_id").to_numpy())
    order = np.lexsort(columns)
    group = columns[-1][order].astype(np.int64) if by_class else np.zeros(len(order), np.int64)
    truth = rows.column("n_gt" if by_class else "n_all").to_numpy()[order]
    return group, truth, {c: rows.column(c).to_numpy()[order] for c in (*words_, *flags)}


def _bit(held: dict[str, np.ndarray], names: list[str], i: int) -> np.ndarray:
    return (held[names[i // 64]] >> (i % 64)) & 1


_CURVES = (("_t", False), ("_c", True))


def _totals(n: int):
    """Rows and hits of a slice per curve, group and setting."""
    b = words(n)

    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("_curve", "_group", "config_id", "n", "t")}
        where = rows.column("_slice")[0].as_py() if rows.num_rows else 0
        for curve, (flag, by_class) in enumerate(_CURVES):
            t = words(n, flag)
            group, _, held = _in_order(rows, b, t, by_class)
            if not len(group):
                continue
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for i in range(n):
                seen, hits = np.add.reduceat(_bit(held, b, i), first), np.add.reduceat(_bit(held, t, i), first)
                some = np.flatnonzero(seen)
                for c, x in zip(out, (np.full(len(some), curve), group[first[some]], np.full(len(some), i), seen[some], hits[some]), strict=True):
                    out[c].append(x)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()).cast(k) for x, k in zip(out.values(), kinds, strict=True)]
        return pa.table([pa.array(np.full(len(columns[0]), where), pa.int32()), *columns], names=["_slice", *out])

    return run


def _steps_of(n: int):
    """The best precision per curve, group, setting and number of recall thresholds reached, of one slice.

    ``starts``: rows and hits before the slice per setting, of the groups that began earlier. A
    setting's hits stand in order of group and recall, so the best of each step is a run's maximum.
    """
    b = words(n)

    def run(key, rows: pa.Table, starts: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("_curve", "_group", "config_id", "_k", "_p")}
        begun = {c: starts.column(c).to_numpy() for c in ("_curve", "_group", "config_id", "n0", "t0")}
        for curve, (flag, by_class) in enumerate(_CURVES):
            t = words(n, flag)
            group, truth, held = _in_order(rows, b, t, by_class)
            if not len(group):
                continue
            change = np.concatenate([[True], group[1:] != group[:-1]])
            first, number = np.flatnonzero(change), np.cumsum(change) - 1
            mine = begun["_curve"] == curve
            early = {c: x[mine] for c, x in begun.items()}
            spot = np.minimum(np.searchsorted(group[first], early["_group"]), len(first) - 1)
            fits = group[first][spot] == early["_group"]
            early, spot = {c: x[fits] for c, x in early.items()}, spot[fits]
            by = np.argsort(early["config_id"], kind="stable")
            cut = np.searchsorted(early["config_id"][by], np.arange(n + 1))
            for i in range(n):
                hit = np.flatnonzero(_bit(held, t, i))
                if not len(hit):
                    continue
                seen = np.cumsum(_bit(held, b, i))
                # A group counts from its own start: what was counted before it in this slice, or carried over.
                rows0, hits0 = np.concatenate([[0], seen[first[1:] - 1]]), np.searchsorted(hit, first)
                some = by[cut[i] : cut[i + 1]]
                n0, t0 = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
                n0[spot[some]], t0[spot[some]] = early["n0"][some], early["t0"][some]
                of = number[hit]
                good = np.arange(1, len(hit) + 1) + (t0 - hits0)[of]
                total = seen[hit] + (n0 - rows0)[of]
                k = _reached(good / truth[hit])
                run_ = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (of[1:] != of[:-1])]))
                best = np.maximum.reduceat(good / total, run_)
                for c, x in zip(found, (np.full(len(run_), curve), group[hit[run_]], np.full(len(run_), i), k[run_], best), strict=True):
                    found[c].append(x)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array(np.concatenate(x) if x else [], k, safe=False) if k != pa.float64() else pa.array(np.concatenate(x) if x else [], k) for x, k in zip(found.values(), kinds, strict=True)], names=list(found))

    return run


def curves(flagged: DataFrame, per_class: DataFrame, total: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AP per setting that has hits, the same per class, and how many rows each setting has.

    Rows are stored once, in slices of the score order, as in :mod:`ranking`, one bucket file a
    slice: both curves read them there without another shuffle. A slice counts on from what the
    slices before it have counted. Classes without truth have no curve.
    """
    b, t, c = words(n), words(n, "_t"), words(n, "_c")
    slices = max(int(flagged.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-flagged.count() // ROWS))
    order = [F.desc("score"), "image_id", "pred_id"]
    cut = flagged.select("image_id", "category_id", "pred_id", "score", *b, *t, *c).repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    cut = owner(flagged.sparkSession).keep(cut, ("_slice", slices))
    rows = cut.join(F.broadcast(per_class), "category_id", "left") if per_class.count() <= FEW else cut.join(per_class, "category_id", "left")
    rows = rows.withColumn("n_all", total.select("n_gt").scalar())
    sums = materialise(rows.groupBy("_slice").applyInArrow(_totals(n), "_slice int, _curve int, _group bigint, config_id int, n bigint, t bigint"))
    before = W.partitionBy("_curve", "_group", "config_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_slice", "_curve", "_group", "config_id", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in "nt"]).where("n0 > 0")
    met = rows.groupBy("_slice").cogroup(starts.groupBy("_slice"))
    steps = met.applyInArrow(_steps_of(n), "_curve int, _group bigint, config_id int, _k int, _p double")
    steps = materialise(steps.where("_k > 0").groupBy("_curve", "config_id", "_group", "_k").agg(F.max("_p").alias("_p")))
    ap = _ap_of_steps(steps, steps.select("_curve", "config_id", "_group").distinct(), ["_curve", "config_id", "_group"])
    sizes = sums.where("_curve = 0").groupBy("config_id").agg(F.sum("n").alias("n_preds"))
    return ap.where("_curve = 0"), ap.where("_curve = 1"), sizes


def score_settings(outcomes: DataFrame, pairs: DataFrame, gts: DataFrame, n: int, **options) -> DataFrame:
    """``config_id, detection_map, classification_map, hybrid, n_preds`` of settings 0 to n - 1."""
    flagged = materialise(match_settings(outcomes, pairs, n, **options))
    per_class = materialise(truth_counts(gts, ["category_id"]))
    total = per_class.agg(F.coalesce(F.sum("n_gt"), F.lit(0)).alias("n_gt"), F.count("*").alias("n_classes"))
    det, cls, sizes = curves(flagged, per_class, total, n)
    mean = cls.groupBy("config_id").agg(F.sum("ap").alias("_sum"))
    every = flagged.sparkSession.range(n).select(F.col("id").cast("int").alias("config_id"))
    joined = every.join(det.select("config_id", F.col("ap").alias("_det")), "config_id", "left").join(mean, "config_id", "left").join(sizes, "config_id", "left")
    classes = total.select("n_classes").scalar()
    det_map = F.coalesce("_det", F.lit(0.0))
    cls_map = F.when(classes > 0, F.coalesce("_sum", F.lit(0.0)) / classes).otherwise(F.lit(0.0))
    return joined.select("config_id", det_map.alias("detection_map"), cls_map.alias("classification_map"), hybrid_of(det_map, cls_map).alias("hybrid"), F.coalesce("n_preds", F.lit(0)).alias("n_preds"))

"""Label errors from embeddings or detectors, and applying corrections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions.scalars import l2_normalise
from boxlore.operators.ranking import ranked
from boxlore.session import materialise

# Numbers of a block of references, and of a slice of crops, that a task holds: 32 MB as doubles.
MAX_NUMBERS = 4_000_000


def reference_centroid(views: DataFrame) -> DataFrame:
    """Mean of the normalised view vectors per class, normalised again.

    Averages are taken per (class, position), so a class with very many views combines before
    the shuffle; only the finished positions of one vector are put back together.
    """
    unit = views.select("category_id", F.posexplode(l2_normalise(F.col("embedding").cast("array<double>"))).alias("pos", "v"))
    means = unit.groupBy("category_id", "pos").agg(F.avg("v").alias("v"))
    vectors = means.groupBy("category_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return vectors.select("category_id", l2_normalise(F.transform("m", lambda s: s["v"])).alias("centroid"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _score_block(k: int):
    """Best ``k`` references of a block for each crop of a slice, and the crop's own one if the block has it."""

    def run(key, crops: pa.Table, block: pa.Table) -> pa.Table:
        if not len(crops) or not len(block):
            return pa.table({"ann_id": pa.array([], pa.int64()), "gt_cat": pa.array([], pa.int32()), "gt_sim": pa.array([], pa.float64()), "cats": pa.array([], pa.list_(pa.int32())), "sims": pa.array([], pa.list_(pa.float64()))})
        block = block.sort_by("category_id")
        ids, vectors = block.column("category_id").to_numpy(), _matrix(crops.column("embedding"))
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        sims = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0) @ _matrix(block.column("centroid")).T
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        own = crops.column("gt_cat").to_pylist()
        known = {c: i for i, c in enumerate(ids.tolist())}
        at = np.array([known.get(c, -1) for c in own])
        ends = pa.array(np.arange(len(crops) + 1) * top.shape[1], pa.int32())
        return pa.table({
            "ann_id": crops.column("ann_id"), "gt_cat": crops.column("gt_cat"), "gt_sim": pa.array(sims[np.arange(len(crops)), np.maximum(at, 0)], mask=at < 0),
            "cats": pa.ListArray.from_arrays(ends, pa.array(ids[top].reshape(-1).astype(np.int32))), "sims": pa.ListArray.from_arrays(ends, pa.array(np.take_along_axis(sims, top, axis=1).reshape(-1))),
        })

    return run


def topk_similarity(crops: DataFrame, centroids: DataFrame, k: int = 3, max_numbers: int = MAX_NUMBERS) -> DataFrame:
    """Similarity rows per crop: own similarity (-1 without a reference), best ``k`` classes, suspicion.

    Suspicion is the best similarity minus the own one; equal similarities order by class id.
    References are numbered into blocks and crops dealt into slices, each of at most
    ``max_numbers`` numbers; every slice meets every block in a task of its own, and the winners of
    the blocks are merged per crop. Nothing of either side passes the driver.
    """
    spark = crops.sparkSession
    centroids = materialise(centroids.select("category_id", "centroid"))
    shape = centroids.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    if not shape.n:
        raise ValueError("no reference centroids")
    per_block = max(1, max_numbers // shape.dim)
    n_blocks = -(-shape.n // per_block)
    n_slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-crops.count() * shape.dim // max_numbers))
    blocks = centroids.withColumn("_block", F.lit(0))
    if n_blocks > 1:
        blocks = ranked(centroids, [], [F.col("category_id").asc()], rank="_rank").withColumn("_block", F.floor((F.col("_rank") - 1) / per_block).cast("int")).drop("_rank")
    rows = crops.select("ann_id", F.col("category_id").cast("int").alias("gt_cat"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("ann_id", "embedding"), F.lit(n_slices)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    every = blocks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    met = rows.groupBy("_slice", "_block").cogroup(every.groupBy("_slice", "_block"))
    parts = met.applyInArrow(_score_block(k), "ann_id bigint, gt_cat int, gt_sim double, cats array<int>, sims array<double>")
    if n_blocks > 1:
        pairs = parts.select("ann_id", "gt_cat", "gt_sim", F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("cats").alias("c")).alias("z"))
        merged = pairs.groupBy("ann_id", "gt_cat").agg(
            F.max("gt_sim").alias("gt_sim"), F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
        parts = merged.select("ann_id", "gt_cat", "gt_sim", F.col("z.c").alias("cats"), F.transform("z.s", lambda s: -s).alias("sims"))
    gt = F.coalesce("gt_sim", F.lit(-1.0))
    wide = []
    for i in range(k):
        wide += [F.get("cats", F.lit(i)).alias(f"top{i + 1}_cat"), F.get("sims", F.lit(i)).alias(f"top{i + 1}_sim")]
    return parts.select("ann_id", "gt_cat", gt.alias("gt_sim"), (F.get("sims", F.lit(0)) - gt).alias("suspicion"), *wide)


def nearest_reference(crops: DataFrame, centroids: DataFrame, **options) -> DataFrame:
    return topk_similarity(crops, centroids, k=1, **options).select(
        "ann_id", "gt_cat", "gt_sim", F.col("top1_cat").alias("best_cat"), F.col("top1_sim").alias("best_sim"))


def embedding_corrections(nearest: DataFrame, corrected: DataFrame, min_sim: float = 0.25, margin: float = 0.05) -> DataFrame:
    """Relabel proposals; classes known as clean (corrected count 0) are left alone.

    ``corrected``: ``category_id, corrected_count``; classes absent from it count as unknown.
    """
    gt, best = F.col("gt_sim"), F.col("best_sim")
    rows = nearest.join(corrected.select(F.col("category_id").alias("gt_cat"), "corrected_count"), "gt_cat", "left")
    keep = (F.col("best_cat") != F.col("gt_cat")) & (best >= min_sim) & ((gt < 0) | (best - gt >= margin))
    return rows.where(keep & (F.coalesce("corrected_count", F.lit(-1)) != 0)).select(
        "ann_id", F.col("gt_cat").alias("old_cat"), F.col("best_cat").alias("new_cat"),
        F.round(gt, 4).alias("gt_sim"), F.round(best, 4).alias("best_sim"),
        F.when(gt >= 0, F.round(best - gt, 4)).alias("margin"))


def apply_corrections(anns: DataFrame, corrections: DataFrame, ordinal: str | None = None, guard: bool = False) -> DataFrame:
    """New classes where a correction exists; no row is ever removed.

    The correction with the highest ``ordinal`` wins. ``guard`` applies one only if its old
    class is the current class.
    """
    order = F.col(ordinal) if ordinal else F.lit(0)
    last = corrections.groupBy("ann_id").agg(F.max(F.struct(order.alias("o"), "new_cat", "old_cat")).alias("c"))
    joined = anns.join(last, "ann_id", "left")
    new = F.col("c.new_cat")
    if guard:
        new = F.when(F.col("c.old_cat") == F.col("category_id"), new)
    return joined.select(
        *[c for c in anns.columns if c != "category_id"],
        F.coalesce(new, F.col("category_id")).alias("category_id"),
        F.coalesce(new != F.col("category_id"), F.lit(False)).alias("changed"))


def label_flow(corrections: DataFrame, direction: str, k: int = 20) -> DataFrame:
    """Classes losing (``old_cat``) or gaining (``new_cat``) most annotations."""
    return corrections.groupBy(F.col(direction).alias("category_id")).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), F.col("category_id").asc()).limit(k)


def count_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classes whose annotation count changed, largest change first."""
    b = before.groupBy("category_id").agg(F.count("*").alias("n_before"))
    a = after.groupBy("category_id").agg(F.count("*").alias("n_after"))
    both = b.join(a, "category_id", "full").select(
        "category_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    both = both.withColumn("diff", F.col("n_after") - F.col("n_before"))
    return both.where(F.col("diff") != 0).orderBy(F.abs("diff").desc(), F.col("category_id").asc())


def review_queue(
    sims: DataFrame, anns: DataFrame, images: DataFrame, cats: DataFrame, corrected: DataFrame, min_suspicion: float, k: int
) -> DataFrame:
    """What a reviewer sees first: suspicious items with a reference, then those without.

    Crops under five pixels leave after the limit, so fewer than ``k`` rows can remain.
    """
    has_ref = F.col("gt_sim") >= 0
    queue = (
        sims.where(~has_ref | (F.col("suspicion") >= min_suspicion))
        .withColumn("queue", F.when(has_ref, 0).otherwise(1))
        .orderBy(F.col("queue").asc(), F.col("suspicion").desc(), F.col("ann_id").asc()).limit(k)
    )
    queue = queue.select("ann_id", "queue", "gt_cat", "gt_sim", "suspicion", "top1_cat", "top1_sim", "top2_cat", "top3_cat")
    rows = queue.join(anns.select("ann_id", "image_id", *"xywh"), "ann_id").join(images, "image_id")
    rows = rows.where(G.crop_usable(G.crop_rect(G.box_of(), F.col("width"), F.col("height")), 5))
    for col in ("gt", "top1", "top2", "top3"):
        name = cats.select(F.col("category_id").alias(f"{col}_cat"), F.col("name").alias(f"{col}_name"))
        rows = rows.join(name, f"{col}_cat", "left").withColumn(
            f"{col}_name", F.coalesce(f"{col}_name", F.concat(F.lit("Unknown ("), F.col(f"{col}_cat").cast("string"), F.lit(")"))))
    rows = rows.join(corrected.select(F.col("category_id").alias("gt_cat"), "corrected_count"), "gt_cat", "left")
    tier = F.when(F.col("suspicion") > 0.2, "high").when(F.col("suspicion") > 0.1, "med").otherwise("low")
    return rows.select(
        "ann_id", "queue", "file_name", "gt_cat", "gt_name", "gt_sim", F.round("suspicion", 4).alias("suspicion"), tier.alias("tier"),
        F.coalesce(F.col("corrected_count").cast("string"), F.lit("N/A")).alias("corrected"),
        "top1_cat", "top1_name", "top1_sim", "top2_name", "top3_name")

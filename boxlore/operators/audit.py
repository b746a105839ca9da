"""Counts and distributions of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.functions.scalars import bucket_label, bucket_ordinal
from boxlore.operators.ranking import ranked

# The ranges that reports are made in, and the area below which a box is tiny.
FREQUENCY_BUCKETS = [(1, 1), (2, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, 500), (501, 1000)]
TINY_AREA = 1024.0


def dataset_summary(images: DataFrame, anns: DataFrame, cats: DataFrame) -> DataFrame:
    """One row of counts; class ids count as sequential when none is missing between the ends."""
    c = F.col("category_id")
    return cats.agg(
        F.count("*").alias("n_categories"), F.min(c).alias("min_category"), F.max(c).alias("max_category"),
        (F.max(c) - F.min(c) + 1 == F.countDistinct(c)).alias("sequential"),
    ).select(
        images.agg(F.count("*")).scalar().alias("n_images"), anns.agg(F.count("*")).scalar().alias("n_annotations"), "*")


def image_stats(images: DataFrame) -> DataFrame:
    mp = F.col("width").cast("double") * F.col("height") / F.lit(1e6)
    out = []
    for name, col in (("width", F.col("width")), ("height", F.col("height")), ("megapixels", mp)):
        out += [F.min(col).alias(f"min_{name}"), F.max(col).alias(f"max_{name}"), F.avg(col).alias(f"mean_{name}")]
    return images.agg(*out)


def anns_per_image(anns: DataFrame) -> DataFrame:
    per = anns.groupBy("image_id").agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("min_boxes"), F.max("n").alias("max_boxes"), F.avg("n").alias("mean_boxes"))


def category_frequency(anns: DataFrame) -> DataFrame:
    return anns.groupBy("category_id").agg(F.count("*").alias("n"))


def frequency_histogram(counts: DataFrame) -> DataFrame:
    """Classes per frequency range; empty ranges are absent, counts above the last range too."""
    n = F.col("n")
    return counts.where(bucket_label(n, FREQUENCY_BUCKETS).isNotNull()).groupBy(
        bucket_ordinal(n, FREQUENCY_BUCKETS).alias("ordinal"), bucket_label(n, FREQUENCY_BUCKETS).alias("bucket")
    ).agg(F.count("*").alias("n_categories"))


def singletons(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") == 1)


def order_statistics(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with the number of rows at or below each: exact order statistics at any size."""
    return ranked(df.groupBy(col).agg(F.count("*").alias("n")), [], [F.col(col).asc()], {"n": "upto"}).select(col, "upto")


def area_stats(anns: DataFrame) -> DataFrame:
    """Box areas with the upper median (the element at position n // 2) and the share of tiny boxes."""
    areas = anns.select((F.col("w") * F.col("h")).alias("area"))
    stats = areas.agg(
        F.count("*").alias("n"), F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.avg("area").alias("mean_area"),
        F.count_if(F.col("area") < TINY_AREA).alias("n_tiny"))
    half = areas.agg(F.floor(F.count("*") / 2.0)).scalar()
    median = order_statistics(areas, "area").where(F.col("upto") > half).agg(F.min("area")).scalar()
    return stats.select(
        "*", median.alias("median_area"), (F.lit(100.0) * F.col("n_tiny") / F.greatest(F.col("n"), F.lit(1))).alias("tiny_percent"))


def percentile_linear(df: DataFrame, col: str, q: float):
    """Scalar column: the exact percentile with linear interpolation between neighbours."""
    order = order_statistics(df, col)
    position = df.agg((F.count(col) - 1) * F.lit(q)).scalar()
    low = order.where(F.col("upto") > F.floor(position)).agg(F.min(col)).scalar()
    high = order.where(F.col("upto") > F.ceil(position)).agg(F.min(col)).scalar()
    return low + (high - low) * (position - F.floor(position))


def runtime_stats(runs: DataFrame, col: str = "seconds", stage: str | None = None, q: float = 0.95) -> DataFrame:
    """Mean, p95 and maximum, per value of ``stage`` if given, plus the time 50 images would take.

    The percentile is exact: it lies between two values whose ranks come from one pass over the
    distinct values of all stages.
    """
    keys = [stage or "_all"]
    runs = runs if stage else runs.withColumn("_all", F.lit(0))
    known = runs.where(F.col(col).isNotNull())
    totals = runs.groupBy(*keys).agg(F.avg(col).alias("mean_sec"), F.max(col).alias("max_sec"), (F.avg(col) * 50).alias("sec_for_50"), ((F.count(col) - 1) * F.lit(q)).alias("_at"))
    order = ranked(known.groupBy(*keys, col).agg(F.count("*").alias("n")), keys, [F.col(col).asc()], {"n": "_upto"}).select(*keys, F.col(col).alias("_v"), "_upto")
    both = totals.join(order, keys, "left")
    least = lambda edge: F.min(F.when(F.col("_upto") > edge, F.col("_v")))
    low, high = least(F.floor("_at")), least(F.ceil("_at"))
    named = [*([stage] if stage else []), "mean_sec", "max_sec", "sec_for_50"]
    return both.groupBy(*keys, *[c for c in named if c != stage], "_at").agg(low.alias("_low"), high.alias("_high")).select(
        *named, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("p95_sec"))


def match_totals(status: DataFrame) -> DataFrame:
    """Status counts per image and, with a NULL image, in total. Input: ``match_status``."""
    s = F.col("status")
    return status.rollup("image_id").agg(
        F.count_if(s == "tp").alias("tp"), F.count_if(s == "wrong_class").alias("wrong_class"),
        F.count_if(s == "fp").alias("fp"), F.count_if(s == "missed").alias("missed"),
        F.count_if(F.col("gt_id").isNotNull()).alias("n_gt"))


def crop_accuracy(pairs: DataFrame) -> DataFrame:
    """Matched pairs with classifier answers: how often detector and classifier are right."""
    gt = F.col("gt_class")
    hit = {"det": F.col("det_class") == gt, "cls": F.col("cls") == gt, "cls3": F.array_contains("cls_top3", gt)}
    counts = pairs.agg(F.count("*").alias("matched"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{k}_correct") for k, c in hit.items()])
    return counts.select("*", *[
        F.when(F.col("matched") > 0, F.col(f"{k}_correct") / F.col("matched")).otherwise(F.lit(0.0)).alias(f"{k}_accuracy") for k in hit])


def fixed_broke(pairs: DataFrame) -> DataFrame:
    det, cls = F.col("det_class") == F.col("gt_class"), F.col("cls") == F.col("gt_class")
    return pairs.agg(F.count_if(~det & cls).alias("fixed"), F.count_if(det & ~cls).alias("broke")).withColumn("net", F.col("fixed") - F.col("broke"))


def crop_distribution(train_counts: DataFrame) -> DataFrame:
    """Classes per range of training crops."""
    # Fixed values.
    ranges = [(1, 1), (2, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, None)]
    n = F.col("n")
    return train_counts.where(n > 0).groupBy(bucket_ordinal(n, ranges).alias("ordinal"), bucket_label(n, ranges).alias("bucket")).agg(
        F.count("*").alias("n_categories"))

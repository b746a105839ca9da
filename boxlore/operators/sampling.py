"""Splits, oversampling, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions.scalars import crop_name, mixed, unit
from boxlore.operators.ranking import cap_per_group, ranked

UNKNOWN = "unknown_product"


def sole_source_images(anns: DataFrame) -> DataFrame:
    """Images that alone show some class. Least and greatest image are equal exactly then."""
    span = anns.groupBy("category_id").agg(F.min("image_id").alias("image_id"), F.max("image_id").alias("_last"))
    return span.where(F.col("image_id") == F.col("_last")).select("image_id").distinct()


def val_split(images: DataFrame, anns: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``image_id, split``: sole-source images train, a repeatable choice of the others validates."""
    wanted = images.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share)))).scalar()
    free = images.select("image_id").join(sole_source_images(anns), "image_id", "left_anti")
    order = [F.col("_o").asc(), F.col("image_id").asc()]
    picked = ranked(free.withColumn("_o", mixed(F.col("image_id"), seed)), [], order, rank="_rank").where(F.col("_rank") <= wanted)
    marks = picked.select("image_id", F.lit("val").alias("split"))
    return images.select("image_id").join(marks, "image_id", "left").select("image_id", F.coalesce("split", F.lit("train")).alias("split"))


def all_data_split(images: DataFrame, n_val: int = 10, stored_val: DataFrame | None = None) -> DataFrame:
    """Every image trains; the ``n_val`` lowest (stored) ids validate too."""
    pool = images if stored_val is None else images.join(stored_val, "image_id", "left_semi")
    val = pool.select("image_id").orderBy("image_id").limit(n_val)
    return images.select("image_id", F.lit("train").alias("split")).unionByName(val.select("image_id", F.lit("val").alias("split")))


def split_difference(images: DataFrame, val: DataFrame) -> DataFrame:
    return images.select("image_id").join(val, "image_id", "left_anti")


def boost_table(
    cats: DataFrame, counts: DataFrame, products: DataFrame, *, rare: int = 5, tail: int = 10, rare_repeat: int = 6, tail_repeat: int = 3,
    high: float = 0.5, mid: float = 0.3, high_repeat: int = 4, mid_repeat: int = 3, min_corrected: int = 5, max_repeat: int = 6,
) -> DataFrame:
    """Repeat factor per class from its rarity and its share of corrected labels.

    ``products``: ``product_name, corrected_count, annotation_count``, one row per name.
    """
    meta = products.select(F.col("product_name").alias("name"), "corrected_count", F.col("annotation_count").alias("_meta"))
    rows = cats.join(counts, "category_id", "left").join(meta, "name", "left")
    n, corrected = F.coalesce("n", F.lit(0)), F.coalesce("corrected_count", F.lit(0))
    seen = F.when(F.coalesce("_meta", F.lit(0)) != 0, F.col("_meta")).otherwise(n)
    rows = rows.select("category_id", "name", n.alias("n"), corrected.alias("corrected_count"), F.when(seen != 0, corrected / seen).otherwise(F.lit(0.0)).alias("_f"))
    n, f = F.col("n"), F.col("_f")
    eligible = (F.col("name") != UNKNOWN) & (F.col("corrected_count") >= min_corrected)
    is_rare, is_tail = (n > 0) & (n <= rare), (n > rare) & (n <= tail)
    is_high, is_mid = eligible & (f >= high), eligible & (f < high) & (f >= mid)
    factor = lambda c, v: F.when(c, v).otherwise(1)
    repeat = F.greatest(factor(is_rare, rare_repeat), factor(is_tail, tail_repeat), factor(is_high, high_repeat), factor(is_mid, mid_repeat))
    # The texts of the reasons are fixed values.
    reasons = F.filter(F.array(
        F.when(is_rare, f"rare<={rare}"), F.when(is_tail, f"tail<={tail}"),
        F.when(is_high, f"corr>={high:.2f}"), F.when(is_mid, f"corr>={mid:.2f}")), lambda r: r.isNotNull())
    return rows.select(
        "category_id", "name", "n", "corrected_count", F.round(f, 4).alias("correction_fraction"),
        F.least(repeat, F.lit(max_repeat)).alias("repeat"), reasons.alias("reasons"))


def image_repeats(
    images: DataFrame, anns: DataFrame, boost: DataFrame, *, min_boosted: int = 3, min_share: float = 0.12, isolated_repeat: int = 2, strong_floor: int = 4
) -> DataFrame:
    """How often every training image is shown, with the share of boosted boxes and their sources.

    A source is a boosted class of the image: ``category_id, name, repeat, reasons`` and its boxes.
    """
    # Boxes are counted per class first, so an image's row is as long as it has classes.
    classes = anns.groupBy("image_id", "category_id").agg(F.count("*").alias("boxes"))
    source = F.struct("category_id", "name", "repeat", "reasons", "boxes")
    per = classes.join(boost.select("category_id", "name", "repeat", "reasons"), "category_id").groupBy("image_id").agg(
        F.sum("boxes").alias("n"), F.sum(F.when(F.col("repeat") > 1, F.col("boxes")).otherwise(0)).alias("boosted"), F.max("repeat").alias("strongest"),
        F.array_sort(F.collect_list(F.when(F.col("repeat") > 1, source))).alias("sources"))
    rows = images.select("image_id", "file_name").join(per, "image_id", "left").select(
        "image_id", "file_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("boosted", F.lit(0)).alias("boosted"),
        F.coalesce("strongest", F.lit(1)).alias("strongest"), F.coalesce("sources", F.array().cast(dict(per.dtypes)["sources"])).alias("sources"))
    share = F.col("boosted") / F.greatest(F.col("n"), F.lit(1))
    repeat = (
        F.when((F.col("strongest") > 1) & ((F.col("boosted") >= min_boosted) | (share >= min_share)), F.col("strongest"))
        .when(F.col("strongest") >= strong_floor, F.lit(max(1, isolated_repeat))).otherwise(F.lit(1)))
    return rows.select(
        "image_id", "file_name", repeat.cast("int").alias("repeat"), "n", "boosted", F.round(share, 4).alias("boost_share"), "sources")


def oversample(repeats: DataFrame) -> DataFrame:
    return repeats.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeat"))))


def boost_report(boost: DataFrame, repeats: DataFrame) -> DataFrame:
    return repeats.agg(
        F.count("*").alias("n_images"), F.sum("repeat").cast("bigint").alias("entries"), F.count_if(F.col("repeat") > 1).alias("repeated_images")
    ).select(
        "*", F.round(F.col("entries") / F.greatest(F.col("n_images"), F.lit(1)), 4).alias("oversample_factor"),
        boost.agg(F.count_if(F.col("repeat") > 1)).scalar().alias("boosted_classes"))


def boosted_classes(boost: DataFrame) -> DataFrame:
    return boost.where(F.col("repeat") > 1).orderBy(F.col("repeat").desc(), F.col("n").asc(), F.col("category_id").asc())


def repeated_images(repeats: DataFrame, k: int = 100) -> DataFrame:
    return repeats.where(F.col("repeat") > 1).orderBy(F.col("repeat").desc(), F.col("image_id").asc()).limit(k)


def combine_datasets(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Training files of both sources; of equal names the synthetic file stays. Validation stays real."""
    both = real.withColumn("source", F.lit("real")).unionByName(synthetic.withColumn("source", F.lit("synthetic")))
    rank = F.when(F.col("source") == "synthetic", 1).otherwise(0)
    rest = [c for c in both.columns if c not in ("file_name", "split")]
    train = both.where(F.col("split") == "train").groupBy("file_name", "split").agg(F.max(F.struct(rank.alias("_r"), *rest)).alias("b"))
    train = train.select("file_name", "split", *[F.col(f"b.{c}").alias(c) for c in rest])
    return train.unionByName(both.where((F.col("split") == "val") & (F.col("source") == "real")).select(*train.columns))


def combine_counts(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Files per source as copied: overwritten names count twice."""
    return real.agg(
        F.count_if(F.col("split") == "train").alias("real_train"), F.count_if(F.col("split") == "val").alias("val")
    ).select(
        "real_train", synthetic.where(F.col("split") == "train").agg(F.count("*")).scalar().alias("synthetic_train"), "val"
    ).withColumn("total_train", F.col("real_train") + F.col("synthetic_train"))


def jitter_boxes(
    anns: DataFrame, images: DataFrame, count: int = 2, *, pos: float = 0.05, scale: float = 0.10, min_iou: float = 0.6, pad: float = 0.1, seed: int = 42
) -> DataFrame:
    """Up to ``count`` moved and resized variants per box, the first that pass out of three times as many tries."""
    rows = anns.join(images.select("image_id", "width", "height"), "image_id").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3 * count - 1))))
    key = F.col("ann_id") * (3 * count) + F.col("attempt")
    # Rows of their own, or every use of a moved side would draw its numbers again.
    rows = rows.withColumn("_u", F.explode(F.array(F.struct(*[unit(key * 4 + s, seed).alias(f"u{s}") for s in range(4)]))))
    around = lambda s, width: (F.col(f"_u.u{s}") * 2 - 1) * width
    b = G.box_of()
    w, h = b.w * (1 + around(2, scale)), b.h * (1 + around(3, scale))
    moved = G.Box(b.x + around(0, pos) * b.w + (b.w - w) / 2, b.y + around(1, pos) * b.h + (b.h - h) / 2, w, h)
    rows = rows.select("image_id", "ann_id", "category_id", "width", "height", "attempt", *[c.alias("o" + n) for c, n in zip(b, "xywh")], *G.named(moved))
    rect = G.crop_rect(G.box_of(), F.col("width"), F.col("height"), pad)
    good = (G.iou(G.box_of("o"), G.box_of()) >= min_iou) & G.crop_usable(rect, 3)
    kept = cap_per_group(rows.where(good), ["ann_id"], [F.col("attempt").asc()], count)
    return kept.select("image_id", "ann_id", "category_id", "attempt", *"xywh", *[c.alias(n) for c, n in zip(rect, ("x1", "y1", "x2", "y2"))])


def box_crops(anns: DataFrame, images: DataFrame, pad: float = 0.1, min_side: float = 3) -> DataFrame:
    """Padded crop rectangle of every box; ``usable`` is false for tiny boxes and empty crops."""
    b = G.box_of()
    rows = anns.join(images.select("image_id", "width", "height"), "image_id")
    rect = G.crop_rect(b, F.col("width"), F.col("height"), pad)
    ok = (b.w >= min_side) & (b.h >= min_side) & G.crop_usable(rect)
    return rows.select("image_id", "ann_id", "category_id", *[c.alias(n) for c, n in zip(rect, ("x1", "y1", "x2", "y2"))], ok.alias("usable"))


def crop_manifest(anns: DataFrame, images: DataFrame, split: DataFrame, catalogue: DataFrame, variants: int = 5, jitter: int = 2) -> DataFrame:
    """One row per training crop to cut: boxes, moved boxes of training images, catalogue pictures and their variants.

    ``catalogue``: ``category_id, stem``.
    """
    def line(df: DataFrame, kind: str, name: Column, *rect: Column) -> DataFrame:
        rect = rect or tuple(F.lit(None).cast("int") for _ in range(4))
        return df.select(F.lit(kind).alias("kind"), "split", "category_id", name.alias("name"), *[c.alias(n) for c, n in zip(rect, ("x1", "y1", "x2", "y2"))])

    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    stem = crop_name(F.col("image_id"), F.col("ann_id"))
    boxes = box_crops(anns, images).where("usable").join(split, "image_id")
    usable = anns.where((F.col("w") >= 3) & (F.col("h") >= 3)).join(split.where(F.col("split") == "train"), "image_id", "left_semi")
    jit = jitter_boxes(usable, images, jitter).join(split, "image_id")
    nth = F.array_position(F.array_sort(F.collect_list("attempt").over(_per_ann())), F.col("attempt")) - 1
    jit = jit.withColumn("j", nth)
    pictures = catalogue.withColumn("split", F.lit("train"))
    extra = pictures.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    cdn = F.concat(F.lit("cdn_"), F.col("stem"))
    out = line(boxes, "box", F.concat(stem, F.lit(".jpg")), *sides)
    out = out.unionByName(line(jit, "jitter", F.concat(stem, F.lit("_jit"), F.col("j").cast("string"), F.lit(".jpg")), *sides))
    out = out.unionByName(line(pictures, "catalogue", F.concat(cdn, F.lit(".jpg"))))
    return out.unionByName(line(extra, "variant", F.concat(cdn, F.lit("_aug"), F.col("j").cast("string"), F.lit(".jpg"))))


def _per_ann():
    from pyspark.sql import Window

    # At most ``jitter`` rows per annotation.
    return Window.partitionBy("ann_id")


def crop_dataset_stats(manifest: DataFrame, cats: DataFrame) -> DataFrame:
    """Training and validation crops per class, classes without any included."""
    per = manifest.groupBy("category_id").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return cats.select("category_id").join(per, "category_id", "left").select(
        "category_id", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_val", F.lit(0)).alias("n_val"),
        F.coalesce((F.col("n_train") > 0) & (F.col("n_train") <= 5), F.lit(False)).alias("low_shot"),
        (F.coalesce("n_val", F.lit(0)) == 0).alias("zero_shot_val"))

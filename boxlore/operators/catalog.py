"""Categories against a product catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.functions.scalars import catalogue_name, only_digits, shout, squeeze
from boxlore.operators.ranking import last_wins

UNKNOWN = "unknown_product"


def category_product_map(cats: DataFrame, products: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Categories with the product of exactly their name; the last of equal names counts."""
    cols = [c for c in products.columns if c != "category_id"]
    last = last_wins(products.select(*cols), ["product_name"], ordinal)
    return cats.join(last, cats["name"] == last["product_name"]).select("category_id", "name", *[c for c in cols if c not in ("product_name", ordinal)])


def unmatched_products(cats: DataFrame, products: DataFrame) -> DataFrame:
    return products.join(cats, products["product_name"] == cats["name"], "left_anti")


def categories_without_reference(cats: DataFrame, products: DataFrame, counts: DataFrame) -> DataFrame:
    """Categories no product names, with their annotation counts."""
    bare = cats.join(products, cats["name"] == products["product_name"], "left_anti")
    return bare.join(counts, "category_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rare_categories(codes: DataFrame, counts: DataFrame, max_count: int) -> DataFrame:
    """Categories with a usable code and at most ``max_count`` annotations, none included."""
    return codes.where(only_digits(F.col("product_code"))).join(counts, "category_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).where(F.col("n") <= max_count)


def _issues(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def reconcile(cats: DataFrame, codes: DataFrame, hits: DataFrame, with_reference: DataFrame) -> DataFrame:
    """Status of every category against its ranked search hits.

    ``hits``: ``category_id, rank, name, ean, image, brand, error``; ``codes``: ``category_id,
    meta_ean``; ``with_reference``: ``category_id``. The chosen hit is the first of equal name,
    else the last of equal article number, else the first; each is one combinable aggregate, so
    a category with very many hits is no large group.
    """
    names = cats.select("category_id", F.col("name").alias("cat_name"))
    base = names.join(codes.select("category_id", "meta_ean"), "category_id", "left").join(
        with_reference.select("category_id", F.lit(True).alias("_ref")).distinct(), "category_id", "left")
    base = base.select(
        "category_id", "cat_name", F.when(F.col("meta_ean") != "", F.col("meta_ean")).alias("meta_ean"),
        F.coalesce("_ref", F.lit(False)).alias("has_reference"))
    hit = F.struct("rank", "name", "ean", "image", "brand")
    seen = hits.join(base, "category_id")
    name, wanted = shout(F.coalesce(F.col("name"), F.lit(""))), shout(F.col("cat_name"))
    same_name = (name == wanted) | (squeeze(name) == wanted)
    found = F.col("error").isNull()
    best = seen.groupBy("category_id").agg(
        F.max("error").alias("error"),
        F.min(F.when(found & same_name, hit)).alias("exact"),
        F.max(F.when(found & (F.col("ean") == F.col("meta_ean")), hit)).alias("by_ean"),
        F.min(F.when(found, hit)).alias("first"))
    rows = base.join(best, "category_id", "left").withColumn("best", F.coalesce("exact", "by_ean", "first"))

    skip = F.col("cat_name") == UNKNOWN
    failed = F.col("error").isNotNull()
    nothing = F.col("first").isNull()
    by_ean = F.col("exact").isNull() & F.col("by_ean").isNotNull()
    fuzzy = F.col("exact").isNull() & F.col("by_ean").isNull() & ~nothing
    other_ean = F.coalesce(F.col("meta_ean").isNotNull() & (F.col("best.ean") != "") & (F.col("best.ean") != F.col("meta_ean")), F.lit(False))
    status = (
        F.when(skip, "SKIP").when(failed, "API_ERROR").when(other_ean, "EAN_MISMATCH").when(nothing, "NOT_FOUND")
        .when(by_ean, "NAME_MISMATCH").when(fuzzy, "FUZZY_MATCH").otherwise("OK"))
    issues = _issues(
        F.when(nothing, F.lit("no results")),
        F.when(by_ean, F.concat(F.lit("name differs: "), F.col("best.name"))),
        F.when(fuzzy, F.concat(F.lit("best guess: "), F.col("best.name"))),
        F.when(other_ean, F.concat(F.lit("article number differs: "), F.col("best.ean"))),
        F.when(~F.col("has_reference"), F.lit("missing reference image")))
    open_case = ~skip & ~failed
    return rows.select(
        "category_id", "cat_name", status.alias("status"), "has_reference", "meta_ean",
        *[F.when(open_case, F.col(f"best.{c}")).alias(f"api_{c}") for c in ("name", "ean", "image", "brand")],
        F.when(open_case, issues).otherwise(F.array().cast("array<string>")).alias("issues"))


def missing_reference_images(reconciled: DataFrame) -> DataFrame:
    return reconciled.where(~F.col("has_reference") & (F.coalesce("api_image", F.lit("")) != "")).select(
        "category_id", "cat_name", "api_ean", "api_image", "api_name")


def status_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(F.size("issues") > 0).alias("n_with_issues"), F.count_if(~F.col("has_reference")).alias("n_without_reference"))


def download_tasks(codes: DataFrame, base_url: str, stores: list[str], sizes: list[str]) -> DataFrame:
    """One row per category, store and size. The first store and size are the default, with no suffix in the name."""
    rows = codes.where(only_digits(F.col("product_code")))
    pairs = [
        F.struct(F.lit(s).alias("store"), F.lit(z).alias("size"), F.lit("" if (s, z) == (stores[0], sizes[0]) else f"_{s}_{z}").alias("suffix"))
        for s in stores for z in sizes
    ]
    rows = rows.withColumn("t", F.explode(F.array(*pairs)))
    return rows.select(
        "category_id", "product_code", F.col("t.store").alias("store"), F.col("t.size").alias("size"),
        F.concat_ws("/", F.lit(base_url), F.col("t.store"), F.col("t.size"), F.concat(F.col("product_code"), F.lit(".jpg"))).alias("url"),
        F.concat(catalogue_name(F.col("category_id"), F.col("product_code")), F.col("t.suffix"), F.lit(".jpg")).alias("file_name"))


def annotation_images(anns: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with name and size of their image."""
    return anns.join(images.select("image_id", "file_name", "width", "height"), "image_id")


def annotation_names(anns: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with the name of their class: ``?`` and, as a label, ``cat_<id>`` where it has none."""
    named = anns.join(categories.select("category_id", F.col("name").alias("_name")), "category_id", "left")
    label = F.coalesce("_name", F.concat(F.lit("cat_"), F.col("category_id").cast("string")))
    return named.withColumns({"name": F.coalesce("_name", F.lit("?")), "label": label}).drop("_name")

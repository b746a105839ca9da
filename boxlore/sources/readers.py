"""Readers with explicit schemas.

Files are whole JSON documents by default; ``lines=True`` reads one record per line. Both kinds of
large files are read by many tasks: lines split by themselves, and the arrays of one large document
are read by :func:`array_scan`, :func:`coco_arrays` and :func:`predictions_array`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlore import schemas
from boxlore.functions import geometry as G
from boxlore.operators.ranking import last_wins, ranked


def _json(spark: SparkSession, schema, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path if isinstance(path, str) else list(path))


def _in_order(spark: SparkSession, schema, paths: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Rows with ``_order``: position of their path in the list, file, block and row in it."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        rows = _json(spark, schema, path, lines).select(
            "*", F.input_file_name().alias("_file"),
            F.struct(F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_order"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no path given")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at ``path``."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def flat_boxes(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    rest = [c for c in df.columns if c != bbox]
    return df.select(*rest, *G.named(G.from_array(bbox)))


def coco_scan(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of one annotation document."""
    doc = _json(spark, schemas.COCO, path, lines)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    anns = flat_boxes(doc.select(F.inline("annotations")).withColumnRenamed("id", "ann_id"))
    cats = doc.select(F.inline("categories")).withColumnRenamed("id", "category_id")
    return images, anns, cats


def array_scan(spark: SparkSession, path: str, schema: T.StructType, array: str | None = None) -> DataFrame:
    """Records of one array of a large JSON document, with ``_order``, read by as many tasks as it has blocks.

    The file is cut at closing braces, where every task finds the next record's border by itself.
    ``array`` names an array of the outer object; without it the document is the array. Records
    are flat: they hold no objects, and no braces in strings; anything else is an error, never a
    lost record. Records keep the document's order.
    """
    cut = spark.read.option("lineSep", "}").text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_order"))
    opened = F.size(F.split("value", r"\{")) - 1
    cut = cut.select("_order", opened.alias("_opened"), F.substring_index("value", "{", -1).alias("_body"), F.expr("substring(value, 1, length(value) - length(substring_index(value, '{', -1)))").alias("_head"))
    records = cut.where("_opened > 0").withColumn("_name", F.regexp_extract("_head", r'"([^"\\]*)"\s*:\s*\[\s*\{$', 1))
    if array is None:
        mine = records
    else:
        # One row per array of the document.
        starts = records.where("_name <> ''").groupBy("_name").agg(F.min("_order").alias("first")).orderBy("first").collect()
        names = [r["_name"] for r in starts]
        if array not in names:
            return spark.createDataFrame([], T.StructType([*schema.fields, records.schema["_order"]]))
        key = lambda r: F.struct(F.lit(r["first"]["file"]).alias("file"), F.lit(r["first"]["block"]).alias("block"), F.lit(r["first"]["n"]).alias("n"))
        at = names.index(array)
        mine = records.where(F.col("_order") >= key(starts[at]))
        if at + 1 < len(starts):
            mine = mine.where(F.col("_order") < key(starts[at + 1]))
    # A border between records is a comma and white space, or the beginning of the array.
    clean = F.col("_head").rlike(r'^\s*,?\s*\{$') | (F.col("_name") != "") | F.col("_head").rlike(r'^\s*\[\s*\{$')
    checked = F.when(clean, F.concat(F.lit("{"), "_body", F.lit("}"))).otherwise(F.raise_error(F.concat(F.lit("not a flat record: "), F.substring("_body", 1, 200))))
    return mine.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r"), "_order").select("r.*", "_order")


def coco_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`coco_scan` of one large document, by many tasks."""
    part = lambda name, schema: array_scan(spark, path, schema, name).drop("_order")
    images = part("images", schemas.IMAGE).withColumnRenamed("id", "image_id")
    anns = flat_boxes(part("annotations", schemas.ANNOTATION).withColumnRenamed("id", "ann_id"))
    return images, anns, part("categories", schemas.CATEGORY).withColumnRenamed("id", "category_id")


def predictions_array(spark: SparkSession, path: str) -> DataFrame:
    """:func:`predictions_scan` of one large JSON array, by many tasks."""
    rows = ranked(array_scan(spark, path, schemas.PREDICTION), [], [F.col("_order").asc()], rank="pred_id")
    return flat_boxes(rows.withColumn("pred_id", F.col("pred_id") - 1).drop("_order"))


def predictions_scan(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Predictions of JSON arrays. ``pred_id`` counts from 0 in the order of the paths and of their rows."""
    rows = _in_order(spark, schemas.PREDICTION, path, lines).drop("_file")
    return flat_boxes(ranked(rows, [], [F.col("_order").asc()], rank="pred_id").withColumn("pred_id", F.col("pred_id") - 1).drop("_order"))


def product_metadata_scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Product rows of either layout (``{"products": [...]}`` or a bare list).

    The name is the first filled one of three fields, of equal names the later row counts, and a
    missing file gives no rows.
    """
    both = T.StructType([*schemas.PRODUCT.fields, T.StructField("products", T.ArrayType(schemas.PRODUCT))])
    if not exists(spark, path):
        return _named(spark.createDataFrame([], both).withColumn("_order", F.lit(0)))
    return _named(_in_order(spark, both, path, lines).drop("_file"))


def _named(rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in ("products", "_order")]
    doc = F.coalesce("products", F.array(F.struct(*own)))
    flat = rows.select(F.col("_order").alias("_d"), F.posexplode(doc).alias("_p", "r")).select("_d", "_p", "r.*")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    flat = flat.withColumn("product_name", F.coalesce(filled("product_name"), filled("name"), filled("display_name"))).drop("name", "display_name")
    flat = flat.where(F.col("product_name").isNotNull()).withColumn("ordinal", F.struct("_d", "_p")).drop("_d", "_p")
    return last_wins(flat, ["product_name"], "ordinal").drop("ordinal")


def split_scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    doc = _json(spark, schemas.SPLIT, path, lines)
    part = lambda col, name: doc.select(F.explode(col).alias("image_id"), F.lit(name).alias("split"))
    return part("train_ids", "train").unionByName(part("val_ids", "val"))


def all_train(split: DataFrame) -> DataFrame:
    """Both parts as training data."""
    return split.select("image_id").distinct().select("image_id", F.lit("train").alias("split"))


def corrections_scan(spark: SparkSession, paths: Sequence[str], lines: bool = False) -> DataFrame:
    """Corrections of several files with the file they come from, in the order of ``paths``.

    ``ordinal`` is a struct that sorts by path, file and row, so the later path wins.
    """
    return _in_order(spark, schemas.CORRECTION, paths, lines).withColumnRenamed("_file", "file").withColumnRenamed("_order", "ordinal")


def verification_scan(spark: SparkSession, final_path: str, checkpoint_path: str, lines: bool = False) -> DataFrame:
    """Mismatching verdicts: of the final document if it exists, else of the checkpoint.

    Both layouts are read, ``{"results": [...]}`` and a bare list.
    """
    path = final_path if exists(spark, final_path) else checkpoint_path
    verdict = schemas.VERDICT
    both = T.StructType([*verdict.fields, T.StructField("results", T.ArrayType(verdict))])
    rows = _json(spark, both, path, lines)
    flat = rows.select(F.inline(F.coalesce("results", F.array(F.struct(*verdict.names)))))
    return flat.where(F.col("consensus") == "mismatch")


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Image files with the id in their name; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return listed_images(files)


def listed_images(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    digits = F.regexp_extract(name, r"(?i)^img_(\d+)\.(jpg|jpeg|png)", 1)
    return files.where(digits != "").select(digits.cast("bigint").alias("image_id"), "path", "length")


def lenient_image_id(path):
    """The last part of the file stem as a number, NULL if it is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "_"), -1).try_cast("bigint")


def catalogue_files(files: DataFrame, n_classes: int) -> DataFrame:
    """Class and code out of catalogue file names; unreadable or unknown classes leave."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    category = F.replace(F.element_at(parts, 1), F.lit("cat"), F.lit("")).try_cast("int")
    return files.select(category.alias("category_id"), F.try_element_at(parts, F.lit(2)).alias("code"), stem.alias("stem")).where(
        F.col("category_id").isNotNull() & (F.col("category_id") < n_classes))


def sweep_results_scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, schemas.EXPERIMENT, path, lines)


def existing_files(rows: DataFrame, listing: DataFrame, on: str = "file_name") -> DataFrame:
    names = listing.select(F.element_at(F.split("path", "/"), -1).alias(on))
    return rows.join(names, on, "left_semi")

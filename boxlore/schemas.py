"""Explicit schemas of every record the readers accept."""

from pyspark.sql import types as T

IMAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])
ANNOTATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("image_id", T.LongType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("area", T.DoubleType()),
])
CATEGORY = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
])
COCO = T.StructType([
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("annotations", T.ArrayType(ANNOTATION)),
    T.StructField("categories", T.ArrayType(CATEGORY)),
])
PREDICTION = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("score", T.DoubleType()),
])
SPLIT = T.StructType([
    T.StructField("train_ids", T.ArrayType(T.LongType())),
    T.StructField("val_ids", T.ArrayType(T.LongType())),
    T.StructField("seed", T.IntegerType()),
])
PRODUCT = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("corrected_count", T.IntegerType()),
    T.StructField("annotation_count", T.IntegerType()),
    T.StructField("has_images", T.BooleanType()),
    T.StructField("image_types", T.ArrayType(T.StringType())),
])
CORRECTION = T.StructType([
    T.StructField("ann_id", T.LongType()),
    T.StructField("old_cat", T.IntegerType()),
    T.StructField("new_cat", T.IntegerType()),
    T.StructField("source", T.StringType()),
])
VERDICT = T.StructType([
    T.StructField("ann_id", T.LongType()),
    T.StructField("gt_cat", T.IntegerType()),
    T.StructField("gt_name", T.StringType()),
    T.StructField("suspicion", T.DoubleType()),
    T.StructField("consensus", T.StringType()),
])
EXPERIMENT = T.StructType([
    T.StructField("conf", T.DoubleType()),
    T.StructField("wbf_iou", T.DoubleType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("max_preds", T.IntegerType()),
    T.StructField("hybrid", T.DoubleType()),
    T.StructField("det_mAP", T.DoubleType()),
    T.StructField("cls_mAP", T.DoubleType()),
    T.StructField("n_preds", T.IntegerType()),
])
VOTE = T.StructType([
    T.StructField("ann_id", T.LongType()),
    T.StructField("voter", T.IntegerType()),
    T.StructField("vote", T.BooleanType()),
])

"""Large documents by many tasks, label texts in few files, sources of repeats."""

import json
import os

import pytest
from pyspark.sql import functions as F

from boxlore import schemas
from boxlore.operators import sampling
from boxlore.sources import fixtures, readers, writers
from suite import dataset


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    doc = {
        "info": "no array", "images": [{"id": i, "file_name": f'a "{i}" [x], é.jpg', "width": 10, "height": 20} for i in range(300)], "empty": [],
        "annotations": [{"id": 7 * i, "image_id": i % 300, "category_id": i % 5, "bbox": [i, 1.5, 2, 3], "area": 6.0} for i in range(20_000)],
        "categories": [{"id": 3, "name": "last"}],
    }
    path = f"{tmp_path}/doc.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(path) // 8))
    try:
        images, anns, cats = readers.coco_arrays(spark, path)
        assert anns.rdd.getNumPartitions() >= 8
        got = readers.array_scan(spark, path, schemas.ANNOTATION, "annotations").orderBy("_order").select("id", "bbox").collect()
        assert [(r.id, r.bbox) for r in got] == [(a["id"], a["bbox"]) for a in doc["annotations"]]
        assert anns.count() == 20_000 and images.count() == 300 and [tuple(r) for r in cats.collect()] == [(3, "last")]
        assert {r.file_name for r in images.collect()} == {i["file_name"] for i in doc["images"]}
        assert readers.array_scan(spark, path, schemas.CATEGORY, "absent").count() == 0
        rows = f"{tmp_path}/rows.json"
        with open(rows, "w") as f:
            json.dump([{"image_id": 5, "category_id": 1, "bbox": [i, 0, 1, 1], "score": 0.5} for i in range(4000)], f)
        found = readers.predictions_array(spark, rows).orderBy("pred_id").collect()
        assert [(r.pred_id, r.x) for r in found] == [(i, float(i)) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("records", ['[{"image_id": 1, "score": 0.5, "more": {"a": 1}, "b": 2}]', '[{"image_id": 1, "score": "}"}, {"image_id": 2}]', '[{"image_id": 1} {"image_id": 2} junk {"image_id": 3}]'])
def test_what_is_no_flat_record_is_an_error(spark, tmp_path, records):
    path = f"{tmp_path}/doc.json"
    with open(path, "w") as f:
        f.write(records)
    with pytest.raises(Exception, match="(?i)record|malformed|parse"):
        readers.array_scan(spark, path, schemas.PREDICTION).collect()


def test_label_shards(spark, tmp_path):
    images = spark.range(200).select(F.col("id").alias("image_id"), F.concat(F.lit("é_"), "id", F.lit(".jpg")).alias("file_name"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    anns = spark.range(900).select(F.col("id").alias("ann_id"), (F.col("id") * 7 % 150).alias("image_id"), (F.col("id") % 3).cast("int").alias("category_id"), *[F.lit(float(i + 5)).alias(c) for i, c in enumerate("xywh")])
    split = images.select("image_id", F.when(F.col("image_id") % 4 == 0, "val").otherwise("train").alias("split"))
    writers.write_label_shards(anns, images, split, f"{tmp_path}/out", 5)
    files = [f for _, _, names in os.walk(f"{tmp_path}/out/shards") for f in names if f.endswith(".txt")]
    assert len(files) <= 5
    got = {(r.split, r.label_file): r.labels for r in readers_of(spark, tmp_path).collect()}
    want = {(r.split, r.label_file): r.labels for r in writers.yolo_labels(anns, images, split).collect()}
    assert got == want and len(want) == 200 and "" in want.values()


def readers_of(spark, tmp_path):
    return writers.read_label_shards(spark, f"{tmp_path}/out")


def test_sources_of_repeats(spark):
    images = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg"), (3, "c.jpg")], "image_id long, file_name string")
    anns = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 6), (2, 7)], "image_id long, category_id int")
    boost = spark.createDataFrame([(5, "rare one", 6, ["rare<=5"]), (6, "common", 1, []), (7, "often wrong", 4, ["tail<=10", "corr>=0.50"])], "category_id int, name string, repeat int, reasons array<string>")
    got = {r.image_id: r for r in sampling.image_repeats(images, anns, boost).collect()}
    assert [tuple(s) for s in got[1].sources] == [(5, "rare one", 6, ["rare<=5"], 2)] and (got[1].n, got[1].boosted, got[1].repeat) == (3, 2, 6)
    assert [tuple(s) for s in got[2].sources] == [(7, "often wrong", 4, ["tail<=10", "corr>=0.50"], 1)] and got[2].repeat == 4
    assert got[3].sources == [] and (got[3].n, got[3].repeat) == (0, 1)


def test_one_document_is_written_by_many_tasks(spark, tmp_path):
    """The document's files, put together by name, are one JSON document, and are read back as one."""
    rows = spark.range(4000).selectExpr("id", "id % 7 AS image_id", "cast(id % 5 AS int) AS category_id", "array(id + 0D, 1D, 2D, 3D) AS bbox", "id / 4000D AS score")
    path = f"{tmp_path}/doc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dataset._one_document(spark, [("", rows)], path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert len(files) > 1
    doc = json.loads("".join(open(f"{path}/{f}").read() for f in files))
    assert [(r["id"], r["bbox"][0]) for r in doc] == [(i, float(i)) for i in range(4000)]
    got = readers.predictions_array(spark, path).orderBy("pred_id").select("pred_id", "image_id", "x").collect()
    assert [tuple(r) for r in got] == [(i, i % 7, float(i)) for i in range(4000)]


def test_rows_of_a_table_are_dealt_out_whatever_its_files(spark, tmp_path, monkeypatch):
    """A file of one row group, whose bytes are many splits, still gives every task its share."""
    monkeypatch.setattr(fixtures, "ROWS", 500)
    spark.range(10_000).selectExpr("id AS o_orderkey", "id % 13 AS o_custkey", "sha2(cast(id AS string), 512) AS more").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        held = fixtures.annotations(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        ids = fixtures.annotations(spark, str(tmp_path)).agg(F.count("ann_id"), F.sum("ann_id")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(held) == 20 and max(r["count"] for r in held) <= 600
    assert tuple(ids) == (10_000, 10_000 * 9_999 // 2)

"""Registration of queries and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxlore.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FX = {
    "fx_annotations": """
        SELECT o_orderkey AS ann_id,
               CAST(floor(o_orderkey / 50.0) AS BIGINT) AS image_id,
               CAST(CASE WHEN o_orderkey % 500 = 7 THEN 40 + floor(o_orderkey / 500.0)
                         ELSE (o_orderkey * 7 + o_custkey) % 40 END AS INT) AS category_id,
               CAST(((o_orderkey % 50) % 10) * 380 + (o_orderkey * 37) % 60 AS DOUBLE) AS x,
               CAST(floor((o_orderkey % 50) / 10.0) * 560 + (o_orderkey * 53) % 60 AS DOUBLE) AS y,
               CAST(200 + (o_orderkey * 17) % 120 AS DOUBLE) AS w,
               CAST(200 + (o_orderkey * 29) % 120 AS DOUBLE) AS h
        FROM orders""",
    "fx_images": """
        SELECT DISTINCT CAST(floor(o_orderkey / 50.0) AS BIGINT) AS image_id,
               concat('img_', lpad(CAST(CAST(floor(o_orderkey / 50.0) AS BIGINT) AS VARCHAR), 5, '0'), '.jpg') AS file_name,
               4000 AS width, 3000 AS height
        FROM orders""",
    "fx_predictions": """
        SELECT a.ann_id * 3 + m.model_id AS pred_id, m.model_id AS model_id, a.image_id AS image_id,
               CAST(CASE WHEN (a.ann_id * 11 + m.model_id * 5) % 9 = 0 THEN (a.category_id + 1) % 40
                         ELSE a.category_id END AS INT) AS category_id,
               a.x + (a.ann_id * 31 + m.model_id * 97) % 61 - 30
                   + CASE WHEN (a.ann_id * 19 + m.model_id) % 8 = 0 THEN 170 ELSE 0 END AS x,
               a.y + (a.ann_id * 43 + m.model_id * 59) % 61 - 30 AS y,
               a.w + (a.ann_id * 23 + m.model_id) % 31 - 15 AS w,
               a.h + (a.ann_id * 41 + m.model_id) % 31 - 15 AS h,
               ((a.ann_id * 7919 + m.model_id * 104729) % 9973) / 1e4 AS score
        FROM fx_annotations a CROSS JOIN (SELECT 0 AS model_id UNION ALL SELECT 1 UNION ALL SELECT 2) m
        WHERE (a.ann_id * 13 + m.model_id) % 10 <> 0""",
    "fx_votes": """
        SELECT a.ann_id AS ann_id, v.voter AS voter,
               CASE WHEN (a.ann_id * 17 + v.voter * 7) % 11 < 2 THEN NULL
                    ELSE (a.ann_id * 29 + v.voter * 13) % 5 < 3 END AS vote,
               CAST((a.category_id + CASE WHEN a.ann_id % 5 = 0 THEN v.voter % 3 WHEN v.voter = 3 THEN a.ann_id % 3 ELSE a.ann_id % 2 END) % 40 AS INT) AS cat_id
        FROM fx_annotations a CROSS JOIN (SELECT 1 AS voter UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
    "fx_counts": "SELECT category_id, count(*) AS n FROM fx_annotations GROUP BY category_id",
    "fx_products": """
        SELECT c.category_id AS category_id, concat('product ', CAST(c.category_id AS VARCHAR)) AS product_name,
               CAST(7000000000000 + c.category_id * 97 AS VARCHAR) AS product_code,
               CAST((c.category_id * 13) % 17 AS INT) AS corrected_count, c.n AS annotation_count,
               c.category_id % 5 <> 0 AS has_images
        FROM fx_counts c WHERE c.category_id % 7 <> 3""",
    "fx_categories": """
        SELECT category_id, CASE WHEN category_id = (SELECT max(category_id) FROM fx_counts) THEN 'unknown_product'
               ELSE concat('product ', CAST(category_id AS VARCHAR)) END AS name FROM fx_counts""",
    "fx_similarities": """
        SELECT ann_id, image_id, category_id AS gt_cat,
               CASE WHEN ann_id % 10 = 3 THEN -1.0::DOUBLE ELSE ((ann_id * 577) % 1000) / 1e3 END AS gt_sim,
               ((ann_id * 733) % 1000) / 1e3 + 0.2::DOUBLE
                   - CASE WHEN ann_id % 10 = 3 THEN -1.0::DOUBLE ELSE ((ann_id * 577) % 1000) / 1e3 END AS suspicion,
               CAST((category_id + ann_id % 3) % 40 AS INT) AS top1_cat, ((ann_id * 733) % 1000) / 1e3 + 0.2::DOUBLE AS top1_sim,
               CAST((category_id + 1 + ann_id % 5) % 40 AS INT) AS top2_cat, ((ann_id * 733) % 1000) / 1e3 + 0.1::DOUBLE AS top2_sim,
               CAST((category_id + 2 + ann_id % 7) % 40 AS INT) AS top3_cat, ((ann_id * 733) % 1000) / 1e3 AS top3_sim
        FROM fx_annotations""",
    "fx_classifier": """
        SELECT pred_id,
               CAST((category_id + CASE WHEN pred_id % 4 = 0 THEN pred_id % 3 + 38 ELSE 0 END) % 40 AS INT) AS cls,
               ((pred_id * 6151) % 997) / 1e3 AS cls_conf,
               CAST((category_id + CASE WHEN pred_id % 4 = 0 THEN pred_id % 3 + 38 ELSE 0 END + 1) % 40 AS INT) AS cls2,
               CAST((category_id + CASE WHEN pred_id % 4 = 0 THEN pred_id % 3 + 38 ELSE 0 END + 39) % 40 AS INT) AS cls3
        FROM fx_predictions WHERE pred_id % 7 <> 0""",
}


def with_fx(sql: str, recursive: bool = False) -> str:
    """Put the definitions of the derived tables a statement needs in front of it."""
    names, text = [], sql
    for name in reversed(list(_FX)):
        if name in text:
            names.insert(0, name)
            text += _FX[name]
    ctes = ", ".join(f"{n} AS ({_FX[n]})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_fx(sql)
        return fn
    return add


class Tables:
    """The derived tables of one scale, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "gts":
            return X.annotations(self.spark, self.dir).withColumnRenamed("ann_id", "gt_id")
        if name == "counts":
            return X.annotations(self.spark, self.dir).groupBy("category_id").count().withColumnRenamed("count", "n")
        if hasattr(X, name):
            return getattr(X, name)(self.spark, self.dir)
        return X.table(self.spark, self.dir, name)

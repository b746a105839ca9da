"""Audit, label cleaning, votes, catalogue, tiling, sampling, sinks, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions import scalars as S
from boxlore.operators import audit, catalog, cleaning, consensus, predict, ranking, sampling, tiling
from boxlore.session import shared_dir
from boxlore.sources import readers, writers
from boxlore.streaming import consensus_stream
from suite import sqltext as Q
from suite.base import query
from suite.base import Tables as T
from suite.boxes import catalogue_listing

r6 = lambda c: F.round(c, 6)


# --- audit ---------------------------------------------------------------------------------

@query("agg_1_dataset_summary", """SELECT (SELECT count(*) FROM fx_images) AS n_images, (SELECT count(*) FROM fx_annotations) AS n_annotations, count(*) AS n_categories,
   min(category_id) AS min_category, max(category_id) AS max_category, max(category_id) - min(category_id) + 1 = count(DISTINCT category_id) AS sequential FROM fx_categories""")
def _(s, d):
    t = T(s, d)
    return audit.dataset_summary(t.images, t.annotations, t.categories)


@query("agg_2_image_stats", f"""WITH z AS (SELECT o_orderkey AS image_id, CAST(300 + (o_orderkey * 37) % 3700 AS INT) AS width, CAST(300 + (o_orderkey * 53) % 2900 AS INT) AS height FROM orders)
   SELECT min(width) AS min_width, max(width) AS max_width, round(avg(width), 6) AS mean_width, min(height) AS min_height, max(height) AS max_height, round(avg(height), 6) AS mean_height,
     min(width * height / 1e6) AS min_megapixels, max(width * height / 1e6) AS max_megapixels, round(avg(width * height / 1e6), 6) AS mean_megapixels FROM z""")
def _(s, d):
    k = F.col("o_orderkey")
    rows = T(s, d).orders.select((300 + (k * 37) % 3700).cast("int").alias("width"), (300 + (k * 53) % 2900).cast("int").alias("height"))
    out = audit.image_stats(rows)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("mean")})


@query("agg_3_anns_per_image", "SELECT min(n) AS min_boxes, max(n) AS max_boxes, round(avg(n), 6) AS mean_boxes FROM (SELECT image_id, count(*) AS n FROM fx_annotations GROUP BY image_id)")
def _(s, d):
    return audit.anns_per_image(T(s, d).annotations).withColumn("mean_boxes", r6("mean_boxes"))


@query("agg_4_category_frequency", "SELECT category_id, n FROM fx_counts")
def _(s, d):
    return audit.category_frequency(T(s, d).annotations)


_FREQ = ("CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' "
         "WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' END")


@query("agg_4_frequency_histogram", f"SELECT {_FREQ} AS bucket, count(*) AS n_categories FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT category_id, n FROM fx_counts) WHERE n <= 1000 GROUP BY 1")
def _(s, d):
    t = T(s, d)
    both = t.events.groupBy("user_id").agg(F.count("*").alias("n")).select("n").unionByName(t.counts.select("n"))
    return audit.frequency_histogram(both).select("bucket", "n_categories")


@query("agg_4_singletons", "SELECT category_id, n FROM fx_counts WHERE n = 1")
def _(s, d):
    return audit.singletons(audit.category_frequency(T(s, d).annotations))


@query("agg_5_area_stats", """WITH a AS (SELECT (w - 190) * (h - 190) AS area FROM fx_annotations), o AS (SELECT area, row_number() OVER (ORDER BY area) - 1 AS i, count(*) OVER () AS n FROM a)
   SELECT count(*) AS n, min(area) AS min_area, max(area) AS max_area, round(avg(area), 4) AS mean_area, count_if(area < 1024) AS n_tiny, (SELECT area FROM o WHERE i = n // 2) AS median_area,
     round(100.0 * count_if(area < 1024) / count(*), 6) AS tiny_percent FROM a""")
def _(s, d):
    rows = T(s, d).annotations.select((F.col("w") - 190).alias("w"), (F.col("h") - 190).alias("h"))
    return audit.area_stats(rows).withColumn("mean_area", F.round("mean_area", 4)).withColumn("tiny_percent", r6("tiny_percent"))


@query("win_1_id_gaps", """WITH i AS (SELECT DISTINCT o_orderkey + o_orderkey // 7 * 3 AS id FROM orders), l AS (SELECT lag(id) OVER (ORDER BY id) AS previous_id, id AS next_id FROM i)
   SELECT previous_id, next_id, next_id - previous_id - 1 AS missing FROM l WHERE next_id - previous_id > 1""")
def _(s, d):
    return ranking.id_gaps(T(s, d).orders.select(F.expr("o_orderkey + o_orderkey div 7 * 3").alias("id")), "id")


@query("agg_23_sole_source_images", "SELECT DISTINCT min(image_id) AS image_id FROM fx_annotations GROUP BY category_id HAVING count(DISTINCT image_id) = 1")
def _(s, d):
    return sampling.sole_source_images(T(s, d).annotations)


# --- catalogue -----------------------------------------------------------------------------

_PROD = "prod AS (SELECT product_name, product_code, corrected_count, annotation_count, category_id AS ordinal FROM fx_products UNION ALL SELECT product_name, concat(product_code, '9'), corrected_count, annotation_count, category_id + 1000 FROM fx_products WHERE category_id % 4 = 0 UNION ALL SELECT concat('extra ', CAST(category_id AS VARCHAR)), product_code, 0, 0, category_id + 2000 FROM fx_products WHERE category_id % 6 = 0)"


def _products(t: T):
    p, c = t.products, F.col("category_id")
    own = p.select("product_name", "product_code", "corrected_count", "annotation_count", c.alias("ordinal"))
    again = p.where("category_id % 4 = 0").select("product_name", F.concat("product_code", F.lit("9")).alias("product_code"), "corrected_count", "annotation_count", (c + 1000).alias("ordinal"))
    extra = p.where("category_id % 6 = 0").select(F.concat(F.lit("extra "), c.cast("string")).alias("product_name"), "product_code", F.lit(0).alias("corrected_count"), F.lit(0).cast("bigint").alias("annotation_count"), (c + 2000).alias("ordinal"))
    return own.unionByName(again).unionByName(extra)


_MAPPED = f"{_PROD}, pmap AS (SELECT c.category_id, c.name, l.product_code, l.corrected_count, l.annotation_count FROM fx_categories c JOIN (SELECT product_name, arg_max(product_code, ordinal) AS product_code, arg_max(corrected_count, ordinal) AS corrected_count, arg_max(annotation_count, ordinal) AS annotation_count FROM prod GROUP BY product_name) l ON l.product_name = c.name)"


@query("join_3_category_product_map", f"WITH {_MAPPED} SELECT * FROM pmap")
def _(s, d):
    t = T(s, d)
    return catalog.category_product_map(t.categories, _products(t))


@query("join_4_unmatched_products", f"WITH {_PROD} SELECT product_name, ordinal FROM prod WHERE product_name NOT IN (SELECT name FROM fx_categories)")
def _(s, d):
    t = T(s, d)
    return catalog.unmatched_products(t.categories, _products(t)).select("product_name", "ordinal")


def _elsewhere(df, moved):
    """Rows under the ids of other classes, so that their own classes have none."""
    return df.withColumn("category_id", (F.col("category_id") + F.when(moved, 1000000).otherwise(0)).cast("int"))


@query("join_4_categories_without_reference", "SELECT c.category_id AS category_id, c.name AS name, coalesce(n.n, 0) AS n FROM fx_categories c LEFT JOIN fx_counts n ON n.category_id + CASE WHEN n.category_id % 2 = 0 THEN 1000000 ELSE 0 END = c.category_id WHERE c.name NOT IN (SELECT product_name FROM fx_products)")
def _(s, d):
    t = T(s, d)
    return catalog.categories_without_reference(t.categories, t.products.select("product_name"), _elsewhere(t.counts, F.col("category_id") % 2 == 0))


@query("snk_6_mapping_rows", f"WITH {_MAPPED} SELECT CAST(category_id AS VARCHAR) AS key, concat('{{\"name\":\"', name, '\",\"product_code\":\"', product_code, '\"}}') AS value FROM pmap")
def _(s, d):
    t = T(s, d)
    return writers.mapping_rows(catalog.category_product_map(t.categories, _products(t)).select("category_id", "name", "product_code"))


_CODE = "CASE WHEN category_id % 8 = 1 THEN concat('X', product_code) WHEN category_id % 8 = 5 THEN NULL ELSE product_code END"


def _codes(t: T):
    c = F.col("category_id")
    return t.products.select("category_id", F.when(c % 8 == 1, F.concat(F.lit("X"), F.col("product_code"))).when(c % 8 == 5, F.lit(None)).otherwise(F.col("product_code")).alias("product_code"))


@query("flt_7_digit_code", f"SELECT category_id, code FROM (SELECT category_id, {_CODE} AS code FROM fx_products) WHERE regexp_matches(code, '^[0-9]+$')")
def _(s, d):
    return _codes(T(s, d)).where(S.only_digits(F.col("product_code"))).select("category_id", F.col("product_code").alias("code"))


@query("flt_8_rare_categories", f"SELECT p.category_id AS category_id, coalesce(c.n, 0) AS n FROM (SELECT category_id, {_CODE} AS code FROM fx_products) p LEFT JOIN fx_counts c ON c.category_id + CASE WHEN c.category_id % 3 = 0 THEN 1000000 ELSE 0 END = p.category_id WHERE regexp_matches(code, '^[0-9]+$') AND coalesce(c.n, 0) <= 30")
def _(s, d):
    t = T(s, d)
    return catalog.rare_categories(_codes(t), _elsewhere(t.counts, F.col("category_id") % 3 == 0), 30).select("category_id", "n")


_HITS = """hits AS (SELECT CAST(p_partkey % 45 + CASE WHEN (p_partkey % 45) % 11 = 7 THEN 1000000 ELSE 0 END AS INT) AS category_id, CAST(floor(p_partkey / 45.0) AS INT) AS rank,
     CASE WHEN (p_partkey % 45) % 4 = 0 AND p_partkey % 6 = 0 THEN concat('product  ', CAST(p_partkey % 45 AS VARCHAR)) WHEN (p_partkey % 45) % 4 = 1 AND p_partkey % 6 = 3 THEN upper(concat('product ', CAST(p_partkey % 45 AS VARCHAR))) ELSE p_name END AS name,
     CASE WHEN (p_partkey % 45) % 3 = 0 AND p_partkey % 4 = 0 THEN CAST(7000000000000 + (p_partkey % 45) * 97 AS VARCHAR) WHEN p_partkey % 7 = 1 THEN '' ELSE CAST(7100000000000 + p_partkey AS VARCHAR) END AS ean,
     CASE WHEN p_partkey % 3 <> 1 THEN concat('http://img/', CAST(p_partkey AS VARCHAR)) ELSE '' END AS image, p_brand AS brand,
     CASE WHEN (p_partkey % 45) % 13 = 5 THEN 'timeout' END AS error FROM part)"""


def _hits(t: T):
    k = F.col("p_partkey")
    c = k % 45
    text = F.col("_c")
    rows = t.part.withColumn("_c", c.cast("string"))
    return rows.select(
        (c + F.when(c % 11 == 7, 1000000).otherwise(0)).cast("int").alias("category_id"), F.floor(k / 45.0).cast("int").alias("rank"),
        F.when((c % 4 == 0) & (k % 6 == 0), F.concat(F.lit("product  "), text)).when((c % 4 == 1) & (k % 6 == 3), F.upper(F.concat(F.lit("product "), text))).otherwise(F.col("p_name")).alias("name"),
        F.when((c % 3 == 0) & (k % 4 == 0), (F.lit(7000000000000) + c * 97).cast("string")).when(k % 7 == 1, "").otherwise((F.lit(7100000000000) + k).cast("string")).alias("ean"),
        F.when(k % 3 != 1, F.concat(F.lit("http://img/"), k.cast("string"))).otherwise("").alias("image"), F.col("p_brand").alias("brand"),
        F.when(c % 13 == 5, "timeout").alias("error"))


_RECON = f"""{_HITS}, base AS (SELECT c.category_id, c.name AS cat_name, p.product_code AS meta_ean, coalesce(p.has_images, false) AS has_reference FROM fx_categories c LEFT JOIN fx_products p USING (category_id)),
   seen AS (SELECT h.*, b.cat_name, b.meta_ean, upper(h.name) = upper(b.cat_name) OR replace(upper(h.name), '  ', ' ') = upper(b.cat_name) AS same FROM hits h JOIN base b USING (category_id)),
   agg AS (SELECT category_id, max(error) AS error, min(rank) FILTER (same) AS r_exact, max(rank) FILTER (ean = meta_ean) AS r_ean, min(rank) AS r_first FROM seen GROUP BY category_id),
   pick AS (SELECT b.*, a.error, a.r_exact, a.r_ean, a.r_first, s.name AS b_name, s.ean AS b_ean, s.image AS b_image, s.brand AS b_brand FROM base b LEFT JOIN agg a USING (category_id)
     LEFT JOIN seen s ON s.category_id = b.category_id AND s.rank = coalesce(a.r_exact, a.r_ean, a.r_first)),
   fin AS (SELECT *, cat_name = 'unknown_product' AS skip, coalesce(meta_ean IS NOT NULL AND b_ean <> '' AND b_ean <> meta_ean, false) AS other FROM pick),
   recon AS (SELECT category_id, cat_name, CASE WHEN skip THEN 'SKIP' WHEN error IS NOT NULL THEN 'API_ERROR' WHEN other THEN 'EAN_MISMATCH' WHEN r_first IS NULL THEN 'NOT_FOUND'
       WHEN r_exact IS NULL AND r_ean IS NOT NULL THEN 'NAME_MISMATCH' WHEN r_exact IS NULL THEN 'FUZZY_MATCH' ELSE 'OK' END AS status, has_reference, meta_ean,
     CASE WHEN NOT skip AND error IS NULL THEN b_name END AS api_name, CASE WHEN NOT skip AND error IS NULL THEN b_ean END AS api_ean, CASE WHEN NOT skip AND error IS NULL THEN b_image END AS api_image,
     CASE WHEN skip OR error IS NOT NULL THEN '' ELSE concat_ws('; ', CASE WHEN r_first IS NULL THEN 'no results' END, CASE WHEN r_exact IS NULL AND r_ean IS NOT NULL THEN concat('name differs: ', b_name) END,
       CASE WHEN r_exact IS NULL AND r_ean IS NULL AND r_first IS NOT NULL THEN concat('best guess: ', b_name) END, CASE WHEN other THEN concat('article number differs: ', b_ean) END,
       CASE WHEN NOT has_reference THEN 'missing reference image' END) END AS issues FROM fin)"""


def _reconciled(t: T):
    return catalog.reconcile(t.categories, t.products.select("category_id", F.col("product_code").alias("meta_ean")), _hits(t), t.products.where("has_images").select("category_id"))


@query("join_14_catalog_reconcile", f"WITH {_RECON} SELECT category_id, status, has_reference, coalesce(api_name, '') AS api_name, coalesce(api_ean, '') AS api_ean, issues FROM recon")
def _(s, d):
    return _reconciled(T(s, d)).select("category_id", "status", "has_reference", F.coalesce("api_name", F.lit("")).alias("api_name"), F.coalesce("api_ean", F.lit("")).alias("api_ean"), F.concat_ws("; ", "issues").alias("issues"))


@query("join_15_missing_reference_images", f"WITH {_RECON} SELECT category_id, cat_name, api_ean, api_image, api_name FROM recon WHERE NOT has_reference AND coalesce(api_image, '') <> ''")
def _(s, d):
    return catalog.missing_reference_images(_reconciled(T(s, d)))


@query("agg_15_status_summary", f"WITH {_RECON} SELECT status, count(*) AS n, count_if(issues <> '') AS n_with_issues, count_if(NOT has_reference) AS n_without_reference FROM recon GROUP BY status")
def _(s, d):
    return catalog.status_summary(_reconciled(T(s, d)))


@query("join_10_reference_code", f"WITH {_RECON} SELECT c.category_id AS category_id, coalesce(p.product_code, nullif(r.api_ean, ''), '-') AS code FROM fx_categories c LEFT JOIN fx_products p USING (category_id) LEFT JOIN recon r USING (category_id)")
def _(s, d):
    t = T(s, d)
    return consensus.reference_code(t.categories, t.products, _reconciled(t)).withColumn("code", F.coalesce("code", F.lit("-")))


@query("join_20_download_tasks", f"""SELECT category_id, store, size, concat('http://cdn/', store, '/', size, '/', code, '.jpg') AS url, concat(format('cat{{:03d}}_', category_id), code, CASE WHEN store = 'no' AND size = 'large' THEN '' ELSE concat('_', store, '_', size) END, '.jpg') AS file_name
   FROM (SELECT category_id, {_CODE} AS code FROM fx_products) CROSS JOIN (SELECT unnest(['no', 'se']) AS store) CROSS JOIN (SELECT unnest(['large', 'small']) AS size) WHERE regexp_matches(code, '^[0-9]+$')""")
def _(s, d):
    return catalog.download_tasks(_codes(T(s, d)), "http://cdn", ["no", "se"], ["large", "small"]).drop("product_code")


# --- label cleaning ------------------------------------------------------------------------

_EMB = """views AS (SELECT CASE WHEN label < 8 THEN label ELSE label + 100 END AS category_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings),
   unit AS (SELECT category_id, v, sqrt(list_sum([e * e FOR e IN v])) AS norm FROM views),
   pos AS (SELECT category_id, unnest(range(1, len(v) + 1)) AS i, unnest([e / norm FOR e IN v]) AS e FROM unit),
   mean AS (SELECT category_id, i, avg(e) AS e FROM pos GROUP BY category_id, i),
   cen AS (SELECT category_id, list(e ORDER BY i) AS m FROM mean GROUP BY category_id),
   centroid AS (SELECT category_id, [e / sqrt(list_sum([z * z FOR z IN m])) FOR e IN m] AS c FROM cen),
   crops AS (SELECT vec_id AS ann_id, CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS gt_cat, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings),
   sims AS (SELECT ann_id, gt_cat, category_id AS cat, list_dot_product(v, c) / sqrt(list_sum([e * e FOR e IN v])) AS sim FROM crops CROSS JOIN centroid),
   rk AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY sim DESC, cat) AS rn FROM sims),
   own AS (SELECT ann_id, sim FROM sims WHERE cat = gt_cat),
   near AS (SELECT r.ann_id AS ann_id, r.gt_cat AS gt_cat, coalesce(o.sim, -1.0) AS gt_sim, r.cat AS best_cat, r.sim AS best_sim FROM rk r LEFT JOIN own o USING (ann_id) WHERE r.rn = 1)"""


def _centroids(t: T):
    # Two classes have their references under other ids, so that their crops have none.
    return cleaning.reference_centroid(t.embeddings.select(F.when(F.col("label") < 8, F.col("label")).otherwise(F.col("label") + 100).alias("category_id"), "embedding"))


def _crops(t: T):
    cat = (F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10
    return t.embeddings.select(F.col("vec_id").alias("ann_id"), cat.cast("int").alias("category_id"), "embedding")


@query("agg_9_reference_centroid", f"WITH {_EMB} SELECT category_id, i - 1 AS pos, round(c[i], 6) AS v FROM centroid CROSS JOIN range(1, 65) t(i)")
def _(s, d):
    return _centroids(T(s, d)).select("category_id", F.posexplode("centroid").alias("pos", "v")).withColumn("v", r6("v"))


@query("join_11_nearest_reference", f"WITH {_EMB} SELECT ann_id, gt_cat, round(gt_sim, 6) AS gt_sim, best_cat, round(best_sim, 6) AS best_sim FROM near")
def _(s, d):
    t = T(s, d)
    return cleaning.nearest_reference(_crops(t), _centroids(t)).withColumns({"gt_sim": r6("gt_sim"), "best_sim": r6("best_sim")})


@query("join_12_topk_similarity", f"""WITH {_EMB} SELECT ann_id, any_value(gt_cat) AS gt_cat, round(coalesce(any_value(o.sim), -1.0), 6) AS gt_sim, round(max(r.sim) - coalesce(any_value(o.sim), -1.0), 6) AS suspicion,
   max(cat) FILTER (rn = 1) AS top1_cat, round(max(r.sim) FILTER (rn = 1), 6) AS top1_sim, max(cat) FILTER (rn = 2) AS top2_cat, round(max(r.sim) FILTER (rn = 2), 6) AS top2_sim,
   max(cat) FILTER (rn = 3) AS top3_cat, round(max(r.sim) FILTER (rn = 3), 6) AS top3_sim FROM rk r LEFT JOIN own o USING (ann_id) GROUP BY ann_id""")
def _(s, d):
    t = T(s, d)
    out = cleaning.topk_similarity(_crops(t), _centroids(t))
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith("sim") or c == "suspicion"})


@query("join_13_embedding_corrections", f"""WITH {_EMB} SELECT ann_id, gt_cat AS old_cat, best_cat AS new_cat, round(gt_sim, 4) AS gt_sim, round(best_sim, 4) AS best_sim, coalesce(CASE WHEN gt_sim >= 0 THEN round(best_sim - gt_sim, 4) END, -9.0) AS margin
   FROM near LEFT JOIN (SELECT category_id + CASE WHEN category_id % 2 = 1 THEN 1000000 ELSE 0 END AS category_id, corrected_count FROM fx_products) p ON p.category_id = near.gt_cat
   WHERE best_cat <> gt_cat AND best_sim >= 0.25 AND (gt_sim < 0 OR best_sim - gt_sim >= 0.05) AND coalesce(corrected_count, -1) <> 0""")
def _(s, d):
    t = T(s, d)
    out = cleaning.embedding_corrections(cleaning.nearest_reference(_crops(t), _centroids(t)), _elsewhere(t.products.select("category_id", "corrected_count"), F.col("category_id") % 2 == 1))
    return out.withColumn("margin", F.coalesce("margin", F.lit(-9.0)))


_CORR = "corr AS (SELECT ann_id, category_id AS old_cat, CAST((category_id + 3) % 40 AS INT) AS new_cat, 1 AS ordinal FROM fx_annotations WHERE ann_id % 6 = 0 UNION ALL SELECT ann_id, CAST((category_id + 1) % 40 AS INT), CAST((category_id + ann_id % 2) % 40 AS INT), 2 FROM fx_annotations WHERE ann_id % 9 = 0)"
_NEW = f"{_CORR}, lastc AS (SELECT ann_id, arg_max(new_cat, ordinal) AS new_cat, arg_max(old_cat, ordinal) AS old_cat FROM corr GROUP BY ann_id)"


def _corrections(t: T):
    a, c = F.col("ann_id"), F.col("category_id")
    one = t.annotations.where("ann_id % 6 = 0").select("ann_id", c.alias("old_cat"), ((c + 3) % 40).cast("int").alias("new_cat"), F.lit(1).alias("ordinal"))
    two = t.annotations.where("ann_id % 9 = 0").select("ann_id", ((c + 1) % 40).cast("int").alias("old_cat"), ((c + a % 2) % 40).cast("int").alias("new_cat"), F.lit(2).alias("ordinal"))
    return one.unionByName(two)


@query("join_9_apply_corrections", f"WITH {_NEW} SELECT a.ann_id AS ann_id, coalesce(l.new_cat, a.category_id) AS category_id, coalesce(l.new_cat <> a.category_id, false) AS changed FROM fx_annotations a LEFT JOIN lastc l USING (ann_id)")
def _(s, d):
    t = T(s, d)
    return cleaning.apply_corrections(t.annotations, _corrections(t), "ordinal").select("ann_id", "category_id", "changed")


@query("join_9_apply_corrections_guarded", f"WITH {_NEW} SELECT a.ann_id AS ann_id, CASE WHEN l.old_cat = a.category_id THEN l.new_cat ELSE a.category_id END AS category_id FROM fx_annotations a LEFT JOIN lastc l USING (ann_id)")
def _(s, d):
    t = T(s, d)
    return cleaning.apply_corrections(t.annotations, _corrections(t), "ordinal", guard=True).select("ann_id", "category_id")


for _name, _col in (("agg_7_label_flow_losing", "old_cat"), ("agg_7_label_flow_gaining", "new_cat")):
    def _flow(s, d, col=_col):
        return cleaning.label_flow(_corrections(T(s, d)), col)
    query(_name, f"WITH {_CORR} SELECT {_col} AS category_id, count(*) AS n FROM corr GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")(_flow)


@query("agg_8_count_shift", f"""WITH {_NEW}, aft AS (SELECT coalesce(l.new_cat, a.category_id) AS category_id, count(*) AS n FROM fx_annotations a LEFT JOIN lastc l USING (ann_id) GROUP BY 1)
   SELECT coalesce(b.category_id, a.category_id) AS category_id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff
   FROM fx_counts b FULL JOIN aft a ON a.category_id = b.category_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(s, d):
    t = T(s, d)
    return cleaning.count_shift(t.annotations, cleaning.apply_corrections(t.annotations, _corrections(t), "ordinal"))


@query("win_4_review_queue", """WITH q AS (SELECT *, CASE WHEN gt_sim >= 0 THEN 0 ELSE 1 END AS queue FROM fx_similarities WHERE gt_sim < 0 OR suspicion >= 1.1::DOUBLE ORDER BY queue, suspicion DESC, ann_id LIMIT 150),
   j AS (SELECT q.*, i.file_name, greatest(0, CAST(trunc(a.x) AS INT)) AS x1, greatest(0, CAST(trunc(a.y) AS INT)) AS y1, least(i.width, CAST(trunc(a.x + a.w) AS INT)) AS x2, least(i.height, CAST(trunc(a.y + a.h) AS INT)) AS y2
     FROM q JOIN fx_annotations a USING (ann_id) JOIN fx_images i ON i.image_id = a.image_id)
   SELECT j.ann_id AS ann_id, queue, file_name, coalesce(g.name, concat('Unknown (', CAST(gt_cat AS VARCHAR), ')')) AS gt_name, round(suspicion, 4) AS suspicion,
     CASE WHEN suspicion > 0.2::DOUBLE THEN 'high' WHEN suspicion > 0.1::DOUBLE THEN 'med' ELSE 'low' END AS tier, coalesce(CAST(p.corrected_count AS VARCHAR), 'N/A') AS corrected, n1.name AS top1_name, n3.name AS top3_name
   FROM j LEFT JOIN fx_categories g ON g.category_id = gt_cat LEFT JOIN fx_categories n1 ON n1.category_id = top1_cat LEFT JOIN fx_categories n3 ON n3.category_id = top3_cat LEFT JOIN fx_products p ON p.category_id = gt_cat
   WHERE x2 - x1 >= 5 AND y2 - y1 >= 5""")
def _(s, d):
    t = T(s, d)
    out = cleaning.review_queue(t.similarities, t.annotations, t.images, t.categories, t.products, 1.1, 150)
    return out.select("ann_id", "queue", "file_name", "gt_name", "suspicion", "tier", "corrected", "top1_name", "top3_name")


# --- votes ---------------------------------------------------------------------------------

_BODY = "regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')"
_RESP = f"""resp AS (SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 9
     WHEN 0 THEN concat('{{"match": true, "reason": "', {_BODY}, '"}}') WHEN 1 THEN concat('Sure:\n```json\n{{"match": false, "reason": "', {_BODY}, '"}}\n```\n')
     WHEN 2 THEN concat('{{"match": false, "reason": "', {_BODY}) WHEN 3 THEN '{{"match":true, "reason' WHEN 4 THEN concat('These are NOT the same item. ', {_BODY})
     WHEN 5 THEN concat('It looks like the same product. ', replace(lower({_BODY}), 'not', 'no')) WHEN 6 THEN concat('Different product: ', {_BODY})
     WHEN 7 THEN '  {{"match": null, "reason": "unsure"}}  ' ELSE {_BODY} END AS text FROM conversations),
   cut AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r\\x0b\\x0c') AS raw FROM resp),
   inside AS (SELECT conv_id, turn, raw, CASE WHEN contains(raw, '```') THEN trim(regexp_replace(string_split(raw, '```')[2], '^json', ''), E' \\t\\n\\r\\x0b\\x0c') ELSE raw END AS t FROM cut)"""


def _responses(t: T):
    body = F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")
    kind = (F.col("conv_id") * 3 + F.col("turn")) % 9
    text = (
        F.when(kind == 0, F.concat(F.lit('{"match": true, "reason": "'), body, F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('Sure:\n```json\n{"match": false, "reason": "'), body, F.lit('"}\n```\n')))
        .when(kind == 2, F.concat(F.lit('{"match": false, "reason": "'), body)).when(kind == 3, F.lit('{"match":true, "reason'))
        .when(kind == 4, F.concat(F.lit("These are NOT the same item. "), body))
        .when(kind == 5, F.concat(F.lit("It looks like the same product. "), F.replace(F.lower(body), F.lit("not"), F.lit("no"))))
        .when(kind == 6, F.concat(F.lit("Different product: "), body)).when(kind == 7, F.lit('  {"match": null, "reason": "unsure"}  ')).otherwise(body))
    return t.conversations.select("conv_id", "turn", text.alias("text"))


@query("fn_1_parse_verdict", f"""WITH {_RESP}, k AS (SELECT *, json_valid(t) AND left(t, 1) = '{{' AS ok, lower(t) AS l FROM inside)
   SELECT conv_id, turn, coalesce(CASE WHEN ok THEN CASE json_extract_string(CASE WHEN ok THEN t ELSE '{{}}' END, '$.match') WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' END
       WHEN contains(t, '"match": true') OR contains(t, '"match":true') THEN 'yes' WHEN contains(t, '"match": false') OR contains(t, '"match":false') THEN 'no'
       WHEN contains(l, 'not the same') OR contains(l, 'different product') OR contains(l, 'do not match') THEN 'no' WHEN contains(l, 'same product') AND NOT contains(l, 'not') THEN 'yes' END, 'none') AS verdict,
     CASE WHEN ok THEN coalesce(json_extract_string(CASE WHEN ok THEN t ELSE '{{}}' END, '$.reason'), '') WHEN contains(t, '"match": true') OR contains(t, '"match":true') THEN '' WHEN contains(t, '"match": false') OR contains(t, '"match":false') THEN t
       WHEN contains(l, 'not the same') OR contains(l, 'different product') OR contains(l, 'do not match') THEN left(t, 100) WHEN contains(l, 'same product') AND NOT contains(l, 'not') THEN '' ELSE 'parse_error' END AS reason FROM k""")
def _(s, d):
    v = consensus.parse_verdict(F.col("text"))
    rows = _responses(T(s, d)).select("conv_id", "turn", v.alias("v"))
    return rows.select("conv_id", "turn", F.when(F.col("v.match"), "yes").when(~F.col("v.match"), "no").otherwise("none").alias("verdict"), F.col("v.reason").alias("reason"))


_CHO = f"""ask AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('{{"choice": ', CAST(doc_id % 7 AS VARCHAR), ', "cat_id": ', CAST(doc_id % 40 AS VARCHAR), ', "confidence": "high", "reason": "', {_BODY}, '"}}')
     WHEN 1 THEN concat('```json\n{{"choice": 3, "cat_id": null, "reason": "', {_BODY}, '"}}\n```') WHEN 2 THEN concat('{{"choice": 2, "cat_id": 17, "reason": "', {_BODY})
     WHEN 3 THEN concat('I think "choice" : ', CAST(doc_id % 9 AS VARCHAR), ' because ', {_BODY}) ELSE {_BODY} END AS text FROM documents),
   ct AS (SELECT doc_id, trim(text, E' \\t\\n\\r\\x0b\\x0c') AS raw FROM ask),
   ci AS (SELECT doc_id, raw, CASE WHEN contains(raw, '```') THEN trim(regexp_replace(string_split(raw, '```')[2], '^json', ''), E' \\t\\n\\r\\x0b\\x0c') ELSE raw END AS t FROM ct),
   cv AS (SELECT doc_id, raw, json_valid(t) AND left(t, 1) = '{{' AS ok, CASE WHEN json_valid(t) AND left(t, 1) = '{{' THEN t ELSE '{{}}' END AS t, regexp_extract(raw, '"choice"\\s*:\\s*(\\d+)', 1) AS c, regexp_extract(raw, '"cat_id"\\s*:\\s*(\\d+)', 1) AS k FROM ci)"""


def _choices(t: T):
    body, i = F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), F.col("doc_id")
    text = (
        F.when(i % 5 == 0, F.concat(F.lit('{"choice": '), (i % 7).cast("string"), F.lit(', "cat_id": '), (i % 40).cast("string"), F.lit(', "confidence": "high", "reason": "'), body, F.lit('"}')))
        .when(i % 5 == 1, F.concat(F.lit('```json\n{"choice": 3, "cat_id": null, "reason": "'), body, F.lit('"}\n```')))
        .when(i % 5 == 2, F.concat(F.lit('{"choice": 2, "cat_id": 17, "reason": "'), body))
        .when(i % 5 == 3, F.concat(F.lit('I think "choice" : '), (i % 9).cast("string"), F.lit(" because "), body)).otherwise(body))
    return t.documents.select("doc_id", text.alias("text"))


@query("fn_2_parse_choice", f"""WITH {_CHO} SELECT doc_id, CAST(CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(t, '$.choice') AS INT), 0) WHEN c <> '' THEN CAST(c AS INT) ELSE 0 END AS INT) AS choice,
   coalesce(CASE WHEN ok THEN TRY_CAST(json_extract_string(t, '$.cat_id') AS INT) WHEN c <> '' AND k <> '' THEN CAST(k AS INT) END, -1) AS cat_id,
   CASE WHEN ok THEN coalesce(json_extract_string(t, '$.confidence'), 'unknown') WHEN c <> '' THEN 'unknown' ELSE 'error' END AS confidence,
   CASE WHEN ok THEN coalesce(json_extract_string(t, '$.reason'), '') WHEN c <> '' THEN 'partial_parse' ELSE concat('parse_error: ', left(raw, 80)) END AS reason FROM cv""")
def _(s, d):
    rows = _choices(T(s, d)).select("doc_id", consensus.parse_choice(F.col("text")).alias("v")).select("doc_id", "v.*")
    return rows.withColumn("cat_id", F.coalesce("cat_id", F.lit(-1)))


@query("fn_6_truncate_text", "SELECT doc_id, left(text, 40) AS head FROM documents")
def _(s, d):
    return T(s, d).documents.select("doc_id", S.truncated(F.col("text"), 40).alias("head"))


@query("fn_4_normalise_name", "SELECT p_partkey, upper(p_name) AS wanted, replace(upper(concat(p_name, '  ', p_type)), '  ', ' ') AS hit FROM part")
def _(s, d):
    hit = S.squeeze(S.shout(F.concat("p_name", F.lit("  "), "p_type")))
    return T(s, d).part.select("p_partkey", S.shout(F.col("p_name")).alias("wanted"), hit.alias("hit"))


@query("fn_9_frequency_bucket", "SELECT category_id, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' ELSE '26+' END AS bucket FROM fx_counts")
def _(s, d):
    from boxlore.operators.metrics import TAIL_BUCKETS

    return T(s, d).counts.select("category_id", S.bucket_label(F.col("n"), TAIL_BUCKETS).alias("bucket"))


_CONS = """cons AS (SELECT ann_id, count_if(vote) AS yes, count_if(NOT vote) AS no FROM fx_votes GROUP BY ann_id),
   verdict AS (SELECT ann_id, yes, no, CASE WHEN yes + no >= 2 THEN CASE WHEN yes >= 2 THEN 'match' WHEN no >= 2 THEN 'mismatch' ELSE 'disagree' END WHEN yes = 1 THEN 'match' WHEN no = 1 THEN 'mismatch' ELSE 'error' END AS consensus FROM cons)"""


@query("agg_10_vote_consensus", f"WITH {_CONS} SELECT ann_id, yes, no, CASE WHEN ann_id % 28 = 0 THEN 'no_ref' ELSE consensus END AS consensus FROM verdict")
def _(s, d):
    t = T(s, d)
    return consensus.vote_consensus(t.votes, t.annotations.where("ann_id % 28 = 0"))


@query("agg_10_vote_consensus_wide", f"WITH {_CONS} SELECT ann_id, consensus FROM verdict")
def _(s, d):
    wide = T(s, d).votes.groupBy("ann_id").pivot("voter", [1, 2, 3]).agg(F.first("vote", ignorenulls=True))
    return wide.select("ann_id", consensus.vote_consensus_wide(*[F.col(c) for c in "123"]).alias("consensus"))


@query("agg_10_two_voters", """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'match' WHEN quality = 0 AND toxic = 0 THEN 'mismatch' ELSE 'disagree' END AS consensus FROM labels""")
def _(s, d):
    return T(s, d).labels.select("doc_id", consensus.vote_consensus_wide(F.col("quality") == 1, F.col("toxic") == 1).alias("consensus"))


_RELABEL = """vc AS (SELECT ann_id, cat_id, count(*) AS n, min(voter) AS first_voter FROM fx_votes WHERE cat_id <> 0 GROUP BY ann_id, cat_id),
   best AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY n DESC, first_voter) AS rn FROM vc),
   rel AS (SELECT i.ann_id AS ann_id, coalesce(b.n, 0) AS vote_count, b.cat_id AS best_cat, CASE WHEN b.n >= 2 THEN 'agree' WHEN b.n = 1 THEN 'split' ELSE 'none' END AS consensus FROM (SELECT DISTINCT ann_id FROM fx_votes) i LEFT JOIN best b ON b.ann_id = i.ann_id AND b.rn = 1)"""


@query("agg_11_relabel_consensus", f"WITH {_RELABEL} SELECT ann_id, vote_count, coalesce(best_cat, -1) AS best_cat, consensus, coalesce(CASE WHEN consensus = 'agree' THEN best_cat END, -1) AS new_cat FROM rel")
def _(s, d):
    out = consensus.relabel_consensus(T(s, d).votes)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("best_cat", "new_cat")})


@query("agg_14_agreed_corrections", f"WITH {_RELABEL} SELECT r.ann_id AS ann_id, a.category_id AS old_cat, r.best_cat AS new_cat FROM rel r JOIN fx_annotations a USING (ann_id) WHERE consensus = 'agree'")
def _(s, d):
    t = T(s, d)
    return consensus.agreed_corrections(consensus.relabel_consensus(t.votes), t.annotations)


@query("agg_13_consensus_summary", f"WITH {_CONS} SELECT consensus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM verdict), 6) AS percent FROM verdict GROUP BY consensus")
def _(s, d):
    return consensus.consensus_summary(consensus.vote_consensus(T(s, d).votes)).withColumn("percent", r6("percent"))


@query("agg_13_disagreements", f"WITH {_CONS} SELECT ann_id, yes, no FROM verdict WHERE consensus = 'disagree' ORDER BY ann_id LIMIT 20")
def _(s, d):
    return consensus.disagreements(consensus.vote_consensus(T(s, d).votes)).select("ann_id", "yes", "no")


@query("agg_12_resolve_choice", """SELECT ann_id, voter, CASE WHEN ann_id % 3 <> 0 THEN cat_id WHEN ann_id % 5 >= 1 AND ann_id % 5 <= 3 THEN [cat_id + 100, cat_id + 200, cat_id + 300][ann_id % 5] ELSE -1 END AS cat_id FROM fx_votes""")
def _(s, d):
    c, a = F.col("cat_id"), F.col("ann_id")
    options = F.array(c + 100, c + 200, c + 300)
    out = consensus.resolve_choice(F.when(a % 3 != 0, c), (a % 5).cast("int"), options)
    return T(s, d).votes.select("ann_id", "voter", F.coalesce(out, F.lit(-1)).alias("cat_id"))


@query("flt_6_suspicion_filter", "SELECT ann_id, round(suspicion, 6) AS suspicion FROM fx_similarities WHERE suspicion >= 0.3::DOUBLE")
def _(s, d):
    return consensus.suspicious(T(s, d).similarities, 0.3).select("ann_id", r6("suspicion").alias("suspicion"))


@query("join_16_unprocessed", "SELECT ann_id FROM fx_similarities WHERE suspicion >= 0.3::DOUBLE AND ann_id NOT IN (SELECT ann_id * 3 FROM fx_votes)")
def _(s, d):
    t = T(s, d)
    return consensus.unprocessed(consensus.suspicious(t.similarities, 0.3), t.votes.withColumn("ann_id", F.col("ann_id") * 3)).select("ann_id")


_CO = """cc AS (SELECT image_id, category_id, count(*) AS n, min(ann_id) AS f FROM fx_annotations GROUP BY image_id, category_id),
   co AS (SELECT s.ann_id, s.gt_cat, cc.category_id, cc.n, row_number() OVER (PARTITION BY s.ann_id ORDER BY cc.n DESC, cc.f) AS rank FROM fx_similarities s JOIN cc ON cc.image_id = s.image_id AND cc.category_id <> s.gt_cat)"""


@query("join_17_cooccurring_categories", f"WITH {_CO} SELECT ann_id, gt_cat, rank, category_id, n FROM co WHERE rank <= 5")
def _(s, d):
    t = T(s, d)
    return consensus.cooccurring_categories(t.similarities, t.annotations)


_CAND = f"""{_CO}, allowed AS (SELECT ann_id, cat FROM (SELECT ann_id, gt_cat, unnest([top1_cat, top2_cat, top3_cat]) AS cat FROM fx_similarities) WHERE cat <> gt_cat UNION SELECT ann_id, category_id FROM co WHERE rank <= 5),
   seq AS (SELECT ann_id, gt_cat, unnest([top1_cat, top2_cat, top3_cat]) AS cat, unnest([0, 1, 2]) AS pos FROM fx_similarities),
   line AS (SELECT ann_id, cat, pos FROM seq WHERE cat <> 0 AND cat <> gt_cat UNION ALL SELECT ann_id, category_id, rank + 2 FROM co),
   fst AS (SELECT l.ann_id, l.cat, min(l.pos) AS pos FROM line l JOIN allowed a ON a.ann_id = l.ann_id AND a.cat = l.cat WHERE l.cat % 9 <> 4 GROUP BY l.ann_id, l.cat),
   cand AS (SELECT ann_id, cat, row_number() OVER (PARTITION BY ann_id ORDER BY pos) AS rank FROM fst)"""


def _candidates(t: T, known: str = "category_id % 9 <> 4"):
    return consensus.relabel_candidates(t.similarities, t.annotations, t.categories.where(known))


@query("join_18_relabel_candidates", f"WITH {_CAND} SELECT ann_id, rank, cat AS cat_id FROM cand WHERE rank <= 8")
def _(s, d):
    return _candidates(T(s, d))


@query("join_18_no_candidates", f"WITH {_CAND.replace('l.cat % 9 <> 4', 'l.cat % 40 = 4')} SELECT ann_id, 'no_candidates' AS consensus FROM fx_similarities WHERE ann_id NOT IN (SELECT ann_id FROM cand)")
def _(s, d):
    t = T(s, d)
    return consensus.without_candidates(t.similarities, _candidates(t, "category_id % 40 = 4"))  # one class has references


@query("fn_3_option_list", f"""WITH {_CAND} SELECT ann_id, string_agg(concat('  OPTION ', CAST(rank AS VARCHAR), ': ', name, ' (category_id: ', CAST(cat AS VARCHAR), ')'), E'\\n' ORDER BY rank) AS options
   FROM cand JOIN fx_categories c ON c.category_id = cat WHERE rank <= 8 GROUP BY ann_id""")
def _(s, d):
    t = T(s, d)
    named = _candidates(t).join(t.categories.withColumnRenamed("category_id", "cat_id"), "cat_id")
    lists = named.groupBy("ann_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "cat_id"))).alias("l"))
    return lists.select("ann_id", S.option_list(F.col("l.name"), F.col("l.cat_id")).alias("options"))


@query("agg_20_review_summary", "SELECT count_if(ann_id % 5 <> 0) AS reviewed, count_if(ann_id % 5 IN (1, 2)) AS correct, count_if(ann_id % 5 IN (3, 4)) AS wrong, count_if(ann_id % 5 = 4) AS corrections FROM fx_annotations")
def _(s, d):
    k = F.col("ann_id") % 5
    rows = T(s, d).annotations.select("ann_id", F.when(k.isin(1, 2), "correct").when(k.isin(3, 4), "wrong").alias("verdict"), F.when(k == 4, F.col("category_id")).alias("new_cat"))
    return consensus.review_summary(rows)


# --- tiling --------------------------------------------------------------------------------

_TI = "ti AS (SELECT o_orderkey AS image_id, CAST(700 + (o_orderkey * 37) % 3700 AS INT) AS width, CAST(700 + (o_orderkey * 53) % 2900 AS INT) AS height FROM orders)"


def _axis_sql(table: str, side: str, col: str, tile: int, stride: int) -> str:
    return f"""SELECT image_id, width, height, {col} FROM (SELECT DISTINCT image_id, width, height, unnest(CASE WHEN width < {tile} OR height < {tile} THEN [0]
        ELSE list_distinct(list_append(range(0, {side} - {tile} + 1, {stride}), {side} - {tile})) END) AS {col} FROM {table})"""


def _grid_sql(table: str, tile: int, stride: int) -> str:
    return f"""gx AS ({_axis_sql(table, 'width', 'tile_x', tile, stride)}), gy AS ({_axis_sql(table, 'height', 'tile_y', tile, stride)}),
      grid AS (SELECT gx.image_id AS image_id, CAST(tile_x AS BIGINT) AS tile_x, CAST(tile_y AS BIGINT) AS tile_y FROM gx JOIN gy USING (image_id))"""


@query("til_1_tile_grid", f"WITH {_TI}, {_grid_sql('ti', 1280, 960)} SELECT * FROM grid")
def _(s, d):
    k = F.col("o_orderkey")
    rows = T(s, d).orders.select(k.alias("image_id"), (700 + (k * 37) % 3700).cast("int").alias("width"), (700 + (k * 53) % 2900).cast("int").alias("height"))
    return tiling.tile_grid(rows, 1280, 960).select("image_id", "tile_x", "tile_y")


def _held_sql(tile: int) -> str:
    return f"""held AS (SELECT g.image_id, g.tile_x, g.tile_y, a.ann_id, a.category_id, greatest(a.x, g.tile_x) - g.tile_x AS x, greatest(a.y, g.tile_y) - g.tile_y AS y,
        least(a.x + a.w, g.tile_x + {tile}) - greatest(a.x, g.tile_x) AS w, least(a.y + a.h, g.tile_y + {tile}) - greatest(a.y, g.tile_y) AS h, a.w * a.h AS area FROM grid g JOIN fx_annotations a USING (image_id)),
      inside_tile AS (SELECT * FROM held WHERE w >= 10 AND h >= 10 AND w * h / area >= 0.5)"""


@query("join_8_tile_annotations", f"WITH {_grid_sql('fx_images', 1280, 960)}, {_held_sql(1280)} SELECT image_id, tile_x, tile_y, ann_id, category_id, x, y, w, h FROM inside_tile")
def _(s, d):
    t = T(s, d)
    return tiling.tile_annotations(t.annotations, t.images, 1280, 960)


_TC = f"""left_boxes AS (SELECT * REPLACE (x / 2 AS x) FROM fx_annotations), {_grid_sql('fx_images', 640, 480)}, {_held_sql(640).replace('fx_annotations', 'left_boxes')},
   tc AS (SELECT format('tile_{{:05d}}_{{:04d}}_{{:04d}}', g.image_id, g.tile_x, g.tile_y) AS tile, g.image_id AS image_id, g.tile_x AS tile_x, g.tile_y AS tile_y, count(i.ann_id) AS n_annotations
     FROM grid g LEFT JOIN inside_tile i ON i.image_id = g.image_id AND i.tile_x = g.tile_x AND i.tile_y = g.tile_y GROUP BY g.image_id, g.tile_x, g.tile_y),
   ec AS (SELECT *, row_number() OVER (ORDER BY {Q.mixed('image_id * 10007 + tile_x * 101 + tile_y')}, image_id, tile_x, tile_y) AS rn FROM tc WHERE n_annotations = 0),
   emp AS (SELECT * FROM ec WHERE rn <= floor((SELECT count_if(n_annotations > 0) FROM tc) * 0.2::DOUBLE))"""


def _left(t: T):
    """All boxes, moved to the left half of their image, so that tiles on the right are empty."""
    return t.annotations.withColumn("x", F.col("x") / 2)


@query("snk_5_tile_metadata", f"WITH {_TC} SELECT tile, image_id, tile_x, tile_y, n_annotations FROM tc")
def _(s, d):
    t = T(s, d)
    return tiling.tile_counts(_left(t), t.images, 640, 480).select("tile", "image_id", "tile_x", "tile_y", "n_annotations")


@query("smp_6_empty_tile_cap", f"WITH {_TC} SELECT tile, image_id FROM emp")
def _(s, d):
    t = T(s, d)
    return tiling.empty_tile_cap(tiling.tile_counts(_left(t), t.images, 640, 480)).select("tile", "image_id")


_SPLIT = f"""sole AS (SELECT DISTINCT min(image_id) AS image_id FROM fx_annotations GROUP BY category_id HAVING count(DISTINCT image_id) = 1),
   ord AS (SELECT image_id, row_number() OVER (ORDER BY {Q.mixed('image_id')}, image_id) AS rn FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM sole)),
   split AS (SELECT i.image_id AS image_id, CASE WHEN o.rn <= greatest(1, floor((SELECT count(*) FROM fx_images) * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM fx_images i LEFT JOIN ord o USING (image_id))"""


def _split(t: T):
    return sampling.val_split(t.images, t.annotations)


@query("til_2_tile_dataset", f"""WITH {_SPLIT}, train AS (SELECT i.* FROM fx_images i JOIN split USING (image_id) WHERE split = 'train'), {_TC.replace("'fx_images'", "'train'").replace('FROM fx_images', 'FROM train')}
   SELECT tile, n_annotations FROM tc WHERE n_annotations > 0 UNION ALL SELECT tile, n_annotations FROM emp""")
def _(s, d):
    t = T(s, d)
    return tiling.tile_dataset(_left(t), t.images, _split(t), 640, 480).select("tile", "n_annotations")


# --- splits and sampling -------------------------------------------------------------------

@query("smp_1_val_split", f"WITH {_SPLIT} SELECT image_id, split FROM split")
def _(s, d):
    return _split(T(s, d))


@query("smp_2_all_data_split", "SELECT image_id, 'train' AS split FROM fx_images UNION ALL SELECT image_id, 'val' FROM (SELECT image_id FROM fx_images ORDER BY image_id LIMIT 10)")
def _(s, d):
    return sampling.all_data_split(T(s, d).images)


@query("smp_2_all_data_split_stored", "SELECT image_id, 'train' AS split FROM fx_images UNION ALL SELECT image_id, 'val' FROM (SELECT image_id FROM fx_images WHERE image_id % 3 = 1 ORDER BY image_id LIMIT 5)")
def _(s, d):
    t = T(s, d)
    return sampling.all_data_split(t.images, 5, t.images.where("image_id % 3 = 1").select("image_id"))


@query("set_4_split_union", f"WITH {_SPLIT} SELECT DISTINCT image_id, 'train' AS split FROM split")
def _(s, d):
    return readers.all_train(_split(T(s, d)))


@query("set_5_split_difference", f"WITH {_SPLIT} SELECT image_id FROM fx_images EXCEPT SELECT image_id FROM split WHERE split = 'val'")
def _(s, d):
    t = T(s, d)
    return sampling.split_difference(t.images, _split(t).where("split = 'val'").select("image_id"))


_BOOST = """b0 AS (SELECT c.category_id, c.name, coalesce(n.n, 0) AS n, coalesce(p.corrected_count, 0) AS corrected_count, CASE WHEN coalesce(p.annotation_count // 20, 0) <> 0 THEN p.annotation_count // 20 ELSE coalesce(n.n, 0) END AS seen
     FROM fx_categories c LEFT JOIN (SELECT category_id + CASE WHEN category_id % 11 = 3 THEN 1000000 ELSE 0 END AS category_id, CASE WHEN category_id % 10 = 1 THEN 7 ELSE n END AS n FROM fx_counts) n USING (category_id) LEFT JOIN fx_products p ON p.product_name = c.name),
   b1 AS (SELECT *, CASE WHEN seen <> 0 THEN corrected_count / seen ELSE 0.0 END AS f FROM b0),
   b2 AS (SELECT *, n > 0 AND n <= 5 AS is_rare, n > 5 AND n <= 10 AS is_tail, name <> 'unknown_product' AND corrected_count >= 5 AND f >= 0.5 AS is_high, name <> 'unknown_product' AND corrected_count >= 5 AND f < 0.5 AND f >= 0.3 AS is_mid FROM b1),
   boost AS (SELECT category_id, name, n, corrected_count, round(f, 4) AS correction_fraction, least(6, greatest(1, CASE WHEN is_rare THEN 6 ELSE 1 END, CASE WHEN is_tail THEN 3 ELSE 1 END, CASE WHEN is_high THEN 4 ELSE 1 END, CASE WHEN is_mid THEN 3 ELSE 1 END)) AS repeat,
     concat_ws(',', CASE WHEN is_rare THEN 'rare<=5' END, CASE WHEN is_tail THEN 'tail<=10' END, CASE WHEN is_high THEN 'corr>=0.50' END, CASE WHEN is_mid THEN 'corr>=0.30' END) AS reasons FROM b2)"""
_REP = f"""{_BOOST}, pc AS (SELECT a.image_id, b.category_id, b.name, b.repeat, b.reasons, count(*) AS boxes
     FROM (SELECT category_id, CASE WHEN ann_id % 50 < image_id % 30 THEN image_id ELSE image_id - image_id % 30 END AS image_id FROM fx_annotations) a JOIN boost b USING (category_id) GROUP BY ALL),
   pi AS (SELECT image_id, sum(boxes) AS n, coalesce(sum(boxes) FILTER (repeat > 1), 0) AS boosted, max(repeat) AS strongest,
     string_agg(concat_ws(':', category_id, name, repeat, reasons, boxes), ';' ORDER BY category_id) FILTER (repeat > 1) AS sources FROM pc GROUP BY image_id),
   pj AS (SELECT i.image_id, i.file_name, coalesce(n, 0) AS n, coalesce(boosted, 0) AS boosted, coalesce(strongest, 1) AS strongest, coalesce(sources, '') AS sources FROM fx_images i LEFT JOIN pi USING (image_id)),
   rep AS (SELECT image_id, file_name, CASE WHEN strongest > 1 AND (boosted >= 3 OR boosted / greatest(n, 1) >= 0.12) THEN strongest WHEN strongest >= 4 THEN 2 ELSE 1 END AS repeat, n, boosted, round(boosted / greatest(n, 1), 4) AS boost_share, sources FROM pj)"""


def _boost(t: T):
    c = F.col("category_id")
    counts = _elsewhere(t.counts.withColumn("n", F.when(c % 10 == 1, 7).otherwise(F.col("n"))), c % 11 == 3)
    return sampling.boost_table(t.categories, counts, t.products.withColumn("annotation_count", F.floor(F.col("annotation_count") / 20.0)))


def _repeats(t: T):
    # Most boxes are gathered on every thirtieth image, so the others hold none to thirty.
    gathered = t.annotations.withColumn("image_id", F.expr("CASE WHEN ann_id % 50 < image_id % 30 THEN image_id ELSE image_id - image_id % 30 END"))
    return sampling.image_repeats(t.images, gathered, _boost(t))


@query("agg_21_boost_table", f"WITH {_BOOST} SELECT * FROM boost")
def _(s, d):
    return _boost(T(s, d)).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("smp_3_image_repeats", f"WITH {_REP} SELECT * FROM rep")
def _(s, d):
    return _repeats(T(s, d)).withColumn("sources", F.concat_ws(";", F.transform("sources", lambda c: F.concat_ws(":", c["category_id"].cast("string"), c["name"], c["repeat"].cast("string"), F.concat_ws(",", c["reasons"]), c["boxes"].cast("string")))))


@query("smp_4_oversample", f"WITH {_REP} SELECT image_id, unnest(range(1, repeat + 1)) AS copy FROM rep")
def _(s, d):
    return sampling.oversample(_repeats(T(s, d))).select("image_id", "copy")


@query("snk_3_train_manifest", f"WITH {_REP} SELECT concat('/data/', file_name) AS value FROM (SELECT file_name, unnest(range(1, repeat + 1)) AS copy FROM rep)")
def _(s, d):
    return writers.train_manifest(sampling.oversample(_repeats(T(s, d))), "/data/")


@query("agg_22_boost_report", f"WITH {_REP} SELECT count(*) AS n_images, CAST(sum(repeat) AS BIGINT) AS entries, count_if(repeat > 1) AS repeated_images, round(sum(repeat) / count(*), 4) AS oversample_factor, (SELECT count_if(repeat > 1) FROM boost) AS boosted_classes FROM rep")
def _(s, d):
    t = T(s, d)
    return sampling.boost_report(_boost(t), _repeats(t))


@query("agg_22_boosted_classes", f"WITH {_BOOST} SELECT category_id, repeat, n FROM boost WHERE repeat > 1")
def _(s, d):
    return sampling.boosted_classes(_boost(T(s, d))).select("category_id", "repeat", "n")


@query("agg_22_repeated_images", f"WITH {_REP} SELECT image_id, repeat FROM rep WHERE repeat > 1 ORDER BY repeat DESC, image_id LIMIT 100")
def _(s, d):
    return sampling.repeated_images(_repeats(T(s, d))).select("image_id", "repeat")


@query("snk_4_json_report", f"""WITH {_REP}, top AS (SELECT category_id, repeat FROM boost WHERE repeat > 1 ORDER BY repeat DESC, n, category_id LIMIT 5)
   SELECT concat('{{"n_images":', count(*), ',"entries":', CAST(sum(repeat) AS BIGINT), ',"boosted":[', (SELECT string_agg(concat('{{"category_id":', category_id, ',"repeat":', repeat, '}}'), ',' ORDER BY repeat DESC, category_id) FROM top), ']}}') AS report FROM rep""")
def _(s, d):
    t = T(s, d)
    boost = _boost(t)
    top = sampling.boosted_classes(boost).limit(5).select("category_id", "repeat")
    return writers.json_report(sampling.boost_report(boost, _repeats(t)).select("n_images", "entries"), boosted=(top, [F.col("repeat").desc(), F.col("category_id")]))


_REAL = "real AS (SELECT file_name, split, image_id FROM fx_images JOIN split USING (image_id)), syn AS (SELECT CASE WHEN image_id % 3 = 0 THEN file_name ELSE concat('syn_', file_name) END AS file_name, 'train' AS split, image_id + 100000 AS image_id FROM fx_images)"


def _sources(t: T):
    real = t.images.join(_split(t), "image_id").select("file_name", "split", "image_id")
    name = F.when(F.col("image_id") % 3 == 0, F.col("file_name")).otherwise(F.concat(F.lit("syn_"), F.col("file_name")))
    syn = t.images.select(name.alias("file_name"), F.lit("train").alias("split"), (F.col("image_id") + 100000).alias("image_id"))
    return real, syn


@query("set_2_combine_datasets", f"""WITH {_SPLIT}, {_REAL} SELECT file_name, split, image_id, 'synthetic' AS source FROM syn UNION ALL
   SELECT file_name, split, image_id, 'real' FROM real WHERE split = 'val' OR file_name NOT IN (SELECT file_name FROM syn)""")
def _(s, d):
    return sampling.combine_datasets(*_sources(T(s, d)))


@query("agg_24_combine_counts", f"WITH {_SPLIT}, {_REAL} SELECT count_if(split = 'train') AS real_train, (SELECT count(*) FROM syn) AS synthetic_train, count_if(split = 'val') AS val, count_if(split = 'train') + (SELECT count(*) FROM syn) AS total_train FROM real")
def _(s, d):
    return sampling.combine_counts(*_sources(T(s, d)))


def _u(key: str, s: int) -> str:
    return f"({Q.mixed(f'({key}) * 4 + {s}')} / 4294967296.0::DOUBLE * 2 - 1)"


_JIT = f"""tries AS (SELECT ann_id, image_id, category_id, x, y, w, h, unnest(range(0, 6)) AS attempt FROM fx_annotations),
   mv AS (SELECT *, ann_id * 6 + attempt AS k FROM tries),
   sz AS (SELECT *, w * (1 + {_u('k', 2)} * 0.25::DOUBLE) AS nw, h * (1 + {_u('k', 3)} * 0.25::DOUBLE) AS nh FROM mv),
   jb AS (SELECT ann_id, image_id, category_id, attempt, x, y, w, h, x + {_u('k', 0)} * 0.2::DOUBLE * w + (w - nw) / 2 AS jx, y + {_u('k', 1)} * 0.2::DOUBLE * h + (h - nh) / 2 AS jy, nw AS jw, nh AS jh FROM sz),
   ji AS (SELECT *, greatest(0.0, least(x + w, jx + jw) - greatest(x, jx)) * greatest(0.0, least(y + h, jy + jh) - greatest(y, jy)) AS i FROM jb),
   jk AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY attempt) AS rn FROM ji WHERE i / (w * h + jw * jh - i) >= 0.6
     AND least(4000, CAST(trunc(jx + jw + jw * 0.1::DOUBLE) AS INT)) - greatest(0, CAST(trunc(jx - jw * 0.1::DOUBLE) AS INT)) > 2 AND least(3000, CAST(trunc(jy + jh + jh * 0.1::DOUBLE) AS INT)) - greatest(0, CAST(trunc(jy - jh * 0.1::DOUBLE) AS INT)) > 2)"""


@query("smp_5_jitter_boxes", f"WITH {_JIT} SELECT ann_id, attempt, round(jx, 4) AS x, round(jy, 4) AS y, round(jw, 4) AS w, round(jh, 4) AS h FROM jk WHERE rn <= 2")
def _(s, d):
    t = T(s, d)
    return sampling.jitter_boxes(t.annotations, t.images, pos=0.2, scale=0.25).select("ann_id", "attempt", *[F.round(c, 4).alias(c) for c in "xywh"])


def _manifest(t: T):
    listing = readers.catalogue_files(catalogue_listing(t), 40).select("category_id", "stem")
    small = t.annotations.withColumns({"w": F.col("w") - 205, "h": F.col("h") - 205})
    return sampling.crop_manifest(small, t.images, _split(t), listing)


_MAN = f"""{_SPLIT}, sm AS (SELECT ann_id, image_id, category_id, x, y, w - 205 AS w, h - 205 AS h FROM fx_annotations),
   cr AS (SELECT ann_id, image_id, category_id, greatest(0, CAST(trunc(x - w * 0.1::DOUBLE) AS INT)) AS x1, greatest(0, CAST(trunc(y - h * 0.1::DOUBLE) AS INT)) AS y1, least(4000, CAST(trunc(x + w + w * 0.1::DOUBLE) AS INT)) AS x2,
      least(3000, CAST(trunc(y + h + h * 0.1::DOUBLE) AS INT)) AS y2 FROM sm WHERE w >= 3 AND h >= 3),
   cat AS (SELECT CAST(ann_id % 60 AS INT) AS category_id FROM fx_annotations WHERE ann_id % 9 <> 0 AND ann_id % 60 < 40)"""


@query("crp_1_crop_manifest", f"""WITH {_MAN}, {_JIT.replace('FROM fx_annotations', 'FROM sm WHERE w >= 3 AND h >= 3').replace('0.2::DOUBLE', '0.05::DOUBLE').replace('0.25::DOUBLE', '0.10::DOUBLE')}
   SELECT 'box' AS kind, split, category_id, count(*) AS n FROM cr JOIN split USING (image_id) WHERE x2 - x1 >= 1 AND y2 - y1 >= 1 GROUP BY 2, 3
   UNION ALL SELECT 'jitter', split, category_id, count(*) FROM jk JOIN split USING (image_id) WHERE rn <= 2 AND split = 'train' GROUP BY 2, 3
   UNION ALL SELECT 'catalogue', 'train', category_id, count(*) FROM cat GROUP BY 3 UNION ALL SELECT 'variant', 'train', category_id, 5 * count(*) FROM cat GROUP BY 3""")
def _(s, d):
    return _manifest(T(s, d)).groupBy("kind", "split", "category_id").agg(F.count("*").alias("n"))


@query("agg_19_crop_dataset_stats", f"""WITH {_MAN}, per AS (SELECT category_id, count_if(split = 'train') AS n_train, count_if(split = 'val') AS n_val FROM cr JOIN split USING (image_id) WHERE x2 - x1 >= 1 AND y2 - y1 >= 1 GROUP BY category_id)
   SELECT c.category_id AS category_id, coalesce(n_train, 0) AS n_train, coalesce(n_val, 0) AS n_val, coalesce(n_train > 0 AND n_train <= 5, false) AS low_shot, coalesce(n_val, 0) = 0 AS zero_shot_val FROM fx_categories c LEFT JOIN per USING (category_id)""")
def _(s, d):
    t = T(s, d)
    return sampling.crop_dataset_stats(_manifest(t).where("kind = 'box'"), t.categories)


@query("agg_19_crop_distribution", f"""WITH {_MAN}, per AS (SELECT category_id, count(*) AS n FROM cr JOIN split USING (image_id) WHERE split = 'train' AND x2 - x1 >= 1 AND y2 - y1 >= 1 GROUP BY category_id)
   SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '101+' END AS bucket, count(*) AS n_categories FROM per GROUP BY 1""")
def _(s, d):
    t = T(s, d)
    stats = sampling.crop_dataset_stats(_manifest(t).where("kind = 'box'"), t.categories)
    return audit.crop_distribution(stats.withColumnRenamed("n_train", "n")).select("bucket", "n_categories")


# --- sources and sinks ---------------------------------------------------------------------

def _scratch(s) -> str:
    return f"{shared_dir(s)}/trip-{uuid.uuid4().hex}"


_YOLO = "printf('%d %.6f %.6f %.6f %.6f', {c}, (x + w / 2) / 4000, (y + h / 2) / 3000, w / 4000, h / 3000)"
for _name, _single in (("snk_1_yolo_labels", False), ("snk_1_yolo_labels_single_class", True)):
    def _yolo(s, d, single=_single):
        t = T(s, d)
        # A seventh of the images has given its boxes away.
        anns = t.annotations.withColumn("image_id", F.when(F.expr("image_id % 7 = 3"), F.col("image_id") + 1).otherwise(F.col("image_id")))
        return writers.yolo_labels(anns, t.images, _split(t), single).select("split", "image_id", "label_file", "labels")
    query(_name, f"""WITH {_SPLIT}, l AS (SELECT image_id, string_agg({_YOLO.format(c='0' if _single else 'category_id')}, E'\\n' ORDER BY ann_id) AS labels FROM (SELECT * REPLACE (CASE WHEN image_id % 7 = 3 THEN image_id + 1 ELSE image_id END AS image_id) FROM fx_annotations) GROUP BY image_id)
      SELECT split, i.image_id AS image_id, replace(i.file_name, '.jpg', '.txt') AS label_file, coalesce(labels, '') AS labels FROM fx_images i JOIN split USING (image_id) LEFT JOIN l USING (image_id)""")(_yolo)


@query("snk_1_label_shards", f"""WITH {_SPLIT}, l AS (SELECT image_id, string_agg({_YOLO.format(c='category_id')}, E'\\n' ORDER BY ann_id) AS labels FROM (SELECT * REPLACE (CASE WHEN image_id % 7 = 3 THEN image_id + 1 ELSE image_id END AS image_id) FROM fx_annotations) GROUP BY image_id)
   SELECT split, replace(i.file_name, '.jpg', '.txt') AS label_file, coalesce(labels, '') AS labels FROM fx_images i JOIN split USING (image_id) LEFT JOIN l USING (image_id)""")
def _(s, d):
    t, path = T(s, d), _scratch(s)
    anns = t.annotations.withColumn("image_id", F.when(F.expr("image_id % 7 = 3"), F.col("image_id") + 1).otherwise(F.col("image_id")))
    writers.write_label_shards(anns, t.images, _split(t), path, 16)
    return writers.read_label_shards(s, path)


@query("snk_2_predictions_json", "SELECT image_id, category_id, x, y, w, h, score FROM fx_predictions")
def _(s, d):
    path = _scratch(s)
    writers.predictions_json(T(s, d).predictions, path)
    rows = s.read.schema("image_id bigint, category_id int, bbox array<double>, score double").json(path)
    return readers.flat_boxes(rows)


@query("src_2_predictions_scan", "SELECT row_number() OVER (ORDER BY pred_id) - 1 AS pred_id, image_id, category_id, x, y, w, h, score FROM fx_predictions")
def _(s, d):
    path = _scratch(s)
    writers.predictions_json(T(s, d).predictions.orderBy("pred_id"), path)  # files and rows in order
    return readers.predictions_scan(s, path, lines=True)


def _coco_doc(t: T, path: str) -> None:
    """One document per thousand rows, so no single task holds the dataset."""
    kinds = {"images": "array<struct<id:bigint,file_name:string,width:int,height:int>>", "annotations": "array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double>>", "categories": "array<struct<id:int,name:string>>"}
    parts = {
        "images": t.images.select(F.col("image_id").alias("id"), "file_name", "width", "height"),
        "annotations": t.annotations.select(F.col("ann_id").alias("id"), "image_id", "category_id", G.as_array(G.box_of()).alias("bbox"), (F.col("w") * F.col("h")).alias("area")),
        "categories": t.categories.select(F.col("category_id").alias("id"), "name"),
    }
    for kind, rows in parts.items():
        docs = rows.groupBy(F.floor(F.col("id") / 1000.0).alias("g")).agg(F.collect_list(F.struct(*rows.columns)).alias(kind))
        docs.select(*[F.col(k) if k == kind else F.array().cast(v).alias(k) for k, v in kinds.items()]).write.mode("append").json(path)


_SCAN = """SELECT 'image' AS kind, image_id AS id, file_name AS label, CAST(width AS DOUBLE) AS v FROM fx_images UNION ALL SELECT 'annotation', ann_id, CAST(category_id AS VARCHAR), x + y + w + h FROM fx_annotations
   UNION ALL SELECT 'category', category_id, name, 0 FROM fx_categories"""


def _scanned(images, anns, cats):
    images = images.select(F.lit("image").alias("kind"), F.col("image_id").alias("id"), F.col("file_name").alias("label"), F.col("width").cast("double").alias("v"))
    anns = anns.select(F.lit("annotation").alias("kind"), F.col("ann_id").alias("id"), F.col("category_id").cast("string").alias("label"), (F.col("x") + F.col("y") + F.col("w") + F.col("h")).alias("v"))
    cats = cats.select(F.lit("category").alias("kind"), F.col("category_id").cast("bigint").alias("id"), F.col("name").alias("label"), F.lit(0.0).alias("v"))
    return images.unionByName(anns).unionByName(cats)


def _one_document(s, parts, path: str) -> None:
    """All rows as the arrays of one JSON document, cut into files that give it when put together in the order of their names."""
    lines = None
    for i, (kind, rows) in enumerate(parts):
        body = rows.select(F.lit(i).alias("part"), F.col("id"), F.to_json(F.struct(*rows.columns)).alias("value"))
        first = F.col("id") == rows.agg(F.min("id")).scalar()
        opens = ('{"' if i == 0 else '], "') + kind + '": ['
        body = body.withColumn("value", F.concat(F.when(first, F.lit(opens) if kind else F.lit("[")).otherwise(", "), "value"))
        lines = body if lines is None else lines.unionByName(body)
    end = s.range(1).select(F.lit(len(parts)).alias("part"), F.lit(0).cast("bigint").alias("id"), F.lit("]}" if parts[0][0] else "]").alias("value"))
    lines.unionByName(end).orderBy("part", "id").select("value").write.text(path)


@query("src_1_coco_arrays", _SCAN)
def _(s, d):
    t, path = T(s, d), _scratch(s)
    _one_document(s, [
        ("images", t.images.select(F.col("image_id").alias("id"), "file_name", "width", "height")),
        ("annotations", t.annotations.select(F.col("ann_id").alias("id"), "image_id", "category_id", G.as_array(G.box_of()).alias("bbox"), (F.col("w") * F.col("h")).alias("area"))),
        ("categories", t.categories.select(F.col("category_id").cast("bigint").alias("id"), "name")),
    ], path)
    return _scanned(*readers.coco_arrays(s, path))


@query("src_2_predictions_array", "SELECT row_number() OVER (ORDER BY pred_id) - 1 AS pred_id, image_id, category_id, x, y, w, h, score FROM fx_predictions")
def _(s, d):
    path = _scratch(s)
    rows = T(s, d).predictions.select(F.col("pred_id").alias("id"), "image_id", "category_id", G.as_array(G.box_of()).alias("bbox"), "score")
    _one_document(s, [("", rows)], path)
    return readers.predictions_array(s, path)


@query("src_1_coco_scan", _SCAN)
def _(s, d):
    path = _scratch(s)
    _coco_doc(T(s, d), path)
    return _scanned(*readers.coco_scan(s, path, lines=True))


@query("src_3_product_metadata_scan", "SELECT product_name, product_code, corrected_count FROM fx_products")
def _(s, d):
    path = _scratch(s)
    p, c = T(s, d).products, F.col("category_id")
    name = F.col("product_name")
    rows = p.select(F.when(c % 3 == 0, name).when(c % 3 == 1, F.lit("")).alias("product_name"), F.when(c % 3 == 1, name).alias("name"), F.when(c % 3 == 2, name).alias("display_name"), "product_code", "corrected_count")
    rows.write.json(path)
    return readers.product_metadata_scan(s, path, lines=True).select("product_name", "product_code", "corrected_count")


@query("src_4_split_scan", f"WITH {_SPLIT} SELECT image_id, split FROM split")
def _(s, d):
    path = _scratch(s)
    pick = lambda n: F.collect_list(F.when(F.col("split") == n, F.col("image_id")))
    # Ids of one split file per thousand images.
    per = _split(T(s, d)).groupBy(F.floor(F.col("image_id") / 1000.0).alias("g")).agg(pick("train").alias("train_ids"), pick("val").alias("val_ids"))
    per.select("train_ids", "val_ids", F.lit(42).alias("seed")).repartition("g").write.json(path)
    return readers.split_scan(s, path, lines=True)


def _winners(s, d, order):
    """The winning correction of two paths of unequal size, read in the given order."""
    path = _scratch(s)
    rows = _corrections(T(s, d))
    for n in (1, 2):
        rows.where(F.col("ordinal") == n).select("ann_id", "old_cat", "new_cat").write.json(f"{path}/{n}")
    read = readers.corrections_scan(s, [f"{path}/{n}" for n in order], lines=True)
    return ranking.last_wins(read.drop("source", "file"), ["ann_id"], "ordinal").select("ann_id", "old_cat", "new_cat")


@query("src_5_corrections_scan", f"WITH {_NEW} SELECT ann_id, old_cat, new_cat FROM lastc")
def _(s, d):
    return _winners(s, d, (1, 2))


@query("src_5_corrections_scan_reversed", f"WITH {_CORR} SELECT ann_id, arg_min(old_cat, ordinal) AS old_cat, arg_min(new_cat, ordinal) AS new_cat FROM corr GROUP BY ann_id")
def _(s, d):
    return _winners(s, d, (2, 1))


@query("src_6_verification_scan", f"WITH {_CONS} SELECT ann_id, consensus FROM verdict WHERE consensus = 'mismatch'")
def _(s, d):
    path = _scratch(s)
    consensus.vote_consensus(T(s, d).votes).select("ann_id", "consensus").write.json(path)
    return readers.verification_scan(s, path + "-final", path, lines=True).select("ann_id", "consensus")


@query("src_9_sweep_results_scan", "SELECT o_orderkey % 97 / 100.0::DOUBLE AS conf, o_orderkey AS n_preds, 1.2::DOUBLE AS second_weight FROM orders")
def _(s, d):
    path, k = _scratch(s), F.col("o_orderkey")
    T(s, d).orders.select((k % 97 / F.lit(100.0)).alias("conf"), F.array(F.lit(1.0), F.lit(1.2)).alias("weights"), k.alias("n_preds")).write.json(path)
    return readers.sweep_results_scan(s, path, lines=True).select("conf", "n_preds", F.get("weights", F.lit(1)).alias("second_weight"))


# --- models and streams --------------------------------------------------------------------

def _scorer():
    def score(pdf):
        import pandas as pd

        # Arrays: most calls are for one row, where sums of columns cost more than all else.
        if (pdf["ann_id"].to_numpy() % 101 == 0).any():
            raise ValueError("cannot score")
        return pd.DataFrame({"value": pdf["w"].to_numpy() * pdf["h"].to_numpy() / 2})
    return score


@query("udf_1_batch_predict", "SELECT ann_id, CASE WHEN ann_id % 101 = 0 THEN -1.0 ELSE w * h / 2 END AS value, CASE WHEN ann_id % 101 = 0 THEN 'cannot score' ELSE '' END AS error FROM fx_annotations")
def _(s, d):
    out = predict.batch_predict(T(s, d).annotations.select("ann_id", "w", "h"), _scorer, "ann_id", "value double", {"value": -1.0})
    return out.withColumn("error", F.coalesce("error", F.lit("")))


def _voter(number: int):
    def factory():
        def vote(pdf):
            import pandas as pd

            ids = pdf["ann_id"].to_numpy()
            if number == 3 and (ids % 7 == 0).any():
                raise TimeoutError("too slow")
            return pd.DataFrame({"match": (ids + number) % 2 == 0, "reason": "looked"})
        return vote
    return factory


@query("udf_2_multi_voter", """SELECT ann_id, voter, CASE WHEN voter = 3 AND ann_id % 7 = 0 THEN 'none' WHEN (ann_id + voter) % 2 = 0 THEN 'yes' ELSE 'no' END AS vote, CASE WHEN voter = 3 AND ann_id % 7 = 0 THEN 'error: too slow' ELSE 'looked' END AS reason
   FROM fx_annotations CROSS JOIN (SELECT unnest([1, 2, 3]) AS voter)""")
def _(s, d):
    out = predict.multi_voter(T(s, d).annotations.select("ann_id"), {n: _voter(n) for n in (1, 2, 3)})
    return out.select("ann_id", "voter", F.when(F.col("match"), "yes").when(~F.col("match"), "no").otherwise("none").alias("vote"), "reason")


@query("udf_3_ensemble_config", "SELECT name, count(*) AS n, round(sum(score * weight), 4) AS weighted FROM fx_predictions JOIN (SELECT 0 AS model_id, 'A' AS name, 1.0 AS weight UNION ALL SELECT 1, 'B', 1.2 UNION ALL SELECT 2, 'C', 1.0) USING (model_id) GROUP BY name")
def _(s, d):
    models = predict.ensemble_config(s, {"model_a": "a.onnx", "model_b": "b.onnx", "model_c": "c.onnx", "weights": [1.0, 1.2]})
    return T(s, d).predictions.join(models, "model_id").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score") * F.col("weight")), 4).alias("weighted"))


@query("str_1_incremental_consensus", f"WITH {_CONS} SELECT ann_id, yes, no, consensus FROM verdict")
def _(s, d):
    path = _scratch(s)
    votes = T(s, d).votes.select("ann_id", "voter", "vote")
    for i in range(2):  # a second run takes up what arrived since; an item's votes come in several files and runs
        votes.where((F.col("ann_id") + F.col("voter")) % 2 == i).repartition(3, "voter").write.parquet(f"{path}/votes/day={i}")
        consensus_stream.incremental_consensus(s, f"{path}/votes/*", f"{path}/results", f"{path}/progress", files_per_batch=2)
    return consensus_stream.results(s, f"{path}/results").select("ann_id", "yes", "no", "consensus")

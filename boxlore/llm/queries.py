"""The operators on their whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlore.llm import decontaminate, language_model, main_text, near_dedup, packing, phrases, prefix_trie, quality, sharding, span_dedup, token_file, toxicity, vector_dedup
from boxlore.session import owner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COMPONENTS = """
reach(a, b) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)"""


@query(rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM texts),
nodes AS (SELECT id, len(s) AS n FROM shingled),
flat AS (SELECT id, unnest(s) AS g FROM shingled),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM flat x JOIN flat y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT nodes.id AS doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id, nodes.id = min(b) AS kept
FROM nodes JOIN reach ON reach.a = nodes.id GROUP BY nodes.id, n""")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"), owner(spark), percent=85, bands=25, rows=5)


def _vector_links_sql(nodes: str) -> str:
    return f"""
WITH RECURSIVE nodes AS ({nodes}),
good AS (
  SELECT * FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_COMPONENTS},
n AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT nodes.id AS vec_id, CAST(coalesce(max(n.k), 0) AS BIGINT) AS n_links, min(reach.b) AS component_id, nodes.id = min(reach.b) AS kept
FROM nodes JOIN reach ON reach.a = nodes.id LEFT JOIN n ON n.a = nodes.id GROUP BY nodes.id"""


@query(_vector_links_sql("SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"))
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.links(_table(spark, sf_dir, "embeddings"), owner(spark))


_NEAR = """
  SELECT vec_id * 4 + k AS id, label, CASE k WHEN 0 THEN v WHEN 1 THEN list_transform(v, lambda x: x * 3)
    WHEN 2 THEN list_transform(v, lambda x, i: CASE WHEN i <= 4 THEN x + 0.05 ELSE x END) ELSE list_transform(v, lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END) END AS v
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, unnest([0, 1, 2, 3]) AS k FROM embeddings)"""


@query(_vector_links_sql(_NEAR))
def vector_dedup_of_changed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with a scaled copy, a shifted one and one turned away: links exist, and not everywhere."""
    v = F.col("embedding").cast("array<double>")
    kinds = F.array(v, F.transform(v, lambda x: x * 3), F.transform(v, lambda x, i: F.when(i < 4, x + 0.05).otherwise(x)), F.transform(v, lambda x, i: F.when(i % 2 == 1, -x).otherwise(x)))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(kinds).alias("k", "embedding"))
    return vector_dedup.links(rows.withColumn("vec_id", F.col("vec_id") * 4 + F.col("k")).drop("k"), owner(spark))


@query(r"""
WITH bytes AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
sized AS (SELECT doc_id, x, CAST(length(x) / 2 AS BIGINT) AS n FROM bytes),
starts AS (SELECT doc_id, unnest(range(0, n - 49)) AS p, x FROM sized WHERE n >= 50),
strings AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 100)) AS s FROM starts),
least_doc AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s),
hits AS (SELECT doc_id, p FROM strings JOIN least_doc USING (s) WHERE doc_id > d),
runs AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM runs),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, r),
edges AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans),
pieces AS (
  SELECT e.doc_id, string_agg(CASE WHEN k = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * b + 1, 2 * (coalesce(nxt, n) - b)), '' ORDER BY a) AS rest,
    sum(b - a) AS gone, count(*) AS spans
  FROM edges e JOIN sized USING (doc_id) GROUP BY e.doc_id)
SELECT sized.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE rest END)) AS kept_sha256
FROM sized LEFT JOIN pieces USING (doc_id)""")
def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public tokenizer file of the byte-level vocabulary; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), owner(spark), tokenizer_path())


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), own=owner(spark))


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"), owner(spark))


@query()
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(_table(spark, sf_dir, "documents"), owner(spark))


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), owner(spark))


@query()
def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.digest(token_file.write(_table(spark, sf_dir, "documents"), owner(spark), tokenizer_path()))


@query()
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), owner(spark), 24)
    return placed.select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"),
    )


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k)),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
longer AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest FROM longer, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN freq x ON x.lang = cuts.lang AND x.phrase = head JOIN freq y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS outside
  FROM longer, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE outside IS NULL OR CAST(100 AS HUGEINT) * outside < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), owner(spark))


@query(r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: xor(s >> 8, t[CAST((xor(s, x) & 255) + 1 AS INTEGER)])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), bits),
turns AS (
  SELECT conv_id AS c, d, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT convs.c, 0 AS part, k, d, b FROM convs JOIN turns ON turns.c = base AND k <= h
  UNION ALL SELECT convs.c, 1, k, d, b FROM convs JOIN turns ON turns.c = convs.c AND k > h),
prefixes AS (SELECT c, string_agg(d, '') OVER w AS p, row_number() OVER w AS depth, b FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, k ROWS UNBOUNDED PRECEDING)),
members AS (SELECT * FROM prefixes UNION ALL SELECT c, '', 0, 0 FROM convs),
nodes AS (SELECT p, depth, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM members GROUP BY p, depth),
kids AS (SELECT substr(p, 1, 32 * (depth - 1)) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
above AS (SELECT substr(p, 1, 32 * a) AS p, n, b, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT p, sum((n - 1) * b) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM above GROUP BY p),
ending AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, depth) AS p FROM members GROUP BY c) GROUP BY p)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes x JOIN sums USING (p) LEFT JOIN ending USING (p) LEFT JOIN nodes y ON y.depth = x.depth - 1 AND y.p = substr(x.p, 1, 32 * (x.depth - 1))""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuild(_table(spark, sf_dir, "conversations")), owner(spark))

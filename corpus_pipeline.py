"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlore.llm import decontaminate, near_dedup, packing, span_dedup, toxicity
from boxlore.llm.queries import tokenizer_path
from boxlore.session import owned, owner


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup.keep_first(docs, owner(spark))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that also start in an earlier document; ``n_chars`` follows."""
    return span_dedup.without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), owner(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    return packing.pack(docs, owner(spark), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("span_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Trained scores and token ids have no SQL; the tests hold run() against its stages, and those against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as a Parquet table and read again.

    A stage's own tables go when it is written, its input when its output is; the result lives
    until :func:`boxlore.session.release`.
    """
    docs, before, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], owner(spark)
    for _, stage in STAGES:
        with owned(spark):
            docs = own.keep(stage(spark, docs, sf_dir))
        own.discard(*before)
        before = [docs]
    return docs

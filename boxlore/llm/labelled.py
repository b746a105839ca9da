"""Bounded samples of labelled documents, and the fixed split into training and held-out ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 1 << 16  # bytes of a text that may enter a sample; longer ones are scored but not learnt from


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and row weights of at most ``per_class`` training documents of each label.

    Rows are those whose id hashes lowest, so the choice does not depend on partitions. Weights
    restore the label shares among all training labels. Labels other than 0 and 1, and null ids,
    are ignored; an id with several labels counts by its highest.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(key, modulus) != held_out)).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in sorted(totals):
        some = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return [], np.zeros(0), np.zeros(0)
    # At most two times per_class ids.
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.octet_length("_text") <= LONGEST).join(F.broadcast(picked), "_id").collect()
    rows = sorted({r["_id"]: r for r in rows}.values(), key=lambda r: r["_id"])
    y = np.array([r["_label"] for r in rows], float)
    weight = np.ones(len(y))
    for value, n in totals.items():
        weight[y == value] = n / max((y == value).sum(), 1)
    return [r["_text"] or "" for r in rows], y, weight / max(weight.mean(), 1e-300) if len(y) else weight

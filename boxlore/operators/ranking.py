"""Exact ranks and running sums over orders too large for one task.

A window over one class, or over everything, sends all its rows to one task. Here rows are
range-partitioned on the complete order (ids included, so equal scores cannot pile up),
written once, summed per slice, and every slice adds the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxlore.session import materialise


def slice_by(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Store ``df`` in ordered slices of similar size, numbered in ``_slice``.

    The number has to be stored: recomputed range bounds could differ.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


def rank_slices(cut: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Mapping[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """Positions and running sums per group over the slices of :func:`slice_by`.

    Any grouping works on slices of one overall order, so one stored cut can serve several.
    """
    sums, group = dict(sums or {}), list(group)
    parts = cut.groupBy(*group, "_slice").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    # At most one row per slice in every partition of this window.
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        *group, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s0_{c}") for c in sums],
    )
    inside = W.partitionBy(*group, "_slice").orderBy(*order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cut.select(
        "*",
        F.row_number().over(inside).alias("_r"),
        *[F.sum(c).over(running).alias(f"_c_{c}") for c in sums],
    ).join(starts, [*group, "_slice"])
    return out.select(
        *[c for c in cut.columns if c != "_slice"],
        (F.col("_r") + F.col("_n0")).cast("bigint").alias(rank),
        *[(F.col(f"_c_{c}") + F.col(f"_s0_{c}")).alias(name) for c, name in sums.items()],
    )


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str] | None = None,
    rank: str = "rank",
    slices: int | None = None,
) -> DataFrame:
    """Add the 1-based position in ``order`` per group, and running sums ``{column: name}``.

    ``order`` must be total within a group, otherwise positions of equal rows are arbitrary.
    """
    return rank_slices(slice_by(df, [*[F.col(c) for c in group], *order], slices), group, order, sums, rank)


def first_n(df: DataFrame, order: Sequence[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of a total order, where ``n`` may grow with the data."""
    n = F.lit(n) if isinstance(n, int) else n
    return ranked(df, [], order, rank="_rank").where(F.col("_rank") <= n).drop("_rank")


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """Best ``cap`` rows per group; Spark trims every partition to ``cap`` before it shuffles."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def last_wins(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """Keep the record with the highest ordinal per key; one combinable aggregate."""
    rest = [c for c in df.columns if c not in key and c != ordinal]
    return df.groupBy(*key).agg(F.max(F.struct(ordinal, *rest)).alias("_r")).select(*key, F.col("_r." + ordinal), *[F.col(f"_r.{c}") for c in rest])


def id_gaps(df: DataFrame, col: str) -> DataFrame:
    """Places where sorted distinct ids jump by more than one.

    Ids are cut into blocks of a million. Inside a block a window finds the jumps; the first
    and last id of every block, one row each, are joined to find jumps between blocks.
    """
    block = 1_000_000
    ids = df.select(F.col(col).cast("bigint").alias("id")).distinct().withColumn("_b", F.floor(F.col("id") / F.lit(float(block))))
    inside = ids.select(
        F.lag("id").over(W.partitionBy("_b").orderBy("id")).alias("previous_id"), F.col("id").alias("next_id")
    )
    edges = ids.groupBy("_b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # As many rows as there are blocks: one per million ids.
    between = ranked(edges, [], [F.col("_b").asc()], rank="_r")
    nxt = between.select((F.col("_r") - 1).alias("_r"), F.col("lo").alias("next_id"))
    across = between.select("_r", F.col("hi").alias("previous_id")).join(nxt, "_r").select("previous_id", "next_id")
    return (
        inside.where(F.col("previous_id").isNotNull()).unionByName(across)
        .where(F.col("next_id") - F.col("previous_id") > 1)
        .select("previous_id", "next_id", (F.col("next_id") - F.col("previous_id") - 1).alias("missing"))
    )

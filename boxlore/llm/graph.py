"""Union-find over tables: connected components without leaving Spark, and inside one block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.operators.components import components, forest
from boxlore.session import Scratch

__all__ = ["components", "forest", "in_chunks"]

FEW = 200_000  # groups whose sizes are sent to every task


def in_chunks(df: DataFrame, group: list[str], key: str, size: int, own: Scratch | None = None) -> DataFrame:
    """Number the rows of each group into ``_n`` chunks (``_c``) of about ``size`` by a hash of ``key``.

    A group of any size is then compared chunk against chunk, in tasks of bounded size. With
    ``own``, for a stored ``df`` of wide rows, these are not sent to the sizes of their groups
    where the groups are few.
    """
    count = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    if own is not None:
        count = own.keep(count)
        count = F.broadcast(count) if count.count() <= FEW else count
    sized = df.join(count, group)
    n = F.ceil(F.col("_rows") / F.lit(size)).cast("int")
    return sized.withColumn("_n", n).withColumn("_c", F.pmod(F.xxhash64(key, F.lit(17)), F.col("_n").cast("bigint")).cast("int")).drop("_rows")

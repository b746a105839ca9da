"""Connected components over tables, and units of work made of them.

Each round unites every id with the neighbour of best priority, a fresh hash per round, and goes
on with the contracted links, so chains shrink as fast as stars and rounds grow with the
logarithm of the ids. At most :data:`LOCAL` links are united by one task. Going back, each round's
answer is one join with the next one's and is stored: no plan ever holds more than one round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.session import Scratch

LOCAL = 100_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member number of each of ``n`` items' component under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id that each id of a few links reaches."""
    both = [np.stack([x.column(c).to_numpy() for c in "ab"]) for x in batches if x.num_rows]
    if both:
        ids, at = np.unique(np.concatenate(both, 1), return_inverse=True)
        at = at.reshape(2, -1)
        up = ids[forest(len(ids), at[0], at[1])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(up)], names=["id", "up"])



def components(pairs: DataFrame, own: Scratch, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``pairs``; ids are bigint.

    Loops, repeated and null links are ignored. The rounds' tables are dropped on the way.
    """
    links = own.keep(pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    rounds: list[DataFrame] = []
    while True:
        if links.count() <= local:
            rounds.append(own.keep(links.repartition(1).mapInArrow(_unite, "id bigint, up bigint")))
            break
        salt = F.lit(len(rounds))
        rank = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = own.keep(best.select(F.col("a").alias("id"), F.least(rank("a"), F.col("m"))["v"].alias("up")))
        left, right = hook.select(F.col("id").alias("a"), F.col("up").alias("p")), hook.select(F.col("id").alias("b"), F.col("up").alias("q"))
        # Sorted joins: a table sent to all tasks would stay with the driver as long as the plan.
        joined = links.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where("p <> q")
        rest = own.keep(joined.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        own.discard(links)
        links = rest
        rounds.append(hook)
    own.discard(links)
    stored = rounds.pop()
    root = stored.withColumnRenamed("up", "root")
    for hook in reversed(rounds):
        later = root.select(F.col("id").alias("up"), F.col("root").alias("far"))
        root = own.keep(hook.join(later.hint("merge"), "up", "left").select("id", F.coalesce("far", "up").alias("root")))
        own.discard(hook, stored)
        stored = root
    least = root.groupBy("root").agg(F.min(F.least("id", "root")).alias("component"))
    return root.join(least, "root").select("id", "component")


def in_units(pairs: DataFrame, hot: DataFrame | None, keys: Sequence[str], left: Sequence[str], right: Sequence[str], own: Scratch, one_kind: bool = False) -> DataFrame:
    """``pairs`` with ``_unit``: what a task decides on its own.

    Pairs link what ``left`` and ``right`` name inside a group of ``keys`` (things of ``one_kind``,
    or of two that share no name); what is not linked is decided independently. Groups in ``hot``
    are cut into their components (two may share a number by chance, which costs nothing but
    parallelism), the others stay whole as unit 0.
    """
    keys = list(keys)
    if hot is None:
        return pairs.withColumn("_unit", F.lit(0).cast("bigint"))
    name = lambda side: F.xxhash64(*(F.col(k) for k in keys), *(F.col(c) for c in side))
    ends = {"_from": name(left), "_to": name(right) if one_kind else F.xxhash64(name(right), F.lit("right"))}
    large = own.keep(pairs.join(hot, keys, "left_semi").withColumns(ends))
    unit = components(large, own, "_from", "_to").select(F.col("id").alias("_from"), F.col("component").alias("_unit"))
    cut = large.join(unit, "_from", "left").withColumn("_unit", F.coalesce("_unit", "_from")).select(*pairs.columns, "_unit")
    return pairs.join(hot, keys, "left_anti").withColumn("_unit", F.lit(0).cast("bigint")).unionByName(cut)

"""Near-duplicate vectors: exact metric range join over pivot cells.

All pairs of vectors that may link are compared, which is quadratic in a cell; what is stored is
not. Vectors are sent and stored once, as chunks of one cell, and a task reads two files of chunks
and compares every chunk of one with every chunk of the other, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.llm.graph import components, forest, in_chunks
from boxlore.llm.store import set_for
from boxlore.operators.suppression import _group_starts
from boxlore.session import Scratch

CHUNK = 2048
TASK = 32 << 20  # bytes of vectors in a file; a task reads two
BLOCK = 512  # rows of a chunk that are compared at a time
HELD = 1 << 18  # links that a task holds before it sums them up


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components lose their length
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _to_cells(pivots: np.ndarray, radius: float):
    """Rows with their home cell and every cell a partner within ``radius`` may live in (a byte each)."""
    gap = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("vector")))
            square = np.maximum(2 - 2 * (x @ pivots.T), 0)
            home = square.argmin(1)
            # Distance to the plane half way between two pivots: |x-p|^2 - |x-h|^2 over 2|p-h|. A partner
            # in the cell of p lies beyond that plane, so by the triangle inequality it is at least as far.
            margin = (square - square[np.arange(len(x)), home][:, None]) / (2 * gap[home])
            reach = margin <= radius + 1e-9
            reach[np.arange(len(x)), home] = True
            columns = {c: batch.column(c) for c in ("id", "label", "copies")}
            columns |= {"cell": pa.array(home.astype(np.int32)), "reach": _blobs(reach), "vector": _blobs(x)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


_BLOBS = ("id", "copies", "reach", "vector")


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk out of rows in the order of their chunks."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        reach = _joined(rows.column("reach"))
        cells = np.flatnonzero(np.frombuffer(reach, bool).reshape(rows.num_rows, -1).any(0))
        blobs = {c: rows.column(c).to_numpy().tobytes() for c in ("id", "copies")} | {"reach": reach, "vector": _joined(rows.column("vector"))}
        label, cell = (rows.column(c).slice(0, 1).combine_chunks() for c in ("label", "cell"))
        return pa.RecordBatch.from_pydict({"label": label, "cell": cell, "cells": pa.array([cells.tolist()], pa.list_(pa.int32()))} | {c: pa.array([x], pa.binary()) for c, x in blobs.items()})

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        first = np.flatnonzero(_group_starts(held, ["label", "cell", "_c"])).tolist()
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield made(held.slice(i, j - i))
        held = held.slice(first[-1])
    if held is not None:
        yield made(held)


class _Links:
    """Numbers of links and smallest partners that a task has found."""

    def __init__(self):
        self.ids, self.n, self.a, self.b = [], [], [], []

    def count(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.ids.append(ids[n > 0])
        self.n.append(n[n > 0])

    def join(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Links between places in the sorted ``ids`` as a forest: every id with the smallest one its links reach."""
        label = forest(len(ids), a, b)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        self.a.append(ids[linked])
        self.b.append(ids[label[linked]])

    def __len__(self) -> int:
        return sum(map(len, self.ids)) + sum(map(len, self.a))

    def summed(self) -> _Links:
        out = _Links()
        if self.ids:
            ids, number = np.unique(np.concatenate(self.ids), return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, number, np.concatenate(self.n))
            out.count(ids, n)
        if self.a:
            ids, number = np.unique(np.concatenate([*self.a, *self.b]), return_inverse=True)
            out.join(ids, *np.split(number, 2))
        return out

    def batch(self) -> pa.RecordBatch:
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        ids, a = join(self.ids), join(self.a)
        columns = [np.concatenate([ids, a]), np.concatenate([join(self.n), np.zeros(len(a), np.int64)]), np.concatenate([ids, join(self.b)])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "n", "to"])


def _compare(threshold: float, dim: int):
    """Links between the rows of two chunks, or inside one.

    Products in single precision tell what may reach the threshold, with room for their error;
    those pairs are decided in double precision.
    """
    low = np.float32(threshold - (dim + 16) * 2.0**-23)

    def side(batch: pa.RecordBatch, i: int, prefix: str, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, copies and vectors of a chunk that may have partners in cell ``other``."""
        held = {c: batch.column(prefix + c)[i].as_buffer() for c in _BLOBS}
        ids, copies = np.frombuffer(held["id"], np.int64), np.frombuffer(held["copies"], np.int64)
        x, may = np.frombuffer(held["vector"], np.float64).reshape(len(ids), dim), np.frombuffer(held["reach"], bool).reshape(len(ids), -1)[:, other]
        return (ids, copies, x) if may.all() else (ids[may], copies[may], x[may])

    def pair(found: _Links, left, right, same: bool) -> None:
        (mine, copies, x), (ids, many, y) = left, right
        if not (len(mine) and len(ids)):
            return
        x32, y32 = x.astype(np.float32), y.astype(np.float32).T
        n, m, everyone = np.zeros(len(mine), np.int64), np.zeros(len(ids), np.int64), None
        for at in range(0, len(mine), BLOCK):
            near = x32[at : at + BLOCK] @ y32 >= low
            if not near.any():
                continue
            i, j = np.nonzero(near)
            if len(i) > sum(near.shape):  # more than the rows of either side to gather
                near = x[at : at + BLOCK] @ y.T >= threshold
                i, j = np.nonzero(near)
                good = mine[at + i] != ids[j]
            else:
                good = (np.einsum("ij,ij->i", x[at + i], y[j]) >= threshold) & (mine[at + i] != ids[j])
            i, j = at + i[good], j[good]
            np.add.at(n, i, many[j])
            np.add.at(m, j, copies[i])
            if len(i):
                if everyone is None:
                    everyone, number = np.unique(np.concatenate([mine, ids]), return_inverse=True)
                found.join(everyone, number[i], number[len(mine) + j])
        found.count(mine, n)
        if not same:
            found.count(ids, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Links()
        for batch in batches:
            cells = [batch.column(c).to_numpy() for c in ("a_cell", "b_cell")]
            same = pa.compute.equal(batch.column("a_k"), batch.column("b_k")).to_pylist()
            for i, (a, b) in enumerate(zip(*cells, strict=True)):
                pair(found, side(batch, i, "a_", b), side(batch, i, "b_", a), same[i])
                if len(found) > HELD:
                    found = found.summed()
                    if 2 * len(found) > HELD:
                        yield found.batch()
                        found = _Links()
        if len(found):
            yield found.summed().batch()

    return run


def _dealt(chunks: DataFrame) -> DataFrame:
    """Pairs of chunks of a label whose vectors reach each other's cell, each pair once.

    A task has the pairs of two files of ``chunks``. Of two chunks either may come first, by
    turns, so no task is idle.
    """
    sides = [chunks.select([F.col(c).alias(f"{p}_{c}") for c in chunks.columns]) for p in "ab"]
    a, b = F.col("a__k"), F.col("b__k")
    once = (a == b) | ((a != b) & ((a < b) == ((a + b) % 2 == 0)))
    meet = F.array_contains("a_cells", F.col("b_cell")) & F.array_contains("b_cells", F.col("a_cell"))
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1], (F.col("a_label") == F.col("b_label")) & meet & once)
    return pairs.select("a__k", "b__k", *[f"{p}_{c}" for p in "ab" for c in ("cell", *_BLOBS)]).withColumnsRenamed({"a__k": "a_k", "b__k": "b_k"})


def links(
    vectors: DataFrame, own: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
    pivots: int = 4, chunk: int = CHUNK,
) -> DataFrame:
    """Per row: ``key, n_links, component_id, kept`` under cosine >= ``threshold`` within equal labels.

    ``key`` is unique. Equal vectors of one label are one class from here on. ``pivots`` vectors
    (the smallest hashes; a fixed number, whatever the input) cut the unit sphere; a vector lives in
    the cell of its nearest pivot and reaches each cell whose border is within the radius that the
    threshold stands for. Two vectors meet if each reaches the other's cell, chunk against chunk, so
    neither a hot label nor a dense cell is one task, and vectors are stored once whatever they
    reach. In many dimensions most vectors lie near every border: with 24 pivots a vector
    of 64 components went to 15 cells and no fewer pairs were compared than with 4. Null labels, and null, zero, non-finite, empty or ragged vectors, link with
    nothing and come back as rows of their own; vectors of other lengths only meet their own kind.
    Rows that share a key count as copies if they are equal. A null key gets no result.
    """
    base = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    good = base.where(fit).withColumn("dim", F.size("vector"))
    classes = own.keep(good.groupBy("label", "dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    member = own.keep(good.join(classes.select("label", "dim", "vector", F.col("id").alias("head"), "copies"), ["label", "dim", "vector"]).select("id", "head", "copies"))
    radius = float(np.sqrt(2 - 2 * threshold))
    found = None
    dims = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    for dim in dims:
        rows = classes.where(F.col("dim") == dim).select("id", "label", "vector", "copies")
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
        pivot = np.unique(_unit([r["vector"] for r in chosen]), axis=0)
        kind = dict(classes.dtypes)["label"]
        cells = own.keep(rows.mapInArrow(_to_cells(pivot, radius), f"id bigint, label {kind}, copies bigint, cell int, reach binary, vector binary"))
        # Files of chunks: a hot cell's chunks lie in all of them.
        spark = vectors.sparkSession
        least = math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
        files = max(least, -(-cells.count() * (8 * dim + len(pivot) + 64) // TASK))
        placed = in_chunks(cells, ["label", "cell"], "id", chunk, own).withColumn("_file", F.pmod(F.pmod(F.xxhash64("label", "cell"), F.lit(files)) + F.col("_c"), F.lit(files)).cast("int"))
        sorted_ = placed.repartitionById(files, "_file").sortWithinPartitions("label", "cell", "_c")
        chunks = sorted_.mapInArrow(_to_chunks, f"label {kind}, cell int, cells array<int>, id binary, copies binary, reach binary, vector binary")
        chunks = own.keep(chunks.withColumn("_k", F.monotonically_increasing_id()))
        own.discard(cells)
        # A file is read by few rows at a time, as a row is a chunk, and is not put together with others.
        few = {"spark.sql.parquet.columnarReaderBatchSize": 16, "spark.sql.files.maxPartitionBytes": 2 * TASK, "spark.sql.files.openCostInBytes": TASK}
        with set_for(spark, few | {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}):
            got = own.keep(_dealt(chunks).mapInArrow(_compare(threshold, dim), "id bigint, n bigint, to bigint"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return base.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy(F.col("id").alias("head")).agg(F.sum("n").alias("n"))
    group = components(found, own, "id", "to").select(F.col("id").alias("head"), "component")
    alone = base.where(~fit).select("id", F.lit(None).cast("bigint").alias("head"), F.lit(1).cast("bigint").alias("copies"))
    full = member.unionByName(alone).join(counts, "head", "left").join(group, "head", "left")
    component = F.coalesce("component", "head", "id")
    return full.select(
        F.col("id").alias(key),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )

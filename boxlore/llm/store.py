"""Number arrays in a few bytes, for rows that carry many numbers through a shuffle."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from boxlore.llm.texts import U64, mix, ranges, slices


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob, byte planes apart so that high zero bytes vanish."""
    parts = [struct.pack("<B", len(arrays))]
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts.append(struct.pack("<4sq", x.dtype.str[1:].encode(), len(x)))
        parts.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<4sq", raw, at)
        at += 12
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, first value kept."""
    return np.diff(x, prepend=x.dtype.type(0))


@contextmanager
def set_for(spark: SparkSession, names: dict[str, object]):
    """Session settings that hold for jobs run inside."""
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Whole texts go to Python in batches of at most ``rows`` while this holds, for jobs run inside it.

    A batch of ten thousand texts lies in memory outside the heap several times over.
    """
    return set_for(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size})


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pack_texts(parts: int):
    """Whole texts with their ids, packed by group of documents: rows ``docs, blob``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, 3 << 20):
            group = (mix(s.ids.view(U64)) % U64(parts)).astype(np.int64)
            length = np.diff(s.off)
            order = np.argsort(group, kind="stable")
            which, cut = np.unique(group[order], return_index=True)
            blobs = [pack(s.ids[o], length[o], s.buf[ranges(s.off[o], length[o])], level=3) for o in np.split(order, cut[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], names=["docs", "blob"])

    return run

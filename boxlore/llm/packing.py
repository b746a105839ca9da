"""Packing documents into fixed windows: sum-of-squares online placement."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxlore.llm.tokens import encoder
from boxlore.session import Scratch

Piece = tuple[int, int, int, np.ndarray]  # document, start, tokens of the document, ids


class Packer:
    """Open windows by fill level; a piece goes where the sum of squared level counts ends smallest.

    ``count[h]`` is the number of open windows holding h ids. Putting s ids onto a window of level
    h changes the sum by 1 - 2 count[h], and by 1 + 2 count[h+s] unless that fills the window.
    """

    def __init__(self, size: int, most_open: int = 1024):
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.at: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def add(self, piece: Piece) -> list[list[Piece]]:
        """Windows that are finished by this piece, which is no longer than a window."""
        s, n = len(piece[3]), self.size
        if s == n:
            return [[piece]]
        count = self.count
        gain = np.full(n - s + 1, np.iinfo(np.int64).max)
        gain[0] = 1 + 2 * count[s]
        open_ = np.flatnonzero(count[1 : n - s + 1]) + 1
        gain[open_] = 2 - 2 * count[open_] + 2 * count[open_ + s]
        if count[n - s]:
            gain[n - s] = 1 - 2 * count[n - s]
        h = n - s - int(np.argmin(gain[::-1]))
        window = self._take(h) if h else []
        window.append(piece)
        if h + s == n:
            return [window]
        self._put(window, h + s)
        return self.pour(keep=self.most_open // 2) if self.open > self.most_open else []

    def _take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        self.open -= 1
        return self.at[h].pop()

    def _put(self, window: list[Piece], h: int) -> None:
        self.count[h] += 1
        self.open += 1
        self.at.setdefault(h, []).append(window)

    def pour(self, keep: int = 0) -> list[list[Piece]]:
        """Fill windows from the emptiest ones, cutting pieces, until ``keep`` are open; 0: all end."""
        done = []
        while self.open > max(keep, 1):
            levels = np.flatnonzero(self.count)
            low, high = int(levels[0]), int(levels[-1])
            target = self._take(high)
            donor = self._take(low)
            gap, left = self.size - high, low
            while gap and donor:
                doc, start, total, ids = donor.pop()
                move = ids[:gap]
                target.append((doc, start, total, move))
                if len(move) < len(ids):
                    donor.append((doc, start + len(move), total, ids[len(move) :]))
                gap -= len(move)
                left -= len(move)
            if gap:
                self._put(target, self.size - gap)
            else:
                done.append(target)
            if left:
                self._put(donor, left)
        if not keep and self.open:
            done.append(self._take(int(np.flatnonzero(self.count)[0])))
        return done


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, window bigint, offset bigint"


def _pack(tokenizer: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).encode, Packer(size)
        part, window = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def note(done: list[list[Piece]]) -> None:
            nonlocal window
            for pieces in done:
                at = 0
                for doc, start, total, ids in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, part, window, at))
                    at += len(ids)
                window += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 512):
                for doc, ids in zip(keys.slice(at, 512).to_pylist(), encode(texts.slice(at, 512), end), strict=True):
                    for start in range(0, len(ids), size):
                        note(packer.add((doc, start, len(ids), ids[start : start + size])))
            yield out()
            rows.clear()
        note(packer.pour())
        yield out()

    return run


def pack(docs: DataFrame, own: Scratch, tokenizer: str, size: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end`` (null and empty texts: ``end`` alone). Documents longer than
    a window are cut into whole windows and a rest. Tasks pack what they read, so nothing is
    shuffled; at a task's end, or when many windows are open, the emptiest windows are poured
    into the fullest, so a task leaves one window unfilled at most. ``sequence_id`` counts from 0
    without gaps over tasks. Rows that share a key are packed each for itself.
    """
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = own.keep(base.mapInArrow(_pack(tokenizer, size, end), _SCHEMA))
    # One row per task.
    sizes = pieces.groupBy("part").agg((F.max("window") + 1).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return pieces.join(before, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") + F.col("before")).alias("sequence_id"), "offset"
    )

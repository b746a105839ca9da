"""Token ids as compact binary records: an adaptive context-mixing range coder.

A record holds whole documents: their ids, their lengths, and their token stream cut into blocks.
Every block starts from fresh statistics and has its own checksum, so it can be read alone. All
blocks of a record are coded side by side, one NumPy lane each.

Three predictions are mixed: the id that last followed the two ids before (order 2), the one that
last followed the id before (order 1), and the size class of ids (order 0). How far the first two
have been right lately picks the statistics, which then say how likely each prediction is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxlore.llm.store import gaps, pack, unpack
from boxlore.llm.tokens import encoder
from boxlore.session import Scratch

MAGIC = b"TIDS\x02"
BLOCK = 2048  # ids in a block
RECORD = 3 << 20  # ids in a record, unless one document has more
LANES = 2048  # blocks that are coded side by side
_TABLE, _HASH, _LOW = 1 << 9, np.uint32(0x9E3779B1), np.uint32(23)
_TURN = (np.arange(_TABLE) * 197 + 91) % _TABLE  # the hash of an id as the second before
_SCALE = 9  # bits of the shares of a statistics row
_SETTLE = frozenset(1 << k for k in range(4, 11))  # places in a block at which shares change
_WORD, _TOP = 24, 28  # bits of a code word, and of the least span; spans have at most 52
_REST = (1 << _TOP) - 1
_RIGHT = np.array([2, 2, 4, 4, 4, 4, 4, 4], np.int32)


class _Model:
    """Statistics of all lanes, the same for writing and reading.

    A table's cell holds the id that last followed its context, and in its low three bits how often
    it was right: 0, 2 or 4 in order 2, 0 or 1 in order 1. Together they choose one of six rows.
    """

    def __init__(self, lanes: int, bits: int):
        self.symbols = 2 * bits + 4
        self.width = self.symbols + 1
        self.at, self.row = np.arange(lanes) * _TABLE, np.arange(lanes) * 6
        self.two, self.one = np.zeros(lanes * _TABLE, np.int32), np.zeros(lanes * _TABLE, np.int32)
        self.seen = np.ones((lanes * 6, self.width), np.int32)
        self.seen[:, :2] = 4
        self.seen[:, -1] = 0
        self.cut = np.zeros((lanes * 6, self.width), np.int64)
        self.flat, self.notes = self.cut.reshape(-1), []
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # hashes of the two ids before
        self.settle()

    def settle(self) -> None:
        """Cumulative shares out of what was seen so far; shares change only here."""
        rows = len(self.row) * 6
        size = rows * self.width
        for at in range(0, len(self.notes), 128):
            self.seen[:rows] += 12 * np.bincount(np.concatenate(self.notes[at : at + 128]), minlength=size)[:size].reshape(rows, -1).astype(np.int32)
        self.notes.clear()
        total = np.cumsum(self.seen[:rows, :-1], axis=1, dtype=np.int32)
        scale = ((1 << _SCALE) - self.symbols) / total[:, -1:].astype(np.float64)
        self.cut[:rows, 1:] = (total * scale + 1e-9).astype(np.int64) + np.arange(1, self.width)

    def symbol_of(self) -> np.ndarray:
        """The symbol of every share of every row."""
        rows = len(self.row) * 6
        return np.repeat(np.tile(np.arange(self.symbols, dtype=np.uint8), rows), np.diff(self.cut[:rows], axis=1).reshape(-1))

    def narrow(self) -> None:
        """The last lane has ended."""
        self.at, self.row, self.last, self.before = self.at[:-1], self.row[:-1], self.last[:-1], self.before[:-1]

    def predict(self) -> None:
        self.k1, self.k2 = self.at + self.last, self.at + (self.last ^ self.before)
        two, one = self.two.take(self.k2), self.one.take(self.k1)
        self.p2, self.p1 = two >> 3, one >> 3
        self.right = (two | one) & 7
        self.at_row = self.row + self.right
        self.base = self.at_row * self.width

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, spot: np.ndarray) -> None:
        self.notes.append(spot)
        held = ids << 3
        self.two[self.k2] = held + hit2 * _RIGHT.take(self.right)
        self.one[self.k1] = held + hit1
        self.before = _TURN.take(self.last)
        self.last = ((ids.view(np.uint32) * _HASH) >> _LOW).astype(np.int64)


def _classes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size class of ids (two per octave of id + 1), and the bits and value that tell it from its class mates."""
    v = v.astype(np.int64) + 1
    e = np.frexp(v.astype(float))[1] - 1
    bits = np.maximum(e - 1, 0)
    half = np.where(e > 0, (v >> bits) & 1, 0)
    return np.where(e > 0, 2 * e - 1 + half, 0), bits, v & ((1 << bits) - 1)


def _first_of(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a class and its first id + 1."""
    e = (cls + 1) // 2
    bits = np.maximum(e - 1, 0)
    return bits, np.where(cls > 0, (1 << e) + (((cls + 1) & 1) << bits), 1)


def _lengths(tokens: int) -> tuple[np.ndarray, int]:
    lanes = -(-tokens // BLOCK)
    return np.minimum(BLOCK, tokens - np.arange(lanes) * BLOCK), lanes


def _symbols(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and first id of each symbol's class; the first two symbols are predictions."""
    extra, first = _first_of(np.maximum(np.arange(2 * bits + 4) - 2, 0))
    extra[:2] = 0
    return extra, first - 1


def _rounds(bits: int) -> int:
    """Words by which a span may have to grow after an id."""
    if bits > 20:
        raise ValueError("ids of more than 20 bits are too large for the coder")
    return 1 if _TOP - _SCALE - (bits - 2) + _WORD >= _TOP else 2


def encode(ids: np.ndarray, bits: int) -> list[bytes]:
    """Code words of each block of ``ids``, which are below 2**bits - 1."""
    step = LANES * BLOCK
    return [block for at in range(0, len(ids), step) for block in _encode(ids[at : at + step], bits)]


def _encode(ids: np.ndarray, bits: int) -> list[bytes]:
    length, lanes = _lengths(len(ids))
    grid = np.zeros((lanes, BLOCK), np.int32)
    grid.reshape(-1)[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    cls, _, value = _classes(np.arange(int(ids.max()) + 1))
    cls += 2
    extra, _ = _symbols(bits)
    model, rounds = _Model(lanes, bits), _rounds(bits)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << (_WORD + _TOP))
    width = rounds * BLOCK + 4
    out = np.zeros(lanes * width, np.uint32)
    end = np.arange(lanes) * width
    n = lanes
    for t in range(int(length[0])):
        if t == length[-1]:
            n -= 1
            low, span, rest = low[:n], span[:n], low
            model.narrow()
        if t in _SETTLE:
            model.settle()
        x = grid[t, :n]
        model.predict()
        hit2, hit1 = x == model.p2, x == model.p1
        symbol = cls.take(x)
        np.putmask(symbol, hit1, 1)
        np.putmask(symbol, hit2, 0)
        spot = model.base + symbol
        start = model.flat.take(spot)
        r = span >> _SCALE
        low += r * start
        r *= model.flat.take(spot + 1) - start
        r >>= extra.take(symbol)
        low += r * (value.take(x) * (symbol > 1))
        for _ in range(rounds):  # a word may have one bit more: a carry, which is passed on at the end
            go = (r < 1 << _TOP).nonzero()[0]
            l, to = low.take(go), end.take(go)
            out[to] = l >> _TOP
            end[go] = to + 1
            low[go] = (l & _REST) << _WORD
            r[go] <<= _WORD
        span = r
        model.update(x, hit2, hit1, spot)
    low = low if n == lanes else rest
    for _ in range(3):
        out[end] = low >> _TOP
        low = (low & _REST) << _WORD
        end += 1
    while len(over := np.flatnonzero(out >> _WORD)):
        out[over - 1] += out[over] >> _WORD
        out[over] &= (1 << _WORD) - 1
    raw = out.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    return [raw[i * width : stop, :3].tobytes() for i, stop in enumerate(end.tolist())]


def decode(blocks: list[bytes], tokens: int, bits: int) -> np.ndarray:
    """The ids that :func:`encode` got."""
    parts = [_decode(blocks[at : at + LANES], min(tokens - at * BLOCK, LANES * BLOCK), bits) for at in range(0, len(blocks), LANES)]
    return np.concatenate([np.zeros(0, "<u4"), *parts])


def _decode(blocks: list[bytes], tokens: int, bits: int) -> np.ndarray:
    length, lanes = _lengths(tokens)
    size = np.array([len(b) // 3 for b in blocks])
    width = int(size.max()) + 4
    raw = np.zeros((lanes, width, 4), np.uint8)
    for i, b in enumerate(blocks):
        raw[i, : size[i], :3] = np.frombuffer(b, np.uint8).reshape(-1, 3)
    words = raw.view("<u4").reshape(-1)
    # A code has 52 bits, so what follows it begins inside a word.
    tail, part = _TOP % _WORD, _WORD - _TOP % _WORD
    at = np.arange(lanes) * width
    code = (words[at].astype(np.int64) << _TOP) | (words[at + 1].astype(np.int64) << tail) | (words[at + 2] >> part)
    words[:-1] = ((words[:-1] << tail) & ((1 << _WORD) - 1)) | (words[1:] >> part)
    at += 2
    grid = np.zeros((BLOCK, lanes), np.int32)
    extra, first = _symbols(bits)
    model, rounds = _Model(lanes, bits), _rounds(bits)
    span = np.full(lanes, 1 << (_WORD + _TOP))
    table, n = model.symbol_of(), lanes
    for t in range(int(length[0])):
        if t == length[-1]:
            n -= 1
            code, span = code[:n], span[:n]
            model.narrow()
        if t in _SETTLE:
            model.settle()
            table = model.symbol_of()
        model.predict()
        r = span >> _SCALE
        symbol = table.take((model.at_row << _SCALE) + code // r).astype(np.int64)
        spot = model.base + symbol
        start = model.flat.take(spot)
        code -= r * start
        r *= model.flat.take(spot + 1) - start
        r >>= extra.take(symbol)
        value = code // r
        code -= r * value
        x = (first.take(symbol) + value).astype(np.int32)
        hit2 = symbol == 0
        np.putmask(x, symbol == 1, model.p1)
        np.putmask(x, hit2, model.p2)
        grid[t, :n] = x
        for _ in range(rounds):
            go = (r < 1 << _TOP).nonzero()[0]
            to = at.take(go)
            code[go] = (code.take(go) << _WORD) | words.take(to, mode="clip")
            at[go] = to + 1
            r[go] <<= _WORD
        span = r
        model.update(x, hit2, x == model.p1, spot)
    return grid.T.reshape(-1)[:tokens].astype("<u4")


def write_record(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One record: header, directory of documents and blocks, code words."""
    blocks = encode(ids, bits)
    directory = pack(gaps(docs.astype(np.int64)), lengths.astype(np.uint32), np.array([len(b) for b in blocks], np.uint32), np.array([zlib.crc32(b) for b in blocks], np.uint32))
    return struct.pack("<5sBIQ", MAGIC, bits, len(directory), len(ids)) + directory + b"".join(blocks)


def read_record(record: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their lengths and all ids; a record that was damaged raises."""
    head = struct.calcsize("<5sBIQ")
    magic, bits, size, tokens = struct.unpack_from("<5sBIQ", record)
    if magic != MAGIC:
        raise ValueError("not a token record")
    docs, lengths, sizes, sums = unpack(record[head : head + size])
    at, blocks = head + size, []
    for n, crc in zip(sizes.tolist(), sums.tolist(), strict=True):
        block = record[at : at + n]
        if len(block) != n or zlib.crc32(block) != crc:
            raise ValueError(f"damaged block {len(blocks)} of a token record")
        blocks.append(block)
        at += n
    return np.cumsum(docs), lengths, decode(blocks, tokens, bits)


def _write(tokenizer: str, end: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def record() -> pa.RecordBatch:
            nonlocal number, before, held
            flat = np.concatenate(ids)
            blob = write_record(np.array(docs), np.array([len(i) for i in ids]), flat, bits)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "number", "before", "tokens", "record"])
            number, before, held = number + 1, before + len(flat), 0
            docs.clear()
            ids.clear()
            return row

        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 512):
                for doc, one in zip(keys.slice(at, 512).to_pylist(), encode(texts.slice(at, 512), end), strict=True):
                    if held and held + len(one) > RECORD:
                        yield record()
                    docs.append(doc)
                    ids.append(one)
                    held += len(one)
        if docs:
            yield record()

    return run


def write(docs: DataFrame, own: Scratch, tokenizer: str, end: int = 2, bits: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The token file of ``docs``: a table of records in ascending key order, stored and read again.

    Columns ``part, number`` give the order, ``before`` the ids of the part in front of a record,
    ``tokens`` its ids, ``record`` its bytes. Null texts are empty and have ``end`` alone; rows with
    a null key are left out; rows that share a key stand side by side.
    """
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return own.keep(ordered.mapInArrow(_write(tokenizer, end, bits), "part int, number int, before bigint, tokens bigint, record binary"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, blob in zip(batch.column("part"), batch.column("before").to_pylist(), batch.column("record"), strict=True):
            docs, lengths, ids = read_record(blob.as_py())
            raw, stop = ids.tobytes(), np.cumsum(lengths.astype(np.int64))
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stop - lengths, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), part.as_py(), np.int32)), pa.array(docs), pa.array(before + stop - lengths), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def digest(file: DataFrame) -> DataFrame:
    """What a token file holds, decoded: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    sizes = file.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per task that wrote
    offset = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = file.select("part", "before", "record").mapInArrow(_read, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(offset, "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

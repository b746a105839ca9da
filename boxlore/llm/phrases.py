"""Phrase collocations by SON partitioning: mine shards, unite what they find, count that exactly.

Documents fall into a fixed number of shards by their key. A phrase that stands ``support`` times
in all of them stands ``support / shards`` times in one at least, so every shard is mined
completely at that lower support: hashes of its phrases, counted in slices, meet by shard and
range of hashes. The union of what is frequent in any shard goes into a Bloom filter of bounded
size, one segment per range. The second pass counts, with their words, only phrases the filter
lets through. Hashes decide nothing but what is counted: a chance hit is counted as well and falls
below the support by its exact count. (Inside one task equal phrases are told by 128 bits.)

Definitions. A-Z are lower-cased. Texts (null: empty) are cut into pieces at ``. , ; : ! ?`` and
the bytes 0A-0D, pieces into words at blanks and tabs; a phrase lies within one piece and is
written with single blanks. Languages are apart, null is ``und``. Null and repeated keys are rows
like any other. A table without words has no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlore.llm.store import gaps, pack, small_batches, unpack
from boxlore.llm.texts import _BASE2, U64, Slice, mix, prefix, ranges, slices, span_hash
from boxlore.session import Scratch

SHARDS = 10
UNIT = 2 << 20  # bytes of text whose phrases one group of the first pass holds, about
HELD = 1_000_000  # hashes a task of the first pass holds before it counts and sends them
DISTINCT = 500_000  # phrases a task of the second pass holds
FILTER_BITS = 1 << 28
PROBES = 4
_LOW60 = U64((1 << 60) - 1)
_CUTS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)


class _Words:
    """The words of a slice: where they are, their pieces, and their hashes."""

    def __init__(self, part: Slice):
        self.low = low = part.lower()
        cut = np.isin(low, _CUTS)
        solid = ~(cut | (low == 32) | (low == 9))
        first = np.zeros(len(low) + 1, bool)
        first[part.off] = True
        before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | first[:-1]))
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.doc = np.searchsorted(part.off, self.start, side="right") - 1
        self.piece = np.cumsum(cut)[self.start] + self.doc
        self.hash = mix(span_hash(prefix(low), self.start, self.end))
        self._other: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def phrases(self, lang: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the first words of all its phrases, and the phrases' hashes."""
        h = mix(self.hash ^ lang)
        yield 1, np.arange(len(h)), h
        for n in range(2, longest + 1):
            if len(self) < n:
                return
            h = mix(h[:-1] + self.hash[n - 1 :] * U64((0xD6E8FEB86659FD93 * (2 * n + 1) | 1) & (2**64 - 1)), n)
            at = np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self) - n + 1])
            yield n, at, h[at]

    def second(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of some phrases that have nothing in common with the first ones."""
        if self._other is None:
            self._other = mix(span_hash(prefix(self.low, _BASE2), self.start, self.end, _BASE2), 77)
        word = self._other
        h = word[at]
        for k in range(1, n):
            h = mix(h * U64(0x9FB21C651E98DF25) + word[at + k], 100 + k)
        return h

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one blank behind each, and where each word starts in that."""
        length = self.end - self.start
        start = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(int(start[-1]), 32, np.uint8)
        out[ranges(start[:-1], length)] = self.low[ranges(self.start, length)]
        return out, start


def _lang_hash(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of slices; of each word its language's hash, language's number in the batch, shard."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names = lang.dictionary.to_pylist()
        number = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.array([_lang_hash(x) for x in names], U64)
        at = 0
        for s in slices([batch], 1 << 19, key="shard"):
            words = _Words(s)
            if len(words):
                doc = number[at : at + len(s)][words.doc]
                yield words, hashes[doc], np.array(names, object)[doc], s.ids[words.doc]
            at += len(s)


def _part(h60: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal size of 60-bit hashes."""
    return ((h60 >> U64(30)) * U64(parts) >> U64(30)).astype(np.int64)


def _hashes(parts: int, longest: int, most: int):
    """First pass: rows ``unit, blob`` of counted hashes, a unit being a range of a shard's hashes."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count, key = np.diff(first, append=len(every)), every[first]
        low = key & _LOW60
        unit = (key >> U64(60)).astype(np.int64) * parts + _part(low, parts)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
        blobs = [pack(gaps(low[a:b]), count[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(unit[cut[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["unit", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for words, lang, _, shard in _read(batches):
            for _, at, h in words.phrases(lang, longest):
                held.append((shard[at].astype(U64) << U64(60)) | (h >> U64(4)))
            if sum(map(len, held)) > most:
                yield flush(held)
        if held:
            yield flush(held)

    return run


def _summed(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blobs in order, and the sums of their counts."""
    both = [unpack(b) for b in blobs]
    h = np.concatenate([np.cumsum(g, dtype=U64) for g, _ in both])
    count = np.concatenate([c for _, c in both])
    order = np.argsort(h)
    h, count = h[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(count, first)


def _mine(parts: int, local: int):
    """A unit's hashes with at least the local support: rows ``part, n, blob``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, count = _summed(table.column("blob").to_pylist())
        h = h[count >= local]
        rows = [] if not len(h) else [{"part": key[0].as_py() % parts, "n": len(h), "blob": pack(gaps(h))}]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())]))

    return run


def _probe(h60: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix(h60, k + 1) & U64(bits - 1)


def _unite(bits: int):
    """The filter's segment for the candidates of a range in any shard: rows ``part, segment``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = np.unique(np.concatenate([np.cumsum(unpack(b)[0], dtype=U64) for b in table.column("blob").to_pylist()]))
        on = np.zeros(bits, bool)
        for k in range(PROBES):
            on[_probe(h, k, bits)] = True
        return pa.Table.from_pylist([{"part": key[0].as_py(), "segment": np.packbits(on, bitorder="little").tobytes()}], pa.schema([("part", pa.int64()), ("segment", pa.binary())]))

    return run


def _candidates(local: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """The Bloom filter of all candidates, a row per range, and its bits per row.

    It has 16 bits a candidate or :data:`FILTER_BITS` in all, whichever is less; fuller, it lets
    more phrases through to be counted and dropped.
    """
    most = local.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = 1 << max(10, min((16 * most - 1).bit_length() if most else 0, (FILTER_BITS // parts).bit_length() - 1))
    found = np.zeros((parts, bits // 8), np.uint8)
    segments = local.groupBy("part").applyInArrow(_unite(bits), "part bigint, segment binary")
    for row in segments.toLocalIterator():  # FILTER_BITS in all
        found[row["part"]] = np.frombuffer(row["segment"], np.uint8)
    return found, bits


class _Tally:
    """Counts of phrases with their spelling, merged by sorting."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, lang, length, one, two, count, size, raw) -> None:
        self.parts.append((lang, length, one, two, count, size, raw))
        self.n += len(one)

    def merge(self) -> None:
        if not self.parts:
            return
        lang, length, one, two, count, size, raw = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        first, total, order = _groups(one, two, count)
        start = np.cumsum(size) - size
        pick = order[first]
        self.parts, self.n = [], 0
        self.add(lang[pick], length[pick], one[pick], two[pick], total, size[pick], raw[ranges(start[pick], size[pick])])

    def batch(self) -> pa.RecordBatch:
        self.merge()
        lang, length, _, _, count, size, raw = self.parts[0]
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), text, pa.array(length, pa.int32()), pa.array(count, pa.int64())], names=["lang", "phrase", "k", "f"])


def _groups(one: np.ndarray, two: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of hashes: where each group begins in ``order``, and its sum."""
    order = np.argsort(one)
    same = one[order[1:]] == one[order[:-1]]
    if (two[order[1:]][same] != two[order[:-1]][same]).any():
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return first, np.add.reduceat(count[order], first), order


def _counts(sent, parts: int, bits: int, longest: int, most: int):
    """Second pass: rows ``lang, phrase, k, f`` of what the filter lets through; ``k`` 0: all words."""

    def passes(h: np.ndarray, found: np.ndarray) -> np.ndarray:
        h = h >> U64(4)
        row = _part(h, parts)
        at = np.arange(len(h))
        for k in range(PROBES):
            bit = _probe(h[at], k, bits).astype(np.int64)
            at = at[(found[row[at], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tally, totals = sent.value, _Tally(), {}
        for words, lang, name, _ in _read(batches):
            raw, start = words.spelled()
            for x in np.unique(lang):
                mine = np.flatnonzero(lang == x)
                totals[name[mine[0]]] = totals.get(name[mine[0]], 0) + len(mine)
            for n, at, h in words.phrases(lang, longest):
                good = passes(h, found)
                if not len(good):
                    continue
                at, h = at[good], h[good]
                two = words.second(at, n)
                first, total, order = _groups(h, two, np.ones(len(h), np.int64))
                pick = order[first]
                size = start[at[pick] + n] - 1 - start[at[pick]]
                tally.add(name[at[pick]], np.full(len(pick), n, np.int32), h[pick], two[pick], total, size, raw[ranges(start[at[pick]], size)])
            if tally.n > most:
                tally.merge()
                if tally.n > most // 2:
                    yield tally.batch()
        if tally.n:
            yield tally.batch()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([""] * len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "k", "f"])

    return run


def frequent(docs: DataFrame, own: Scratch, support: int = 30, longest: int = 4, shards: int = SHARDS, unit: int = UNIT, held: int = HELD, distinct: int = DISTINCT, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, k, f``: exact counts of all phrases of up to ``longest`` words that stand ``support`` times.

    A row with ``k`` 0 and an empty phrase has the number of words of the language.
    """
    if not 1 <= shards <= 16:
        raise ValueError("shards must be 1 to 16")
    spark = docs.sparkSession
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // (shards * unit)))
    local = max(1, -(-support // shards))
    units = rows.mapInArrow(_hashes(parts, longest, held), "unit bigint, blob binary").groupBy("unit")
    with small_batches(spark):
        mined = own.keep(units.applyInArrow(_mine(parts, local), "part bigint, n bigint, blob binary"))
    found, bits = _candidates(mined, parts)
    sent = spark.sparkContext.broadcast(found)
    counted = rows.mapInArrow(_counts(sent, parts, bits, longest, distinct), "lang string, phrase string, k int, f bigint")
    with small_batches(spark):
        return own.keep(counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= support)))


def rank(found: DataFrame, top: int = 2000, cover: int = 80) -> DataFrame:
    """The collocations among frequent phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is scored by its weakest cut (ties: the earliest), 2,000,000 a / (l + r) rounded
    down. Phrases inside a longer one with ``cover`` percent of their count go. Ties of score go by
    count, then by phrase.
    """
    words = F.split("phrase", " ")
    longer = found.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    part = found.where("k >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inside = longer.where("k >= 3").select(
        "lang", "a",
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"outer IS NULL OR CAST(outer AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {int(cover)}"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, own: Scratch, support: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, **how) -> DataFrame:
    """:func:`rank` of the :func:`frequent` phrases of whole texts."""
    return rank(frequent(docs, own, support, longest, **how), top, cover)

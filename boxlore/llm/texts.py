"""Whole texts as flat byte buffers: slices of Arrow batches, words, shingles, hashes.

Everything is NumPy over one buffer per slice; there is no loop over words or characters.
Hashes are polynomial prefix sums modulo 2**64, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class _Kept(dict):
    """A cache that stays where it was filled: it is sent to tasks empty."""

    def __reduce__(self):
        return _Kept, ()


_POWERS = _Kept()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next slice."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base & (2**64 - 1), U64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bit mixer for 64-bit numbers."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Slice:
    """Some documents: ids, one byte buffer, and where each text starts in it."""

    ids: np.ndarray
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def lower(self) -> np.ndarray:
        """The buffer with A-Z as a-z; other bytes are left alone."""
        upper = (self.buf >= 65) & (self.buf <= 90)
        return self.buf + (upper.astype(np.uint8) << 5)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    buf = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(batches: Iterable[pa.RecordBatch], size: int = 1 << 21, key: str = "doc_id", text: str = "text") -> Iterator[Slice]:
    """Cut record batches into slices of about ``size`` bytes; a longer text is a slice alone. Null is empty."""
    for batch in batches:
        ids = batch.column(key).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, off = _binary(batch.column(text))
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            end = min(max(end, at + 1), len(ids))
            yield Slice(ids[at:end], buf[off[at] : off[end]], off[at : end + 1] - off[at])
            at = end


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def prefix(buf: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    rest = out[1:]
    np.add(buf, U64(1), out=rest, dtype=U64, casting="unsafe")
    rest *= powers(base, len(buf))[: len(buf)]
    np.cumsum(rest, out=rest)
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of spans, whatever their place in the buffer (not mixed)."""
    inverse = pow(base, -1, 2**64)
    return (pre[end] - pre[start]) * powers(inverse, len(pre))[start]


def window_hash(pre: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """:func:`span_hash` of all spans of ``size`` bytes, without index arrays."""
    out = pre[size:] - pre[: len(pre) - size]
    out *= powers(pow(base, -1, 2**64), len(pre))[: len(out)]
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: runs of bytes other than blank and 0x09-0x0D."""
    solid = (buf != 32) & ((buf < 9) | (buf > 13))
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True  # a text's first byte never continues a word
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingle_sets(part: Slice, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of lower-cased texts, sorted by text: (text number, hash).

    A text of fewer words has its whole word sequence as the only shingle; one without words has none.
    """
    low = part.lower()
    start, end, doc = words(low, part.off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = mix(span_hash(prefix(low), start, end))
    count = np.bincount(doc, minlength=len(part))
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(count, count) - place
    head = np.flatnonzero((left >= n) | (place == 0))
    width = np.minimum(left[head], n)
    total = np.zeros(len(head), U64)
    for k in range(n):
        here = width > k
        total[here] += word[head[here] + k] * U64((0xD6E8FEB86659FD93 * (2 * k + 1) ** 7 | 1) & (2**64 - 1))
        total = mix(total, k + 1)
    total = mix(total + width.astype(U64))
    order = np.lexsort((total, doc[head]))
    d, h = doc[head][order], total[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[fresh], h[fresh]

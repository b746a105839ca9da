"""Quality classifier: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.llm.labelled import sample
from boxlore.llm.store import small_batches
from boxlore.llm.texts import _BASE, U64, Slice, mix, prefix, slices, span_hash, words
from boxlore.llm.toxicity import _from_texts
from boxlore.session import Scratch

TERMS = 2048  # hashed terms: shapes of three bytes
STATS = 40  # terms for what a text repeats, and how long its words and lines are
RANK = 40
NEIGHBOURS = 25
STRETCH, ROWS = 1 << 18, 512  # bytes of text, and texts, that are worked on at a time

# Bytes as shapes: capital, small, digit, beyond ASCII, and every other byte as itself.
_SHAPE = np.arange(256)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 128
_SHAPE = np.unique(_SHAPE, return_inverse=True)[1].astype(np.uint32)


def _spans(mark: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes within texts: start, end, text number."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(mark & (edge[:-1] | ~np.r_[False, mark[:-1]]))
    end = np.flatnonzero(mark & (edge[1:] | ~np.r_[mark[1:], False])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _share_repeated(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, the share of its items that it has had before."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[again], minlength=n) / np.maximum(total, 1)


def _texts(part: Slice, at: int, to: int) -> Slice:
    """Some texts of a slice, without a copy."""
    off = part.off[at : to + 1]
    return Slice(part.ids[at:to], part.buf[off[0] : off[-1]], off - off[0])


def _three(buf: np.ndarray) -> np.ndarray:
    """Buckets of the shapes of three bytes that start at each byte but the last two."""
    s = _SHAPE[buf]
    three = s[:-2] * np.uint32(1 << 12) + s[1:-1] * np.uint32(1 << 6) + s[2:]
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)


def _steps(out: np.ndarray, count: np.ndarray, lines: np.ndarray, size: np.ndarray, same: np.ndarray, single: np.ndarray, repeated: list[np.ndarray]) -> None:
    """Terms of what texts repeat and how long their parts are, from counts of whole texts.

    count, lines: words and lines; size: bytes of all words; same: words like the one before;
    single: words of one byte; repeated: shares of words, word pairs and lines had before.
    """
    once = np.maximum(count, 1)
    values = [
        same / once,
        *repeated,
        np.minimum(size / once / 16, 1),
        np.minimum(np.log2(count + 1) / 16, 1),
        np.minimum(count / np.maximum(lines, 1) / 128, 1),
        np.minimum(single / once, 1),
    ]
    # Each statistic is a few terms on a scale: soft steps that neighbours share.
    for i, v in enumerate(values):
        for k in range(5):
            out[:, TERMS + 5 * i + k] = np.maximum(1 - np.abs(v * 4 - k), 0)


def _terms_of_some(part: Slice, out: np.ndarray) -> None:
    """Terms of texts of few bytes in all."""
    n = len(part)
    if len(part.buf) > 2:
        doc = np.repeat(np.arange(n), np.diff(part.off))
        inside = doc[:-2] == doc[2:]
        out[:, :TERMS] = np.bincount(doc[:-2][inside] * TERMS + _three(part.buf)[inside], minlength=n * TERMS).reshape(n, TERMS)
    start, end, wd = words(part.buf, part.off)
    pre = prefix(part.buf)
    key = mix(span_hash(pre, start, end))
    same_next = np.zeros(len(key), bool)
    same_next[1:] = (key[1:] == key[:-1]) & (wd[1:] == wd[:-1])
    pair = mix(key[:-1], 3) + key[1:]
    together = wd[:-1] == wd[1:]
    ls, le, ld = _spans(part.buf != 10, part.off)
    repeated = [
        _share_repeated(key, wd, n),
        _share_repeated(pair[together], wd[:-1][together], n) if len(key) else np.zeros(n),
        _share_repeated(mix(span_hash(pre, ls, le)), ld, n),
    ]
    size, single = np.bincount(wd, end - start, minlength=n), np.bincount(wd, (end - start == 1) * 1.0, minlength=n)
    _steps(out, np.bincount(wd, minlength=n), np.bincount(ld, minlength=n), size, np.bincount(wd[same_next], minlength=n), single, repeated)


class _Open:
    """Runs of a text that comes in stretches; a run that reaches a stretch's end waits for the next."""

    def __init__(self):
        self.hash, self.size = np.zeros(1, U64), 0

    def add(self, hashed: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash (not mixed) and size of the runs that end here, in order."""
        size = end - start
        if self.size:
            if len(start) and start[0] == 0:
                hashed[:1] = self.hash + hashed[:1] * U64(pow(_BASE, self.size, 2**64))
                size[0] += self.size
            else:
                hashed, size, end = np.r_[self.hash, hashed], np.r_[self.size, size], np.r_[0, end]
            self.size = 0
        if not last and len(end) and end[-1] == length:
            self.hash, self.size = hashed[-1:], int(size[-1])
            hashed, size = hashed[:-1], size[:-1]
        return hashed, size


class _Distinct:
    """Number of items, and the distinct ones in sorted pieces that are merged as they grow."""

    def __init__(self):
        self.total, self.pieces = 0, []

    def add(self, key: np.ndarray) -> None:
        self.total += len(key)
        piece = np.unique(key)
        while self.pieces and len(self.pieces[-1]) <= 2 * len(piece):
            piece = np.unique(np.concatenate([self.pieces.pop(), piece]))
        self.pieces.append(piece)

    def share_repeated(self) -> np.ndarray:
        distinct = len(np.unique(np.concatenate(self.pieces)))
        return np.array([(self.total - distinct) / max(self.total, 1)])


def _terms_of_long(buf: np.ndarray, out: np.ndarray) -> None:
    """Terms of one text, read a stretch at a time; of the whole, only its distinct hashes are held."""
    shapes = np.zeros(TERMS, np.int64)
    word, line = _Open(), _Open()
    keys, pairs, rows = _Distinct(), _Distinct(), _Distinct()
    size = same = single = 0
    before = np.zeros(0, U64)
    for at in range(0, len(buf), STRETCH):
        here, last = buf[at : at + STRETCH], at + STRETCH >= len(buf)
        if len(buf) - at > 2:
            shapes += np.bincount(_three(buf[at : at + STRETCH + 2]), minlength=TERMS)
        pre, off = prefix(here), np.array([0, len(here)])
        start, end, _ = words(here, off)
        hashed, length = word.add(span_hash(pre, start, end), start, end, len(here), last)
        key = mix(hashed)
        size, single = size + int(length.sum()), single + int((length == 1).sum())
        keys.add(key)
        key = np.concatenate([before, key])
        same += int((key[1:] == key[:-1]).sum())
        pairs.add(mix(key[:-1], 3) + key[1:])
        before = key[-1:]
        start, end, _ = _spans(here != 10, off)
        rows.add(mix(line.add(span_hash(pre, start, end), start, end, len(here), last)[0]))
    out[0, :TERMS] = shapes
    number = lambda x: np.array([x])
    _steps(out, number(keys.total), number(rows.total), number(size), number(same), number(single), [x.share_repeated() for x in (keys, pairs, rows)])


def terms(part: Slice) -> np.ndarray:
    """Counts of terms, one row per text. Beside them, memory is held for a stretch of bytes only."""
    n = len(part)
    out = np.zeros((n, TERMS + STATS), np.float32)
    at = 0 if len(part.buf) else n
    while at < n:
        to = max(int(np.searchsorted(part.off, part.off[at] + STRETCH, side="right")) - 1, at + 1)
        some = _texts(part, at, to)
        if len(some.buf) > STRETCH:
            _terms_of_long(some.buf, out[at:to])
        else:
            _terms_of_some(some, out[at:to])
        at = to
    return out


@dataclass
class Model:
    weight: np.ndarray  # per term
    axes: np.ndarray
    points: np.ndarray
    label: np.ndarray
    vote: np.ndarray
    prior: float


def _weigh(count: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = count.copy()
    np.log1p(out[:, :TERMS], out=out[:, :TERMS])
    out *= weight
    for part in (slice(0, TERMS), slice(TERMS, None)):
        size = np.sqrt((out[:, part] ** 2).sum(1, keepdims=True))
        out[:, part] /= np.maximum(size, 1e-12)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _rows(texts: list[str]) -> np.ndarray:
    return np.concatenate([terms(_from_texts(texts[at : at + 256])) for at in range(0, len(texts), 256)]) if texts else np.zeros((0, TERMS + STATS), np.float32)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Latent-semantic axes of the sample (leading eigenvectors of its term products) and its vectors."""
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    count = _rows(texts)
    seen = (count > 0).sum(0)
    idf = np.log((1 + len(texts)) / (1 + seen)).astype(np.float32) + 0.1
    x = _weigh(count, idf)
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :RANK].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), y.astype(np.float32), weight.astype(np.float32), prior)


def vote(model: Model, count: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity and label shares."""
    if not len(model.label):
        return np.full(len(count), model.prior)
    out = np.empty(len(count))
    k = min(NEIGHBOURS, len(model.label))
    for at in range(0, len(count), ROWS):
        cos = _unit(_weigh(count[at : at + ROWS], model.weight) @ model.axes) @ model.points.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        c = np.take_along_axis(cos, near, 1)
        w = np.maximum(c, 0) ** 8 * model.vote[near] + 1e-9
        out[at : at + ROWS] = ((w * model.label[near]).sum(1) + 0.5 * model.prior * w.mean(1)) / (w.sum(1) + 0.5 * w.mean(1))
    return out


_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _score(model: Model, modulus: int, held_out: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            score = np.clip(np.concatenate([vote(model, terms(_texts(part, at, at + ROWS))) for at in range(0, len(part), ROWS)]), 0, 1)
            score[np.diff(part.off) == 0] = min(model.prior, threshold / 2)
            rest = np.array([zlib.crc32(str(i).encode()) % modulus == held_out for i in part.ids.tolist()], bool)
            yield pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(rest), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5, modulus: int = 3, held_out: int = 1, key: str = "doc_id", text: str = "text", label: str = "quality", own: Scratch | None = None) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    The neighbours are at most ``per_class`` documents of each label whose crc32(id) mod ``modulus``
    is not ``held_out`` (a documented bound; texts over 64 KiB are not learnt from). Their vectors
    (at most 2 * per_class rows of 40 numbers, under 1 MB) go to every task, which computes all
    cosines of all its documents in blocks. Null and empty texts get the label's share, but not
    more than half the threshold. Rows that share a key are scored each; a null key gets no result.
    With ``own``, scores are stored at once, and texts go to Python in small batches for it.
    """
    model = fit(*sample(docs, labels, label, modulus, held_out, per_class, key, text))
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    scored = base.mapInArrow(_score(model, modulus, held_out, threshold), _SCHEMA)
    if own is None:
        return scored
    with small_batches(own.spark):
        return own.keep(scored)

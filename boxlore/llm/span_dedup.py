"""Repeated 50-byte strings across documents by prefix-free parsing.

Rolling-hash triggers cut every text into phrases. The trigger of a 50-byte string is the
smallest gram hash inside it, so it depends on nothing but the string. A phrase is a longest run
of string starts that share one trigger, plus the 49 bytes that complete its last string:
neighbouring phrases overlap, every string start lies in exactly one phrase, and equal strings
always lie in phrases of the same trigger. The dictionary (distinct phrases, and where they
occur) is dealt out by trigger; triggers are counted first, and the strings of a hot one are dealt out
by their next smallest gram hashes as well, which equal strings share too. No suffix
array is built: each part groups the 64-bit hashes of its 50-byte strings and takes the smallest
document of every group; the occurrences carry that back to texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlore.llm.store import fresh_name, gaps, pack, pack_texts, unpack
from boxlore.llm.texts import U64, mix, prefix, ranges, slices, span_hash, window_hash

GRAM = 8
_PLACE = 30  # low bits of a trigger key hold its place in the slice
SLICE = 1 << 20  # bytes of text that are cut into phrases at a time
PART = 4 << 20  # bytes of text per dictionary part and per group of documents
HOT = 4  # a trigger with string starts for more parts than this is dealt out by the next smallest gram hash,
STEP = 1 << 18  # bytes of a part whose strings are hashed at a time,
TURN = 1 << 20  # and strings that are grouped at a time
LEVELS = 3  # and what is left of it by the next one, so many times


def _phrases(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last string start and trigger hash of every phrase."""
    if len(buf) < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    gram = min(GRAM, width)
    g = mix(window_hash(prefix(buf), gram))
    low = U64((1 << _PLACE) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=U64)
    size, span = width - gram + 1, 1
    while span * 2 <= size:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < size:
        key = np.minimum(key[: len(key) - (size - span)], key[size - span :])
    trigger = (key & low).astype(np.int64)
    inside = np.ones(len(trigger), bool)
    tail = np.minimum(np.diff(off), width - 1)
    out = ranges(off[1:] - tail, tail)
    inside[out[out < len(inside)]] = False
    change = np.ones(len(trigger), bool)
    change[1:] = trigger[1:] != trigger[:-1]
    first = inside & change
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | change[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last), g[trigger[start]]


def _starts(share: float, width: int, hot: list[np.ndarray]):
    """String starts of each trigger that has half a ``share`` of a task's starts, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, held, total = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([key, *[k for k, _ in held]])
            which, place = np.unique(keys, return_inverse=True)
            return which, np.bincount(place, np.concatenate([count, *[n for _, n in held]]), len(which)).astype(np.int64)

        for s in slices(batches, SLICE):
            start, last, trigger = _cut_hot(s.buf, *_phrases(s.buf, s.off, width), hot, width)
            which, place = np.unique(trigger, return_inverse=True)
            n = np.bincount(place, last - start + 1, len(which)).astype(np.int64)
            total += int(n.sum())
            # Rare ones of a slice are left out: this bounds memory, and a count only decides how work is dealt.
            held.append((which[n * 4 >= share * n.sum()], n[n * 4 >= share * n.sum()]))
            if len(held) == 64:
                key, count = merged()
                held = []
        key, count = merged()
        many = count * 2 >= share * total
        yield pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(count[many])], names=["trigger", "n"])

    return run


def _next_gram(buf: np.ndarray, start: np.ndarray, width: int, rank: int) -> np.ndarray:
    """The gram hash of each string that ``rank`` others are smaller than; it depends on nothing but the string."""
    gram = min(GRAM, width)
    out = np.empty(len(start), U64)
    low = U64((1 << _PLACE) - 1)
    for at in range(0, len(start), 1 << 13):
        p = start[at : at + (1 << 13)]
        first = int(p[0])
        g = mix(window_hash(prefix(buf[first : int(p[-1]) + width]), gram))
        near = np.lib.stride_tricks.sliding_window_view(g, width - gram + 1)[p - first] & ~low
        for _ in range(rank):
            near[near == near.min(axis=1, keepdims=True)] = ~low
        out[at : at + len(p)] = near.min(axis=1)
    return out


def _cut_hot(buf: np.ndarray, start: np.ndarray, last: np.ndarray, trigger: np.ndarray, hot: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the hot triggers of each level, cut where the next gram hash changes; both make the new trigger."""
    for rank, keys in enumerate(hot, 1):
        mine = np.isin(trigger, keys)
        if not mine.any():
            continue
        many = last[mine] - start[mine] + 1
        p = ranges(start[mine], many)
        both = mix(np.repeat(trigger[mine], many) ^ mix(_next_gram(buf, p, width, rank)), rank)
        new = np.ones(len(p), bool)
        new[1:] = both[1:] != both[:-1]
        new[np.cumsum(many) - many] = True
        lead = np.flatnonzero(new)
        tail = np.r_[lead[1:], len(p)] - 1
        start, last, trigger = np.r_[start[~mine], p[lead]], np.r_[last[~mine], p[tail]], np.r_[trigger[~mine], both[lead]]
        order = np.argsort(start, kind="stable")
        start, last, trigger = start[order], last[order], trigger[order]
    return start, last, trigger


def _dictionary(parts: int, width: int, hot: list[np.ndarray]):
    """Distinct phrases of each slice with their occurrences, packed by dictionary part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, SLICE):
            start, last, trigger = _phrases(s.buf, s.off, width)
            if not len(start):
                continue
            start, last, trigger = _cut_hot(s.buf, start, last, trigger, hot, width)
            length = last - start + width
            doc = np.searchsorted(s.off, start, side="right") - 1
            ids, place = s.ids[doc], start - s.off[doc]
            content = mix(span_hash(prefix(s.buf), start, start + length)) + length.astype(U64)
            part = (trigger >> U64(20)) % U64(parts)
            order = np.lexsort((place, ids, content, part))
            same = np.zeros(len(order), bool)
            c = content[order]
            same[1:] = (c[1:] == c[:-1]) & (part[order][1:] == part[order][:-1])
            head, extra = order[~same], order[same]
            owner = np.cumsum(~same) - 1
            owner = owner[same]
            head_part, extra_part = part[head], part[extra]
            which, cut = np.unique(head_part, return_index=True)
            cut = np.r_[cut, len(head)]
            xcut = np.searchsorted(extra_part, which)
            xcut = np.r_[xcut, len(extra)]
            blobs = []
            for k in range(len(which)):
                h = head[cut[k] : cut[k + 1]]
                by = np.argsort(start[h], kind="stable")
                to = np.empty(len(h), np.int64)
                to[by] = np.arange(len(h))
                h = h[by]
                x = extra[xcut[k] : xcut[k + 1]]
                text = s.buf[ranges(start[h], length[h])]
                blobs.append(pack(length[h].astype(np.uint32), gaps(ids[h]), place[h].astype(np.uint32), text, to[owner[xcut[k] : xcut[k + 1]] - cut[k]], ids[x], place[x].astype(np.uint32), level=3))
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _repeats(length: np.ndarray, doc: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts (phrase, from, to) that also start in a phrase of a smaller document."""
    many = length - (width - 1)
    begin = np.cumsum(length) - length
    ends = np.cumsum(many)
    hashes = np.empty(int(ends[-1]), U64)
    at = 0
    while at < len(length):  # a few megabytes of prefix sums and places at a time
        to = max(int(np.searchsorted(begin, begin[at] + STEP, side="right")), at + 1)
        stop = begin[to - 1] + length[to - 1]
        pre = prefix(text[begin[at] : stop])
        p = ranges(begin[at:to] - begin[at], many[at:to])
        hashes[ends[at] - many[at] : ends[to - 1]] = mix(span_hash(pre, p, p + width))
        at = to
    repeated = np.zeros(len(hashes), bool)
    turns = len(hashes) // TURN + 1
    low = U64((1 << 24) - 1)
    for turn in range(turns):
        mine = np.concatenate([np.flatnonzero(hashes[a : a + TURN] % U64(turns) == U64(turn)) + a for a in range(0, len(hashes), TURN)]) if turns > 1 else None
        h = hashes if mine is None else hashes[mine]
        if len(h) > 1 << 24:  # one string fills the turn
            index = np.arange(len(h))
        else:
            key = np.sort((h & ~low) | np.arange(len(h), dtype=U64))
            top = key >> U64(24)
            equal = top[1:] == top[:-1]
            grouped = np.zeros(len(key), bool)
            grouped[1:] |= equal
            grouped[:-1] |= equal
            index = (key[grouped] & low).astype(np.int64)
        if not len(index):
            continue
        whole = h[index]
        index = index if mine is None else mine[index]
        source = doc[np.searchsorted(ends, index, side="right")]
        order = np.lexsort((source, whole))
        whole, index, source = whole[order], index[order], source[order]
        first = np.ones(len(whole), bool)
        first[1:] = whole[1:] != whole[:-1]
        least = source[first][np.cumsum(first) - 1]
        repeated[index[source > least]] = True
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return hit, hit, hit
    phrase = np.searchsorted(ends, hit, side="right")
    brk = np.ones(len(hit), bool)
    brk[1:] = (hit[1:] != hit[:-1] + 1) | (phrase[1:] != phrase[:-1])
    lead = np.flatnonzero(brk)
    tail = np.r_[lead[1:], len(hit)] - 1
    zero = (ends - many)[phrase[lead]]
    return phrase[lead], hit[lead] - zero, hit[tail] - zero + width


def _taken(held: list) -> list:
    """The items of a list that is emptied, so that they go as soon as they were used."""
    out = list(held)
    held.clear()
    return out


def _decide(parts: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        fields: list[list[np.ndarray]] = [[] for _ in range(7)]
        for blob in table["blob"]:  # one at a time: packed and unpacked bytes of a part are never held together
            for held, values in zip(fields, unpack(blob.as_py()), strict=True):
                held.append(values)
        del table
        base = np.cumsum([0, *[len(x) for x in fields[0]]])
        fields[1] = [np.cumsum(x) for x in fields[1]]
        fields[4] = [x + b for x, b in zip(fields[4], base, strict=False)]
        length, doc, place, text, owner, xdoc, xplace = (np.concatenate(_taken(held)) for held in fields)
        length, place, xplace = length.astype(np.int64), place.astype(np.int64), xplace.astype(np.int64)
        phrase, low, high = _repeats(length, doc, text, width)
        later = xdoc > doc[owner]  # a copy of the phrase opens in a smaller document
        again = np.flatnonzero(~later)
        runs = np.bincount(phrase, minlength=len(length))
        first = np.cumsum(runs) - runs
        n = runs[owner[again]]
        pick = ranges(first[owner[again]], n)
        spot = np.repeat(xplace[again], n)
        ids = np.concatenate([doc[phrase], xdoc[later], np.repeat(xdoc[again], n)])
        start = np.concatenate([place[phrase] + low, xplace[later], spot + low[pick]])
        end = np.concatenate([place[phrase] + high, xplace[later] + length[owner[later]], spot + high[pick]])
        group = (mix(ids.view(U64)) % U64(parts)).astype(np.int64)
        order = np.lexsort((start, ids, group))
        which, cut = np.unique(group[order], return_index=True)
        blobs = [pack(gaps(ids[o]), start[o].astype(np.uint32), (end[o] - start[o]).astype(np.uint32)) for o in np.split(order, cut[1:])] if len(order) else []
        return pa.table({"docs": pa.array(which, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _merge(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs out of overlapping or touching spans."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    number = np.cumsum(np.r_[False, ids[1:] != ids[:-1]]) if len(ids) else ids
    step = int(end.max()) + 2 if len(end) else 1  # one line of numbers, documents far apart
    reach = np.maximum.accumulate(end + number * step)
    new = np.ones(len(ids), bool)
    new[1:] = (start[1:] + number[1:] * step) > reach[:-1]
    lead = np.flatnonzero(new)
    tail = np.r_[lead[1:], len(ids)] - 1
    return ids[lead], start[lead], (reach[tail] - number[tail] * step) if len(lead) else end


def _spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [unpack(b) for b in table["blob"].to_pylist()]
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    ids = np.concatenate([np.cumsum(r[0]) for r in rows])
    start = np.concatenate([r[1] for r in rows]).astype(np.int64)
    return _merge(ids, start, start + np.concatenate([r[2] for r in rows]).astype(np.int64))


def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, start, end = _spans(right)
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    out: dict[str, list] = {k: [] for k in kinds}
    for blob in left["blob"].to_pylist():
        own, length, raw = unpack(blob)
        at = np.cumsum(length) - length
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        for i in range(len(own)):
            text, done, gone, rest = raw[at[i] : at[i] + length[i]], 0, 0, hashlib.sha256()
            for k in range(lo[i], hi[i]):
                rest.update(text[done : start[k]])
                done = int(end[k])
                gone += done - int(start[k])
            rest.update(text[done:])
            for name, value in zip(kinds, (int(own[i]), int(length[i]), gone, int(hi[i] - lo[i]), rest.hexdigest()), strict=True):
                out[name].append(value)
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")


def _removed(base: DataFrame, width: int, part: int) -> tuple[DataFrame, int]:
    """Spans to remove, packed by group of documents, and the number of groups."""
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, int(size // part))
    share, hot = HOT * part / max(size, 1), []
    while len(hot) < LEVELS:
        counted = base.mapInArrow(_starts(share, width, hot), "trigger bigint, n bigint").groupBy("trigger").agg(F.sum("n").alias("n"))
        # Starts are no more than bytes: no more hot triggers than parts.
        found = counted.where(F.col("n") >= share * size).select("trigger").toArrow()["trigger"].to_numpy()
        if not len(found):
            break
        hot.append(np.sort(found.astype(np.int64).view(U64)))
    phrases = base.mapInArrow(_dictionary(parts, width, hot), "part bigint, blob binary")
    return phrases.groupBy("part").applyInArrow(_decide(parts, width), "docs bigint, blob binary"), parts


def remove_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a ``width``-byte string that covers it
    also starts in a document with a smaller key; strings are judged on the input. Texts shorter
    than ``width`` lose nothing.
    Rows that share a key must share their text; they get the same result. A null key gets none.

    A slice of a task sends each distinct phrase once, with all places it has there, so a passage
    that every document holds is a few bytes per occurrence, spread over as many parts as it has
    triggers. Strings are equal if their 64-bit hashes under one trigger are.
    """
    base = _keyed(docs, key, text)
    spans, parts = _removed(base, width, part)
    texts = base.mapInArrow(pack_texts(parts), "docs bigint, blob binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return texts.groupBy("docs").cogroup(spans.groupBy("docs")).applyInArrow(_apply, schema)


def _grouped(key: str, parts: int, group_name: str):
    """Rows with the number of their group of documents; rows without a key are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key).cast(pa.int64())
            group = (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64)) % U64(parts)).astype(np.int64)
            group = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.arange(len(group)) % parts, group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], names=[*batch.schema.names, group_name])

    return run


def _cut(key: int, text: int):
    """Rows of a group of documents with what is left of each text; columns by their place."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, start, end = _spans(right)
        left = left.select(list(range(left.num_columns - 1)))
        own = left.column(key).to_pylist()
        texts = left.column(text).to_pylist()
        for i, (doc, value) in enumerate(zip(own, texts, strict=True)):
            lo, hi = (0, 0) if doc is None else (np.searchsorted(ids, doc), np.searchsorted(ids, doc, side="right"))
            if hi > lo:
                raw, done, keep = value.encode("utf-8", "surrogatepass"), 0, []
                for k in range(lo, hi):
                    keep.append(raw[done : start[k]])
                    done = int(end[k])
                texts[i] = b"".join([*keep, raw[done:]]).decode("utf-8", "ignore")
        return left.set_column(text, left.field(text), pa.array(texts, left.field(text).type))

    return run


def without_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """``docs`` with the rest of each text; other columns, and rows without a key, as they were.

    Bytes of characters that were cut in two are left out. Rows travel once, to the spans that go.
    """
    spans, parts = _removed(_keyed(docs, key, text), width, part)
    group = fresh_name(docs, "docs")
    placed = docs.mapInArrow(_grouped(key, parts, group), T.StructType([*docs.schema.fields, T.StructField(group, T.LongType())]))
    at = [docs.columns.index(key), docs.columns.index(text)]
    return placed.groupBy(group).cogroup(spans.groupBy("docs")).applyInArrow(_cut(*at), docs.schema)

"""Language-model scoring by a weighted backoff automaton.

The model: a word pair's share among what follows its first word, mixed with the word's add-one
share in the corpus, in which all unknown words are one. As an automaton: a state is the last word;
a known pair is an arc with its own weight; any other word first takes the failure arc to the
root, which costs what the mixture leaves, and then the root's arc of the word. What a state
leaves is counted, not chosen (Witten-Bell): of the C occurrences of the words of a frequency class
(a power of two) T were followed by a word for the first time, so their states leave T / (C + T).
The weights that leave a state sum to one. Counts cover all training documents.

The automaton as a whole stays a table: a group of documents asks for the totals of the words and
pairs it holds, and gets its part of the automaton. The counts along its texts are stored; when
all groups are counted, the number of distinct words and the weights of the classes (64 numbers)
are known, and one traversal from left to right adds up the log-probabilities. Nothing depends on
how the rows are partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.llm.store import gaps, pack, pack_texts, unpack
from boxlore.llm.texts import U64, Slice, mix, prefix, span_hash, words
from boxlore.session import Scratch

END, BEGIN = U64(0x45E0D5E1C0FFEE01), U64(0xB0B5EED5CAFE0003)
PART = 4 << 20
CLASSES = 64  # of states by frequency: powers of two, and the last for the begin of a text


class Group:
    """Tokens of a group of documents: sorted distinct words and pairs, and each token's place among them."""

    def __init__(self, blobs: list[bytes], modulus: int, held_out: int):
        rows = [unpack(b) for b in blobs]
        self.ids = np.concatenate([r[0] for r in rows])
        length = np.concatenate([r[1] for r in rows])
        off = np.r_[0, np.cumsum(length)]
        part = Slice(self.ids, np.concatenate([r[2] for r in rows]), off)
        self.low = part.lower()
        self.start, self.end, doc = words(self.low, off)
        n = len(self.ids)
        count = np.bincount(doc, minlength=n)
        self.held = np.array([zlib.crc32(str(i).encode()) % modulus == held_out for i in self.ids.tolist()], bool)
        token = np.empty(len(doc) + n, U64)
        self.at = np.arange(len(doc)) + doc
        token[self.at] = mix(span_hash(prefix(self.low), self.start, self.end))
        token[np.cumsum(count) + np.arange(n)] = END
        self.doc = np.repeat(np.arange(n), count + 1)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        self.opens = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(token) else np.zeros(0, bool)
        before[self.opens] = BEGIN
        self.word, self.number = np.unique(token, return_inverse=True)
        self.pair, self.pair_at, self.pair_number = np.unique(mix(before * U64(0xD1B54A32D192ED03) + token) >> U64(16), return_index=True, return_inverse=True)
        learnt = ~self.held[self.doc]
        self.counts = [np.bincount(i[learnt], minlength=len(k)).astype(np.uint32) for i, k in ((self.number, self.word), (self.pair_number, self.pair))]

    def cuts(self, parts: int) -> list[np.ndarray]:
        """Where each part of the table begins among the sorted words and pairs."""
        edge = [(i << 64) // parts for i in range(1, parts)]
        return [np.r_[0, np.searchsorted(k, np.array([e >> s for e in edge], U64)), len(k)] for k, s in ((self.word, 0), (self.pair, 16))]


def _ask(parts: int, modulus: int, held_out: int):
    def run(table: pa.Table) -> pa.Table:
        group = Group(table["blob"].to_pylist(), modulus, held_out)
        (w, p), docs = group.cuts(parts), table["docs"][0].as_py()
        part, blobs = [], []
        for k in range(parts):
            if w[k] < w[k + 1] or p[k] < p[k + 1]:
                a, b = slice(w[k], w[k + 1]), slice(p[k], p[k + 1])
                part.append(k)
                blobs.append(pack(gaps(group.word[a]), group.counts[0][a], gaps(group.pair[b]), group.counts[1][b]))
        return pa.table({"part": pa.array(part, pa.int64()), "docs": pa.array([docs] * len(part), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of every asked word and pair; the lowest bit tells one asker to count it as distinct."""
    docs = table["docs"].to_numpy()
    order = np.argsort(docs, kind="stable")
    blobs = table["blob"].to_pylist()
    rows = [unpack(blobs[i]) for i in order]
    totals = []
    for k in (0, 2):
        size = [len(r[k]) for r in rows]
        keys = np.concatenate([np.cumsum(r[k], dtype=U64) for r in rows])
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(number, np.concatenate([r[k + 1] for r in rows]), len(first)).astype(np.uint64)
        out = total[number] << U64(1)
        out[first[total > 0]] |= U64(1)
        totals.append(np.split(out, np.cumsum(size)[:-1]))
    part = table["part"]
    return pa.table({"docs": pa.array(docs[order]), "part": part, "blob": pa.array([pack(a, b) for a, b in zip(*totals, strict=True)], pa.binary())})


def class_of(count: np.ndarray) -> np.ndarray:
    """The frequency class of states: the exponent of two of their counts."""
    return np.frexp(count.astype(float))[1] - 1


_COUNTED = "docs bigint, texts bigint, tokens bigint, v bigint, seen array<bigint>, fresh array<bigint>, blob binary"


def _count(modulus: int, held_out: int):
    """A group's part of the automaton along its texts: of each token the count of its word and of its pair.

    ``v``, ``seen`` and ``fresh``: distinct words, occurrences of states and distinct pairs by
    class, of those words and pairs that this group is to count.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left["blob"].to_pylist(), modulus, held_out)
        blobs = right["blob"].to_pylist()
        answers = [unpack(blobs[i]) for i in np.argsort(right["part"].to_numpy(), kind="stable")]
        known, pairs = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
        word, pair = (known >> U64(1)).astype(np.int64), (pairs >> U64(1)).astype(np.int64)
        end = int(np.searchsorted(g.word, END))
        mine = np.flatnonzero((known & U64(1)).astype(bool) & (np.arange(len(known)) != end))
        seen = np.bincount(class_of(word[mine]), word[mine], CLASSES).astype(np.int64)
        at = g.pair_at[np.flatnonzero(pairs & U64(1))]
        before = np.where(g.opens[at], 1, word[g.number[np.maximum(at - 1, 0)]])
        fresh = np.bincount(np.where(g.opens[at], CLASSES - 1, class_of(before)), minlength=CLASSES)
        length = np.bincount(g.doc, minlength=len(g.ids))
        blob = pack(g.ids, g.held.astype(np.uint8), length, word[g.number], pair[g.pair_number])
        return pa.table({
            "docs": left["docs"][:1], "texts": [int(word[end])], "tokens": [int(length[~g.held].sum())], "v": [int((known & U64(1)).sum())],
            "seen": pa.array([seen], pa.list_(pa.int64())), "fresh": pa.array([fresh], pa.list_(pa.int64())), "blob": pa.array([blob], pa.binary()),
        })

    return run


_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _traverse(texts: int, tokens: int, distinct: int, share: np.ndarray):
    """Scores of the documents of stored groups; ``share``: of each class, what pairs keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in (x for batch in batches for x in batch.column("blob").to_pylist()):
            ids, held, length, word, pair = unpack(blob)
            doc = np.repeat(np.arange(len(ids)), length)
            opens = np.zeros(len(doc), bool)
            opens[np.cumsum(length) - length] = True
            state = np.empty(len(doc))
            state[1:], state[opens] = word[:-1], texts
            of = np.where(opens, CLASSES - 1, np.maximum(class_of(state), 0))
            keep = np.where(state > 0, share[of], 0.0)
            root = (word + 1) / (tokens + distinct + 1)
            fail = (1 - keep) * root
            arc = keep * pair / np.maximum(state, 1) + fail
            sums = [np.bincount(doc, np.log10(x), len(ids)) for x in (root, np.where(pair > 0, arc, fail))]
            known = np.bincount(doc[word > 0], minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(held.astype(bool)), pa.array(length), pa.array(known), pa.array(np.full(len(ids), tokens)), *map(pa.array, sums)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame, own: Scratch, modulus: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are lower-cased words and one end per text; null, empty and blank texts are an end alone.
    Learns from all documents whose crc32(id) mod ``modulus`` is not ``held_out``. Words count by
    64-bit hashes, pairs by 48-bit ones. Without training documents every word is unknown. Rows
    that share a key are scored each for itself; a null key gets no result.
    """
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, int(size // part))
    texts = base.mapInArrow(pack_texts(parts), "docs bigint, blob binary")
    tables = max(16, parts // 4)
    asked = texts.groupBy("docs").applyInArrow(_ask(tables, modulus, held_out), "part bigint, docs bigint, blob binary")
    told = asked.groupBy("part").applyInArrow(_answer, "docs bigint, part bigint, blob binary")
    done = own.keep(texts.groupBy("docs").cogroup(told.groupBy("docs")).applyInArrow(_count(modulus, held_out), _COUNTED))
    sums = done.agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("seen", "fresh") for i in range(CLASSES)], F.sum("v").alias("v"), F.sum("tokens").alias("tokens"), F.max("texts").alias("texts")).first()
    seen, fresh = (np.array([sums[f"{c}{i}"] or 0 for i in range(CLASSES)], float) for c in ("seen", "fresh"))
    n_texts = sums["texts"] or 0
    seen[CLASSES - 1] = n_texts
    share = seen / np.maximum(seen + fresh, 1)
    scored = done.mapInArrow(_traverse(n_texts, sums["tokens"] or 0, sums["v"] or 0, share), _SCHEMA)
    return scored.withColumnRenamed("doc_id", key)

"""Token ids of whole texts by a tokenizer file, with a memo of words."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from boxlore.llm.texts import _BASE2, U64, _binary, mix, prefix, ranges, span_hash

MEMO = 1_000_000
PART = 2 << 20  # bytes of texts that are looked up at a time
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _space_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space (of any script)."""
    one, two, three = (buf[np.maximum(at - k, 0)] for k in (1, 2, 3))
    out = _SPACE[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    wide = (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return out | wide | (one == 0x80) & ((three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80))


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _joints(buf: np.ndarray) -> np.ndarray:
    """Places at which a pre-token begins whatever stands around them, and which change no other.

    A pre-token is a run of letters, of digits or of other characters (a blank may open it), white
    space, or an apostrophe with its ending. So one always begins between a letter and a following
    mark or line end, between a mark and a line end, and between a mark other than the apostrophe
    and a letter. A line end behind a mark or letter is one pre-token when a letter follows.
    Letters are those of ASCII, and in front of marks those of Latin-1 as well.
    """
    out = np.zeros(len(buf), bool)
    if len(buf) < 2:
        return out
    letter, mark, line = _LETTER[buf], _MARK[buf], buf == 10
    ends = letter.copy()
    ends[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    out[1:] = ends[:-1] & (mark[1:] | line[1:]) | mark[:-1] & line[1:] | (mark & (buf != 39))[:-1] & letter[1:]
    out[2:] |= (mark | ends)[:-2] & line[1:-1] & letter[2:]
    return out


class Encoder:
    """Byte-level BPE ids of texts, as little-endian unsigned 32-bit numbers.

    A blank opens a new pre-token unless white space stands before it. So a text without such
    places may be cut in front of its blanks, and a cut word's ids never depend on its
    neighbours: each distinct word is encoded once and kept (the memo is emptied when it holds
    :data:`MEMO` words and runs). New words are put together from runs of letters and of other
    characters, so a run is encoded once with any punctuation around it. Words are told by 128
    bits of hashes and looked up for many texts at once. Other texts are encoded whole. Special
    strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        blank = self._tok.encode("a b", add_special_tokens=False).tokens[-1][0]
        self._opens = np.zeros(self._tok.get_vocab_size(), bool)
        self._opens[[i for t, i in self._tok.get_vocab().items() if t.startswith(blank)]] = True
        self._forget()

    def _forget(self) -> None:
        self._key, self._other = np.zeros(0, U64), np.zeros(0, U64)
        self._at, self._n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._held, self._used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self._tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words with a blank in front, and the number of each: encoded in long lines, cut where a token opens with one."""
        cuts = [slice(at, at + 2000) for at in range(0, len(start), 2000)]
        lines = [buf[ranges(start[c], end[c] - start[c])].tobytes().decode() for c in cuts]
        ids, count = [], []
        for c, line in zip(cuts, self._ids(lines), strict=True):
            opens = np.flatnonzero(self._opens[line])
            if len(opens) == len(start[c]):
                ids.append(line)
                count.append(np.diff(opens, append=len(line)))
            else:
                ids += self._ids([buf[i:j].tobytes().decode() for i, j in zip(start[c].tolist(), end[c].tolist(), strict=True)])
                count.append(np.array([len(x) for x in ids[-len(start[c]) :]]))
        return ids, count

    def _learn(self, key: np.ndarray, other: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Put words into the memo; ``key`` is sorted and new to it.

        Words are cut into the runs of letters and of other characters that no pre-token joins, so
        that a run is encoded once, whatever stands around it.
        """
        n = end - start
        off = np.cumsum(n) - n
        text = buf[ranges(start, n)]
        first = _joints(text)
        first[off] = True
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(text))
        run, run_other = mix(span_hash(prefix(text), first, last)), mix(span_hash(prefix(text, _BASE2), first, last, _BASE2), 9)
        runs, lead, number = np.unique(run, return_index=True, return_inverse=True)
        fresh = ~self._known(runs)
        lead = lead[fresh]
        self._keep(runs[fresh], run_other[lead], *self._encoded(text, first[lead], last[lead]))
        at = np.searchsorted(self._key, runs)[number]
        word = np.searchsorted(off, first, side="right") - 1
        mixed = np.zeros(len(key), bool)
        mixed[word[self._other[at] != run_other]] = True  # one key for two runs
        joined = (np.bincount(word, minlength=len(key)) > 1) | mixed
        if joined.any():
            mine = joined[word]
            at, word = at[mine], word[mine]
            count = np.bincount(word, self._n[at], len(key)).astype(np.int64)[joined]
            ids = self._held[ranges(self._at[at], self._n[at])]
            if mixed.any():
                parts, where = np.split(ids, np.cumsum(count)[:-1]), np.flatnonzero(mixed[joined]).tolist()
                for i, k in zip(where, np.flatnonzero(mixed).tolist(), strict=True):
                    parts[i] = self._ids([buf[start[k] : end[k]].tobytes().decode()])[0]
                    count[i] = len(parts[i])
                ids = np.concatenate(parts)
            new = ~self._known(key[joined])
            if not new.all():  # one key for a word and for a run: the word's texts are encoded whole
                parts = np.split(ids, np.cumsum(count)[:-1])
                ids, count = np.concatenate([ids[:0], *[parts[i] for i in np.flatnonzero(new).tolist()]]), count[new]
            self._keep(key[joined][new], other[joined][new], ids, count)

    def _known(self, key: np.ndarray) -> np.ndarray:
        """Whether the memo has each key."""
        if not len(self._key):
            return np.zeros(len(key), bool)
        return self._key[np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)] == key

    def _encoded(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and the number of each."""
        behind = (buf[start] == 32) & (end - start > 1)
        order = np.concatenate([np.flatnonzero(behind), np.flatnonzero(~behind)])
        ids, count = self._words(buf, start[behind], end[behind])
        rest = self._ids([buf[i:j].tobytes().decode() for i, j in zip(start[~behind].tolist(), end[~behind].tolist(), strict=True)])
        flat = np.concatenate([np.zeros(0, np.uint32), *ids, *rest])
        n = np.concatenate([np.zeros(0, np.int64), *count, np.array([len(x) for x in rest], np.int64)])
        at, back = np.cumsum(n) - n, np.empty(len(n), np.int64)
        back[order] = np.arange(len(n))
        return flat[ranges(at[back], n[back])], n[back]

    def _keep(self, key: np.ndarray, other: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Add sorted new keys with their ids."""
        at = self._used + np.cumsum(n) - n
        if self._used + len(ids) > len(self._held):
            grown = np.zeros(2 * (self._used + len(ids)), np.uint32)
            grown[: self._used] = self._held[: self._used]
            self._held = grown
        self._held[self._used : self._used + len(ids)] = ids
        where = np.searchsorted(self._key, key)
        self._key, self._other = np.insert(self._key, where, key), np.insert(self._other, where, other)
        self._at, self._n = np.insert(self._at, where, at), np.insert(self._n, where, n)
        self._used += len(ids)

    def _part(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and the number of each."""
        n = len(off) - 1
        size = np.diff(off)
        blank = np.flatnonzero(buf == 32)
        doc = np.searchsorted(off, blank, side="right") - 1
        inner = blank > off[doc]
        whole = np.zeros(n, bool)
        whole[doc[inner & _space_before(buf, blank)]] = True
        cut = blank[inner & ~whole[doc]]
        start = np.sort(np.concatenate([off[:-1][(size > 0) & ~whole], cut]))
        doc = np.searchsorted(off, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(buf)), off[doc + 1])
        key = mix(span_hash(prefix(buf), start, end))
        other = mix(span_hash(prefix(buf, _BASE2), start, end, _BASE2), 9)
        word, first, number = np.unique(key, return_index=True, return_inverse=True)
        if len(self._key) > MEMO:
            self._forget()
        at = np.minimum(np.searchsorted(self._key, word), max(len(self._key) - 1, 0))
        fresh = self._key[at] != word if len(self._key) else np.ones(len(word), bool)
        new = first[fresh]
        self._learn(word[fresh], other[new], buf, start[new], end[new])
        at = np.searchsorted(self._key, word)[number]
        mixed = self._other[at] != other  # one key for two words: their texts are encoded whole
        whole[doc[mixed]] = True
        good = ~whole[doc]
        at, doc = at[good], doc[good]
        ids = self._held[ranges(self._at[at], self._n[at])]
        count = np.bincount(doc, self._n[at], n).astype(np.int64)
        if whole.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            some = np.flatnonzero(whole).tolist()
            for i, x in zip(some, self._ids([buf[off[i] : off[i + 1]].tobytes().decode() for i in some]), strict=True):
                parts[i], count[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, count

    def encode(self, texts: Sequence[str | None] | pa.Array, end: int | None = None) -> list[np.ndarray]:
        """Ids of each text (null as empty), followed by ``end`` if given."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())
        buf, off = _binary(column)
        out: list[np.ndarray] = []
        at, n = 0, len(off) - 1
        while at < n:
            stop = min(max(int(np.searchsorted(off, off[at] + PART, side="right")) - 1, at + 1), n)
            ids, count = self._part(buf[off[at] : off[stop]], off[at : stop + 1] - off[at])
            if end is not None:
                ids, count = np.insert(ids, np.cumsum(count), end), count + 1
            ids = ids.astype("<u4", copy=False)
            edge = np.cumsum(count).tolist()
            out += [ids[a:b] for a, b in zip([0, *edge[:-1]], edge, strict=True)]
            at = stop
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per process; its memo serves all its tasks."""
    return Encoder(path)

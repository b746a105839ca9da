"""Toxicity: a bidirectional gated recurrent network over words and their characters, in NumPy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.llm.labelled import sample
from boxlore.llm.texts import U64, Slice, mix, prefix, ranges, slices, span_hash, words

WINDOW, STEP = 32, 16
HIDDEN = 8
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
STRETCH, FEW = 1 << 18, 1 << 13  # bytes of text, and distinct words, that are worked on at a time
INPUTS = 4 + 4  # statistics of a word, and its learnt vector


def _from_texts(texts: list[str]) -> Slice:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return Slice(np.arange(len(raw)), np.frombuffer(b"".join(raw), np.uint8), off.astype(np.int64))


@dataclass
class Words:
    """Words of some texts: their text, their number among the distinct words, and the distinct
    words' bucket and character-gram buckets (flat, with where each word's begin)."""

    doc: np.ndarray
    number: np.ndarray
    bucket: np.ndarray
    gram: np.ndarray
    begin: np.ndarray


def read_words(part: Slice) -> Words:
    """Texts are hashed some at a time, and distinct words as well: only numbers are held of all."""
    starts, ends, docs, keys = [], [], [], []
    at = 0
    while at < len(part):
        to = max(int(np.searchsorted(part.off, part.off[at] + STRETCH, side="right")) - 1, at + 1)
        first = part.off[at]
        low = Slice(part.ids[at:to], part.buf[first : part.off[to]], part.off[at : to + 1] - first)
        text = low.lower()
        start, end, doc = words(text, low.off)
        keys.append(mix(span_hash(prefix(text), start, end)))
        starts.append(start + first)
        ends.append(end + first)
        docs.append(doc + at)
        at = to
    none = np.zeros(0, np.int64)
    doc, key = np.concatenate([none, *docs]), np.concatenate([none.astype(U64), *keys])
    distinct, first, number = np.unique(key, return_index=True, return_inverse=True)
    s, e = np.concatenate([none, *starts])[first], np.concatenate([none, *ends])[first]
    grams, begin, held = [], [], 0
    for at in range(0, len(s), FEW):
        gram, owner = _grams(part, s[at : at + FEW], e[at : at + FEW], distinct[at : at + FEW])
        begin.append(np.searchsorted(owner, np.arange(len(s[at : at + FEW]))) + held)
        grams.append(gram)
        held += len(gram)
    return Words(doc, number, (mix(distinct, 7) % U64(BUCKETS)).astype(np.int64), np.concatenate([none.astype(np.int32), *grams]), np.concatenate([none, *begin]))


def _grams(part: Slice, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of some words, and the word of each."""
    size = end - start
    text = Slice(key, part.buf[ranges(start, size)], np.r_[0, np.cumsum(size)]).lower()
    pre, s = prefix(text), np.cumsum(size) - size
    grams, owner = [], []
    for n in GRAMS:
        many = np.maximum(size - n + 1, 0)
        at = ranges(s, many)
        grams.append((mix(span_hash(pre, at, at + n), n) % U64(BUCKETS)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(s), dtype=np.int32), many))
    short = np.flatnonzero(size < GRAMS[0])
    grams.append((mix(key[short], 9) % U64(BUCKETS)).astype(np.int32))
    owner.append(short.astype(np.int32))
    gram, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return gram[order], owner[order]


def _subset(w: Words, some: np.ndarray) -> Words:
    """The given distinct words alone."""
    length = np.diff(np.r_[w.begin, len(w.gram)])[some]
    begin = np.cumsum(length) - length
    at = np.repeat(w.begin[some] - begin, length) + np.arange(length.sum())
    return Words(w.doc[:0], w.number[:0], w.bucket[some], w.gram[at], begin)


def windows(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window: each STEP words, as long as a word is not yet covered."""
    count = np.bincount(doc, minlength=n)
    many = np.where(count > 0, np.maximum(np.ceil((count - WINDOW) / STEP), 0) + 1, 0).astype(np.int64)
    text = np.repeat(np.arange(n), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(count) - count, many) + step * STEP, text


class Network:
    """Two gated recurrent passes, attention over positions, one logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = INPUTS, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"vec": draw(BUCKETS, 4) * 0.1, "att": draw(2 * h), "attw": draw(2 * h, 2 * h), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.odds = np.zeros((2, BUCKETS), np.float32)  # log-odds of words and of character grams

    def inputs(self, w: Words) -> np.ndarray:
        """One row per distinct word."""
        out, edge = np.empty((len(w.bucket), INPUTS), np.float32), np.r_[w.begin, len(w.gram)]
        for at in range(0, len(w.bucket), FEW):
            bucket, begin = w.bucket[at : at + FEW], edge[at : at + FEW + 1]
            gram, length = w.gram[begin[0] : begin[-1]], np.diff(begin)
            begin, g = begin[:-1] - begin[0], self.odds[1][gram]
            stats = [self.odds[0][bucket], np.maximum.reduceat(g, begin), np.add.reduceat(g, begin) / length, np.log1p(length) / 2 - 1]
            vec = np.add.reduceat(self.p["vec"][gram], begin, axis=0) / length[:, None] + self.p["vec"][bucket]
            out[at : at + FEW] = np.column_stack([*stats, vec])
        return out

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """x: (steps, rows, 3h), the projected inputs; where mask is 0 the state stays."""
        h3 = 3 * HIDDEN
        U, steps = self.p[f"U{side}"], range(len(x))
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in steps if side == "f" else reversed(steps):
            u = h @ U
            gate = 0.5 + 0.5 * np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]))
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN : h3] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, u, z, r, n, m))
            h = new if m.all() else np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows. x: inputs of distinct words; index: (steps, rows) word numbers, -1 is none."""
        mask = index >= 0
        safe = np.where(mask, index, 0)
        states = []
        for side in "fb":
            proj = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
            keep = [] if tape is not None else None
            states.append(self._pass(proj[safe], mask, side, keep))
            if tape is not None:
                tape[side] = keep
        s = np.concatenate(states, axis=2)
        inner = np.tanh(s @ self.p["attw"])
        score = np.where(mask, inner @ self.p["att"], np.float32(-1e9))
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * s).sum(0)
        if tape is not None:
            tape.update(mask=mask, safe=safe, s=s, inner=inner, a=a, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, w: Words, x: np.ndarray, tape: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of sum(d * logits)."""
        p, s, a, inner, h = self.p, tape["s"], tape["a"], tape["inner"], HIDDEN
        grad = {"out": d @ tape["pooled"], "bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["out"]
        da = (s * dp).sum(2)
        ds = a[:, :, None] * dp
        dscore = a * (da - (a * da).sum(0))
        grad["att"] = np.einsum("tr,trk->k", dscore, inner)
        dpre = dscore[:, :, None] * p["att"] * (1 - inner * inner)
        grad["attw"] = np.einsum("trj,trk->jk", s, dpre, optimize=True)
        ds = ds + dpre @ p["attw"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            U, dh = p[f"U{side}"], 0
            gW, gU, gc = np.zeros_like(p[f"W{side}"]), np.zeros_like(U), np.zeros_like(p[f"c{side}"])
            for t, before, u, z, r, n, m in reversed(tape[side]):
                g = ds[t][:, k * h : (k + 1) * h] + dh
                live = g * m
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (before - n) * z * (1 - z)
                dr = dn * u[:, 2 * h :] * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                dproj = np.concatenate([dz, dr, dn], 1)
                gU += before.T @ du
                gc += dproj.sum(0)
                rows = tape["safe"][t]
                gW += x[rows].T @ dproj
                np.add.at(dx, rows, dproj @ p[f"W{side}"].T)
                dh = g * ~m + live * z + du @ U.T
            grad |= {f"W{side}": gW, f"U{side}": gU, f"c{side}": gc}
        dv = dx[:, 4:]
        length = np.diff(np.r_[w.begin, len(w.gram)])
        vec = np.zeros_like(p["vec"])
        np.add.at(vec, w.bucket, dv)
        np.add.at(vec, w.gram, np.repeat(dv / length[:, None], length, axis=0))
        return grad | {"vec": vec}


def _index(w: Words, first: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(WINDOW, rows) word numbers of windows, -1 behind a text's end."""
    stop = np.cumsum(np.bincount(w.doc, minlength=n))[text]
    at = first + np.arange(WINDOW)[:, None]
    return np.where(at < stop, w.number[np.minimum(at, max(len(w.number) - 1, 0))], -1).astype(np.int32)


@dataclass
class Model:
    net: Network
    slope: float
    shift: float
    prior: float


def best_logits(net: Network, part: Slice) -> np.ndarray:
    """Highest window logit of each text; -inf without words."""
    w = read_words(part)
    best = np.full(len(part), -np.inf, np.float32)
    first, text = windows(w.doc, len(part))
    x = net.inputs(w)
    for at in range(0, len(first), 2048):
        f, t = first[at : at + 2048], text[at : at + 2048]
        np.maximum.at(best, t, net.forward(x, _index(w, f, t, len(part))))
    return best


def _odds(parts: list[tuple[Words, np.ndarray]]) -> np.ndarray:
    """Log-odds of words and grams by the texts that hold them, drawn to 0 where few do."""
    counts = np.zeros((2, 2, BUCKETS))
    for w, label in parts:
        edge = np.searchsorted(w.doc, np.arange(0, len(label) + 64, 64))
        for at, to in zip(edge[:-1], edge[1:], strict=True):  # some texts at a time: grams are many
            doc, number = w.doc[at:to], w.number[at:to]
            for k, (bucket, owner) in enumerate([(w.bucket[number], doc), _spread(w, doc, number)]):
                seen = np.unique(owner * BUCKETS + bucket)
                for value in (0, 1):
                    counts[k, value] += np.bincount(seen[label[seen // BUCKETS] == value] % BUCKETS, minlength=BUCKETS)
    many = np.array([[sum((y == value).sum() for _, y in parts)] for value in (0, 1)])
    odds = np.zeros((2, BUCKETS), np.float32)
    for k in (0, 1):
        share = (counts[k] + 0.5) / (many + 1)
        total = counts[k].sum(0)
        odds[k] = np.clip(np.log(share[1] / share[0]), -3, 3) * total / (total + 8)
    return odds


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 8, seed: int = 7) -> Model:
    """Train on texts: two fifths, two fifths and one fifth.

    The network sees each of the first two with the log-odds of the other, so that it learns how
    far they can be trusted, on each text's most telling windows and a random one. Scoring uses
    the log-odds of both; the rest calibrates.
    """
    net = Network(seed)
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return Model(net, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    rng = np.random.default_rng(seed)
    use = rng.permutation(len(texts)) % 5 // 2
    parts = [_from_texts([t for t, own in zip(texts, use, strict=True) if own == k]) for k in range(2)]
    seen = [(read_words(p), y[use == k]) for k, p in enumerate(parts)]
    views = []
    for k, (w, label) in enumerate(seen):
        net.odds = _odds([seen[1 - k]])
        first, text = windows(w.doc, len(parts[k]))
        index = _index(w, first, text, len(parts[k]))
        x = net.inputs(w)
        hint = np.where(index >= 0, x[index, 0] + x[index, 1] + x[index, 2], 0).clip(0).sum(0)
        order = np.lexsort((-hint, text))
        top = order[np.arange(len(order)) - np.searchsorted(text[order], text[order]) < 1]
        clean = rng.permutation(np.flatnonzero(label[text] == 0))[: len(label)]
        # A toxic text's other windows may be clean: only its first choice is told its label.
        chosen = np.r_[top, clean]
        views.append([w, net.odds, index, chosen, np.r_[label[text[top]], np.zeros(len(clean))].astype(np.float32), text, label])
    m, v, step = {k: np.zeros_like(q) for k, q in net.p.items()}, {k: np.zeros_like(q) for k, q in net.p.items()}, 0
    for epoch in range(epochs):
        for view in views if epoch and epoch % 2 == 0 else ():
            # What the network itself now finds most telling, in toxic and in clean texts.
            w, net.odds, index, chosen, target, text, label = view
            x = net.inputs(w)
            logit = np.concatenate([net.forward(x, index[:, at : at + 1024]) for at in range(0, index.shape[1], 1024)] or [np.zeros(0)])
            order = np.lexsort((-logit, text))
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            more = order[(rank < 1) | (rank < 4) & (label[text[order]] == 0)]
            view[3], view[4] = np.r_[chosen, more], np.r_[target, label[text[more]]].astype(np.float32)
        turns = [(k, b) for k, view in enumerate(views) for b in np.array_split(rng.permutation(len(view[3])), max(len(view[3]) // 128, 1))]
        for turn in rng.permutation(len(turns)):
            k, batch = turns[turn]
            w, net.odds, index, chosen, target = views[k][:5]
            used, at = np.unique(index[:, chosen[batch]], return_inverse=True)
            missing = int(used[0] < 0)
            few, tape = _subset(w, used[missing:]), {}
            x = net.inputs(few)
            logit = net.forward(x, at.reshape(WINDOW, -1) - missing, tape)
            d = ((1 / (1 + np.exp(-logit)) - target[batch]) / len(batch)).astype(np.float32)
            step += 1
            for name, g in net.backward(few, x, tape, d).items():
                g = g + 1e-4 * net.p[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.p[name] = (net.p[name] - 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.odds = _odds(seen)
    last = [t for t, own in zip(texts, use, strict=True) if own == 2]
    z = np.concatenate([best_logits(net, _from_texts(last[at : at + 128])) for at in range(0, len(last), 128)]).astype(float)
    ok = np.isfinite(z)
    slope, shift = _calibrate(z[ok], y[use == 2][ok], weight[use == 2][ok])
    return Model(net, slope, shift, prior)


def _spread(w: Words, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character-gram buckets of words and the text they stand in."""
    length = np.diff(np.r_[w.begin, len(w.gram)])[number]
    at = np.repeat(w.begin[number] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return w.gram[at], np.repeat(doc, length)


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit with a small ridge, by Newton steps."""
    theta, X = np.array([1.0, 0.0]), np.column_stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ theta, -30, 30)))
        g = X.T @ (weight * (p - y)) + 0.1 * (theta - [1, 0])
        H = (X * (weight * p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(H, g), -2, 2)
    return float(max(theta[0], 0.05)), float(theta[1])


_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _score(model: Model, modulus: int, held_out: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            score = _probability(model, part, threshold)
            rest = np.array([zlib.crc32(str(i).encode()) % modulus == held_out for i in part.ids.tolist()], bool)
            yield pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(rest), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _probability(model: Model, part: Slice, threshold: float) -> np.ndarray:
    z = best_logits(model.net, part).astype(float)
    ok = np.isfinite(z)
    return np.where(ok, 1 / (1 + np.exp(-np.clip(model.slope * np.where(ok, z, 0) + model.shift, -30, 30))), min(model.prior, threshold / 2))


def _filter(model: Model, threshold: float, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_probability(model, part, threshold) < threshold for part in slices([batch], 1 << 20, key, text)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return run


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.3, modulus: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that :func:`scores` does not predict to be toxic, all columns as they were; nothing is shuffled."""
    model = fit(*sample(docs, labels, label, modulus, held_out, per_class, key, text))
    return docs.mapInArrow(_filter(model, threshold, key, text), docs.schema)


def scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.3, modulus: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    Learns from at most ``per_class`` documents of each label whose crc32(id) mod ``modulus`` is not
    ``held_out`` (a documented bound; texts over 64 KiB are not learnt from), on the driver. The
    model (about 300 kB, a fixed size) scores every overlapping window of 32 words, 16 apart, of
    every whole text; a text's score is its worst window's. Null, empty and blank texts get the
    label's share, but not more than half the threshold. Without labels of both kinds all texts do.
    Rows that share a key are scored each for itself; a null key gets no result.
    """
    model = fit(*sample(docs, labels, label, modulus, held_out, per_class, key, text))
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return base.mapInArrow(_score(model, modulus, held_out, threshold), _SCHEMA)

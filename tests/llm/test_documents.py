"""Operators on documents against brute force on small fixtures."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlore.llm import decontaminate, graph, language_model, near_dedup, packing, quality, span_dedup, store, texts, token_file, tokens, toxicity
from boxlore.llm.queries import tokenizer_path
from boxlore.llm.tokens import Encoder
from boxlore.session import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, n bigint, id string, component string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=1, n=60):
    """Random texts, copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [text(rng.randint(1, 120)) for _ in range(n)]
    passage, base = text(60), text(80)
    for _ in range(12):
        out.append(text(rng.randint(0, 20)) + " " + passage + "\n" + text(rng.randint(0, 20)))
        some = base.split()
        for _ in range(rng.randint(0, 3)):
            some[rng.randrange(len(some))] = rng.choice(vocabulary)
        out.append(" ".join(some))
        out.append(base.upper() if rng.random() < 0.3 else base)
    out += [None, "", "  \t\n ", "a", "A", "one two three", "one two three", "x" * 3000, text(4000), "ab  cd\n\n e  f", "nul\0byte", "日本語 テキスト " * 20]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k], "en", None, "x", None) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def own(spark):
    with Scratch(spark) as scratch:
        yield scratch


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reach(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_groups(rows, percent):
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, reach(ids, links)


@pytest.mark.parametrize("percent,bands,per_band,chunk", [(85, 25, 5, 1024), (80, 32, 4, 3)])
def test_near_groups(docs, rows, own, percent, bands, per_band, chunk):
    got = {r.doc_id: r for r in near_dedup.groups(docs, own, percent, bands, per_band, chunk=chunk).collect()}
    sets, want = near_groups(rows, percent)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert len(set(want.values())) < len(want)


def test_near_keeps_columns_and_null_keys(spark, own):
    text = " ".join(map(str, range(30)))
    data = [(2, text, "l", 1, "i", "later"), (1, text, "l", 2, "i", "later"), (None, text, "l", 3, "i", None), (1, text, "l", 2, "i", "later")]
    frame = spark.createDataFrame(data, DOCS)
    left = near_dedup.keep_first(frame.withColumnRenamed("component", "later"), own).collect()
    assert sorted((r.doc_id or -1) for r in left) == [-1, 1, 1]
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "n", "id", "later"}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    doc = np.r_[np.zeros(600, int), np.ones(600, int), np.full(3, 2)]
    sig = near_dedup.super_minhash(doc, np.r_[h[:600], h[300:], h[:3]], 3, 256)
    assert abs((sig[0] == sig[1]).mean() - 300 / 900) < 0.08
    assert (sig[2] != 2**64 - 1).all()


def removed(rows, width=50):
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - width + 1):
            first.setdefault(raw[i][p : p + width], i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("part", [4 << 20, 300])
def test_span_dedup(docs, rows, part):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in span_dedup.remove_repeats(docs, part=part).collect()}
    want = removed(rows)
    assert got == {i: (n, g, s, hashlib.sha256(rest).hexdigest()) for i, (n, g, s, rest) in want.items()}
    assert sum(g > 0 for _, g, _, _ in want.values()) > 10


def test_span_dedup_deals_out_a_hot_trigger(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    grams = rng.choice(letters, (20000, 8))
    hashes = texts.mix(texts.window_hash(texts.prefix(grams.reshape(-1)), 8)[::8])
    hot = grams[hashes.argmin()].tobytes().decode()  # it is the trigger of every string around it
    data = [(i, "".join(rng.choice(letters, 20).tobytes().decode() + hot for _ in range(30)), None, None, None, None) for i in range(100)]
    data += [(100 + i, "x" + data[i][1][7:400], None, None, None, None) for i in range(40)]
    frame = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in span_dedup.remove_repeats(frame, part=4096).collect()}
    assert got == {i: (g, s) for i, (_, g, s, _) in removed(data).items()} and got[100][0] > 300
    unpack = store.unpack

    def sizes(parts, width):
        return lambda table: pa.table({"docs": [sum(len(unpack(b)[3]) for b in table["blob"].to_pylist())], "blob": [b""]})

    monkeypatch.setattr(span_dedup, "_decide", sizes)
    group = [r.docs for r in span_dedup._removed(frame.select("doc_id", "text"), 50, 4096)[0].collect()]
    assert max(group) < sum(group) / 5


def test_span_dedup_of_repeated_bytes(spark):
    data = [(3, "ab" * 100, None, None, None, None), (1, "ab" * 40, None, None, None, None), (2, "b" + "ab" * 30, None, None, None, None), (None, "ab" * 90, None, None, None, None)]
    frame = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in span_dedup.remove_repeats(frame).collect()}
    assert got == {i: (g, s) for i, (_, g, s, _) in removed(data[:3]).items()}
    rest = span_dedup.without_repeats(frame)
    assert rest.columns == frame.columns and rest.count() == 4 and rest.where("doc_id IS NULL").first().text == "ab" * 90


@pytest.mark.parametrize("layout", [1, 3, 8])
def test_language_model(spark, rows, own, layout):
    """The automaton one token at a time; the layout of the table changes nothing."""
    data = [*rows, (3, "again a text", "en", None, "x", None), (None, "a b", "en", None, "x", None)]
    docs = spark.createDataFrame(data, DOCS).repartition(layout)
    got = defaultdict(list)
    for r in language_model.scores(docs, own, part=2000).collect():
        got[r.doc_id].append(r)
    texts_ = [(r[0], [*words(r[1]), None]) for r in data if r[0] is not None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts_}
    c, pairs = Counter(), Counter()
    for i, t in texts_:
        if not held[i]:
            c.update(t)
            pairs.update(zip(["<"] + t, t, strict=False))
    total, distinct = sum(c.values()), len(c)
    state = {"<": c[None]} | {w: n for w, n in c.items() if w is not None}
    level = lambda h: "<" if h == "<" else state[h].bit_length()
    seen, fresh = Counter(), Counter()
    for h, n in state.items():
        seen[level(h)] += n
    for h, _ in pairs:
        fresh[level(h)] += 1
    left = {h: fresh[level(h)] / (seen[level(h)] + fresh[level(h)]) for h in state}
    for h in list(state)[:40]:  # what leaves a state is one
        known = [w for g, w in pairs if g == h]
        arcs = sum((1 - left[h]) * pairs[h, w] / state[h] + left[h] * (c[w] + 1) / (total + distinct + 1) for w in known)
        assert arcs + left[h] * (1 - sum((c[w] + 1) / (total + distinct + 1) for w in known)) == pytest.approx(1)
    want = defaultdict(list)
    for i, t in texts_:
        score, last = 0.0, "<"
        for w in t:
            root = (c[w] + 1) / (total + distinct + 1)
            out = left.get(last, 1.0)
            score += math.log10((1 - out) * pairs[last, w] / state[last] + out * root) if pairs[last, w] else math.log10(out * root)
            last = w
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        want[i].append((held[i], len(t), sum(c[w] > 0 for w in t), total, base, score))
    assert got.keys() == want.keys()
    for i, rows_ in want.items():
        for r, (*exact, base, score) in zip(sorted(got[i], key=lambda r: r.score), sorted(rows_, key=lambda r: r[-1]), strict=True):
            assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
            assert (r.base_score, r.score) == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))


def test_packing(docs, rows, own):
    got = packing.pack(docs, own, tokenizer_path(), size=64).collect()
    ids = dict(zip([r[0] for r in rows], Encoder(tokenizer_path()).encode([r[1] for r in rows], 1), strict=True))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        own_ids = ids[r.doc_id]
        assert r.doc_tokens == len(own_ids) and r.ids_crc32 == zlib.crc32(own_ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for i, own_ids in ids.items():
        assert sorted(x for s, n in pieces[i] for x in range(s, s + n)) == list(range(len(own_ids)))
    for w in windows.values():
        assert sorted(x for s, n in w for x in range(s, s + n)) == list(range(sum(n for _, n in w))) and sum(n for _, n in w) <= 64
    assert sum(sum(n for _, n in w) < 64 for w in windows.values()) <= 3  # one per task


def test_token_file(docs, rows, own):
    file = token_file.write(docs, own, tokenizer_path())
    got = token_file.digest(file).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(got, Encoder(tokenizer_path()).encode([r[1] for r in sorted(rows)], 2), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    record = file.first().record
    broken = bytearray(record)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_file.read_record(bytes(broken))


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 7000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**17 - 1, n), rng.integers(0, 3, n), np.tile(np.arange(300), 30)[:n], np.zeros(n, int)):
        assert (token_file.decode(token_file.encode(ids, 17), len(ids), 17) == ids).all()


@pytest.mark.parametrize("bits", [17, 20])
def test_range_coder_in_turns_of_lanes(monkeypatch, bits):
    rng = np.random.default_rng(bits)
    ids = np.concatenate([rng.zipf(1.3, 20_000) % (2**bits - 1), rng.integers(0, 2**bits - 1, 9_000), np.full(3_000, 2**bits - 2)])
    whole = token_file.encode(ids, bits)
    monkeypatch.setattr(token_file, "LANES", 3)  # blocks stand alone, however many are coded at a time
    assert token_file.encode(ids, bits) == whole
    assert (token_file.decode(whole, len(ids), bits) == ids).all()


def test_toxicity_reads_many_words_in_little_memory():
    rng = random.Random(3)
    part = toxicity._from_texts([" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(100)) for _ in range(2000)])
    tracemalloc.start()
    read = toxicity.read_words(part)
    rows = toxicity.Network().inputs(read)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(read.doc) == 200_000 and len(rows) == len(read.bucket)
    assert peak < 48 * len(part.buf)


def test_encoder_reads_runs_of_letters_once(monkeypatch):
    encode = Encoder(tokenizer_path())
    told, ids = [], Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, texts: told.extend(texts) or ids(self, texts))
    encode.encode(["a thonretion, a thonretion. (thonretion) thonretion's a\nthonretion; a thonretion!", "thonretion thonretion: a thonretion"])
    assert sum(x.count("thonretion") for x in told) == 2  # with and without a blank in front


def test_encoder_cuts_no_pretoken():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    rng = random.Random(5)
    parts = ["a", "Bc", "s", "ll", "'", ",", ".", "_", "(", "\n", "\n", "\t", "\r", "1", "23", " ", "é", "×", "÷", "Ñ", "ß", "…", "日", "\u0301", "\u00a0"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    got = Encoder(tokenizer_path()).encode(some)
    assert [x.tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids for x in some]


def test_encoder_equals_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    some = ["", "a", " a", "a b  c", "x\n y", "tab\tb \n\n c", "don't we'll", "é ñ ß", "日本 語", "a,b. c!! d", " lead", "trail ", "1 22 333", None, "  x y z"]
    some += ["a\u00a0 b", "x\u3000 y", "p\u2003 q\u202f r", "a\x1c b\x85 c", "é à ê ", "end\n", "end\u00a0", "a\u1680 b \u205f c", "<|endoftext|> a<|endoftext|> b", " ", "\n", "x" * 5000]
    rng = random.Random(2)
    some += ["".join(rng.choice(["a", "b", " ", " ", "é", "\n", "\u00a0", ".", "1", "日", "'s", "\u2009"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for memo, part in ((tokens.MEMO, tokens.PART), (20, 64)):
        monkeypatch.setattr(tokens, "MEMO", memo)
        monkeypatch.setattr(tokens, "PART", part)
        ours = Encoder(tokenizer_path())
        for got in (ours.encode(some, 7), ours.encode(pa.array(["x", *some])[1:], 7)):
            for text, ids in zip(some, got, strict=True):
                assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7]


def test_decontamination(spark, own):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, text(rng.randint(15, 50))) for i in range(8)] + [(8, ["tiny", "item"]), (9, [])]
    data, planted = [], set()
    for d in range(60):
        body = text(rng.randint(0, 150))
        if d % 3 == 0:
            i, passage = rng.choice(items[:9])
            passage = list(passage)
            if d % 2 and len(passage) > 40:
                passage[0] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage
            planted.add((d, i))
        data.append((d, " ".join(body).title() if d % 2 else " \n".join(body), None, None, None, None))
    data += [(60, None, None, None, None, None), (61, "", None, None, None, None), (None, " ".join(items[0][1]), None, None, None, None), (0, data[0][1], None, None, None, None)]
    frame = spark.createDataFrame(data, DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(10, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame, bench, own).collect()}
    by_item = [(i, w, Counter(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1))) for i, w in items if w]
    want = {}
    for d, t, *_ in data:
        w = words(t)
        for i, item, b in by_item:
            width = min(5, len(item))
            s = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            for start in range(len(s)):
                a = Counter(s[start : start + len(item) - width + 1])
                if not a.keys().isdisjoint(b):
                    j = sum((a & b).values()) / sum((a | b).values())
                    if j >= 0.8 and d is not None:
                        want[d, i] = max(j, want.get((d, i), 0))
    assert got.keys() == want.keys() and planted <= got.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    left = decontaminate.clean(frame.withColumnRenamed("component", "found"), bench, own)
    assert {r.doc_id for r in left.collect()} == {None, *range(1, 62)} - {d for d, _ in got}


def test_components_of_chains_and_stars(spark, own):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 7), (6001, 6000), (6000, 6001)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), own).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)} | {6000: 6000, 6001: 6000}


def labelled(spark, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for d in range(500):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        toxic, junk = d % 4 == 0, d % 5 == 0
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["grobzug", "grobnak", "grobber"]))
        text = " | ".join(body[:5] * 8) if junk and d % 2 else " ".join(w.upper() + "!!" for w in body) if junk else " ".join(body) + "."
        rows.append((d, text, None, None, None, None))
        labels.append((d, int(not junk), int(toxic)))
    odd = [(900, None, None, None, None, None), (901, "", None, None, None, None), (902, " \n", None, None, None, None), (903, "w " * 20000, None, None, None, None), (None, "x", None, None, None, None)]
    labels += [(900, 1, 0), (None, 1, 1), (1000, None, None), (0, 0, 1)]
    return spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("scores,label,modulus,rest,limit", [(toxicity.scores, "toxic", 4, 2, 0.3), (quality.scores, "quality", 3, 1, 0.5)])
def test_classifiers_on_held_out(spark, scores, label, modulus, rest, limit):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in scores(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert set(got) == {*range(500), 900, 901, 902, 903}
    right = []
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        if r.held_out and d < 500:
            right.append(r.predicted == truth[d])
    assert np.mean(right) > 0.93
    nothing = scores(docs, labels.limit(0)).collect()
    assert len(nothing) == len(got)


def test_toxic_rows_go_and_others_stay_whole(spark):
    docs, labels = labelled(spark)
    left = toxicity.keep_clean(docs, labels)
    bad = {r.doc_id for r in toxicity.scores(docs, labels).where("predicted = 1").collect()}
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} - {None} == {*range(500), 900, 901, 902, 903} - bad


def test_empty_tables(spark, own):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = tokenizer_path()
    for frame in (
        near_dedup.groups(none, own), near_dedup.keep_first(none, own), span_dedup.remove_repeats(none), span_dedup.without_repeats(none),
        language_model.scores(none, own), packing.pack(none, own, path), token_file.digest(token_file.write(none, own, path)),
        decontaminate.matches(none, bench, own), decontaminate.clean(none, bench, own), toxicity.scores(none, labels),
        toxicity.keep_clean(none, labels), quality.scores(none, labels),
    ):
        assert frame.count() == 0


def test_packed_arrays():
    arrays = [np.array([3, 1], np.int64), np.zeros(0, np.uint32), np.arange(9, dtype=np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, store.unpack(store.pack(*arrays)), strict=True))


def test_words_and_shingles_of_slices(rows):
    raw = [(r[1] or "").encode() for r in rows]
    part = texts.Slice(np.arange(len(raw)), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    low = part.lower()
    start, end, doc = texts.words(low, part.off)
    for i, r in enumerate(rows):
        assert [low[a:b].tobytes().decode() for a, b in zip(start[doc == i], end[doc == i], strict=True)] == words(r[1])
    d, h = texts.shingle_sets(part)
    assert np.bincount(d, minlength=len(rows)).tolist() == [len(shingles(r[1])) for r in rows]
    assert len(np.unique(h)) == len(set().union(*(shingles(r[1]) for r in rows)))


def test_fresh_names(spark):
    frame = spark.range(1).select(F.lit(1).alias("found"), F.lit(2).alias("_FOUND"))
    assert store.fresh_name(frame, "found") == "__found"


def test_strings_of_a_part_are_grouped_in_bounded_memory():
    """What a dictionary part needs beside its text and hashes does not grow with it."""
    import tracemalloc

    r = np.random.default_rng(7)
    length, doc = np.full(2000, 1500), np.arange(2000)
    text = r.integers(97, 123, 2000 * 1500).astype(np.uint8)
    text[1500 * 1990 : 1500 * 1990 + 200] = text[:200]
    tracemalloc.start()
    phrase, low, high = span_dedup._repeats(length, doc, text, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (phrase.tolist(), low.tolist(), high.tolist()) == ([1990], [0], [200])
    assert peak < 3_000_000 * 32  # the hashes alone are 8


def mixed_text(r, n):
    return "".join(r.choice(["a", "A", "7", " ", "\n", "é", "aa ", "a\n", " the cat", " the cat", "long" * r.randint(1, 9)]) for _ in range(n))


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 64, 1000])
def test_quality_terms_do_not_depend_on_stretches(monkeypatch, stretch):
    r = random.Random(3)
    some = [mixed_text(r, r.choice([0, 0, 1, 2, 10, 300])) for _ in range(60)] + ["", "x" * 500, "", "\n" * 70, " " * 70, "ab\n" * 90, "", "é"]
    part = toxicity._from_texts(some)
    monkeypatch.setattr(quality, "STRETCH", 1 << 30)
    whole = quality.terms(part)
    monkeypatch.setattr(quality, "STRETCH", stretch)
    assert (quality.terms(part) == whole).all()


@pytest.mark.parametrize("kind", ["one long text", "many short texts"])
def test_quality_scores_in_bounded_memory(kind):
    """Neither the length of a text nor the number of texts in a batch adds to what scoring holds at once."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(4)
    few = [mixed_text(r, 100) for _ in range(60)]
    model = quality.fit(few, np.arange(60) % 2 * 1.0, np.ones(60))
    some = ["the cat sat on the mat\n" * 200_000] if kind == "one long text" else ["ab c."] * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in quality._score(model, 3, 1, 0.5)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(some)
    assert peak < 64 << 20


def test_stored_quality_scores_are_those_of_the_plan(spark, own):
    docs, labels = labelled(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lazy = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    kept = {r.doc_id: r for r in quality.scores(docs, labels, own=own).collect()}
    assert kept.keys() == lazy.keys() and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert all((k.held_out, k.predicted, k.score) == (lazy[d].held_out, lazy[d].predicted, pytest.approx(lazy[d].score)) for d, k in kept.items())

"""Phrase mining against counting everything in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from boxlore.llm import phrases
from boxlore.session import Scratch
from tests.llm.test_documents import LOWER

SCHEMA = "doc_id bigint, text string, lang string, phrase string, k int, shard string"


@pytest.fixture
def own(spark):
    with Scratch(spark) as scratch:
        yield scratch


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "a", "é", "日本", "x-y", "\\n"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(20)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["new", "york", "city"], ["New", "York"], ["a", "a", "a", "a", "a"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; "]) for w in words)
        out.append((rng.choice([i, i, 3, None]), text, rng.choice(["en", "en", "de", None, "und"]), "p", 1, "s"))
    long = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    return out + [(900, None, "en", None, None, None), (901, "", None, None, None, None), (902, " \t ", "xx", None, None, None), (903, "one", "yy", None, None, None), (904, long, "en", None, None, None), (905, "a" * 5000, "en", None, None, None)]


def expected(rows, support, longest, top, cover):
    count, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    outer = defaultdict(int)
    for (lang, w), f in count.items():
        if f >= support:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    outer[lang, w[i : i + m]] = max(outer[lang, w[i : i + m]], f)
    found = defaultdict(list)
    for (lang, w), a in count.items():
        if len(w) >= 2 and a >= support and 100 * outer[lang, w] < cover * a:
            score, k = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("support,longest,top,cover,how", [
    (30, 4, 2000, 80, {}),
    (7, 4, 2000, 80, {"shards": 16, "unit": 500, "held": 3000, "distinct": 200}),
    (1, 3, 40, 100, {"shards": 3, "unit": 100}),
    (12, 5, 2000, 50, {"shards": 1, "distinct": 1}),
])
def test_collocations(spark, own, support, longest, top, cover, how):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = phrases.collocations(docs, own, support, longest, top, cover, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected(rows, support, longest, top, cover)
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def test_no_words(spark, own):
    docs = spark.createDataFrame([(1, None, "en", "", 1, ""), (2, ".", None, "", 1, "")], SCHEMA)
    assert phrases.collocations(docs, own).count() == 0 and phrases.collocations(docs.limit(0), own).count() == 0


def test_a_full_filter_only_costs_time(spark, own, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1024)
    rows = corpus(5, 60)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), own, 3)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 3, 4, 2000, 80)


def test_arithmetic_beyond_64_bits(spark):
    big = 9 * 10**18
    found = spark.createDataFrame([("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)], "lang string, phrase string, k int, f bigint")
    assert [tuple(r) for r in phrases.rank(found).collect()] == [("en", 1, "a b", big - 3, big, big - 1, big, 2_000_000 * (big - 3) // (2 * big - 1))]

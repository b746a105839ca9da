"""The prefix trie against a dictionary of prefixes, and balanced parentheses against a stack."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from boxlore.llm import prefix_trie
from boxlore.session import Scratch

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture
def own(spark):
    with Scratch(spark) as scratch:
        yield scratch


def conversations(seed=1, n=120):
    rng = random.Random(seed)
    say = ["hello", "a", "é" * 7, "", None, "b c", "12:user"]
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        turns = [(rng.choice(["user", "user", None]), rng.choice(say)) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            turns = [("user", "hello")] * rng.randint(1, 10)
        rows += [(c, None if k == 0 and rng.random() < 0.2 else k * 3, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(1000 + 5 * i, k, "user", "hello") for i in range(40) for k in range(9)]  # copies, all of one length
    rows += [(2001, k, "user", f"turn {k % 3}") for k in range(700)]  # a long one
    rows += [(c, 0, "x", "y") for c in (10**12 + 1, 10**12 + 3)] + [(None, 0, "x", "y"), (None, 1, "x", "y")]
    rng.shuffle(rows)
    return [(*r, "p", 1) for r in rows]


def expected(rows):
    told = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, told(role, text), role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((w[0], len(p), members[p[:-1]][0] if p else None, len(w), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, w in members.items())


@pytest.mark.parametrize("shard", [250_000, 60, 1])
def test_nodes(spark, own, shard):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.nodes(prefix_trie.rebuild(frame), own, shard)
    want = expected(rows)
    assert got.columns == COLUMNS and len(want) > 300
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [
    [],
    [(None, 1, "a", "b")],
    [(7, None, None, None)],
    [(9, 0, "u", "only")],  # h is 8 for 9: it keeps no turn of its own and its base is absent
    [(c, 0, "u", "t") for c in range(30)],
    [(c, 0, "u", "t") for c in range(5, 10)] * 2,
])
def test_small_tables(spark, own, rows):
    rows = [(*r, None, None) for r in rows]
    got = prefix_trie.nodes(prefix_trie.rebuild(spark.createDataFrame(rows, SCHEMA)), own)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected(rows), key=str)


def test_turnless_conversations_end_at_the_root(spark, own):
    turnless = next(c for c in range(6, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(turnless, 0, "u", "t", None, None)]
    (root,) = prefix_trie.nodes(prefix_trie.rebuild(spark.createDataFrame(rows, SCHEMA)), own).collect()
    assert tuple(root) == (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_parentheses(kind):
    rng = random.Random(kind)
    bits, depth = [True], 1
    if kind == "chain":
        bits, depth = [True] * 3000, 3000
    while len(bits) < 6000 and depth and kind != "chain":
        up = depth == 1 or (rng.random() < 0.55 if kind == "random" else depth < 2)
        bits.append(up)
        depth += 1 if up else -1
    bits += [False] * depth
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = prefix_trie.Parentheses(np.array(bits))
    opens = np.flatnonzero(tree.bits)
    assert dict(zip(opens.tolist(), tree.find_close(opens).tolist(), strict=True)) == want

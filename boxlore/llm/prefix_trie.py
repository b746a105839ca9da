"""Prefix trie of conversations: what shared openings save.

Conversations are sorted by the sequence of their turns and cut into shards of bounded size, so
neighbours share prefixes. A shard writes its trie as balanced parentheses, an opening one per
node in preorder. Blocks of the running excess with their least and greatest value, in a binary
tree, find each closing parenthesis; what lies between is the node's subtree. Pairs ``()`` counted
up to both ends give its leaves, and cumulative arrays over preorder its members and savings.

Only nodes on a shard's first or last path can go on in another shard. These two spines leave
the shard as one row each; one more trie, over the spines alone, merges them: two rows a shard,
whatever their conversations hold. A prefix that very many conversations share is just a node on
many spines, and copies of one conversation are cut between shards like any others.

Definitions. Turns are ordered by number, null first; equal numbers by the MD5 of role and text,
which also tells turns apart. Null roles and texts are empty. Rows without a conversation id belong
to no conversation. All turns of one conversation are one row (24 bytes a turn). An empty table
has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.llm.store import gaps, pack, unpack
from boxlore.llm.texts import ranges
from boxlore.session import Scratch

SHARD = 250_000  # turns and conversations of a shard, about
_BLOCK = 64
_FAR = np.iinfo(np.int64).max
_NOBODY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A tree as balanced parentheses (True opens), with blocks of excess to search by."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        n = -(-len(bits) // _BLOCK)
        padded = np.concatenate([self.excess, np.full(n * _BLOCK - len(bits), self.excess[-1] + _BLOCK if len(bits) else 0)])
        self._blocks = padded.reshape(n, _BLOCK)
        self._base = base = 1 << max(0, (n - 1).bit_length())
        self._least, self._most = np.full(2 * base, _FAR), np.full(2 * base, -_FAR)
        self._least[base : base + n], self._most[base : base + n] = self._blocks.min(1), self._blocks.max(1)
        while base > 1:
            half = base // 2
            self._least[half:base] = self._least[base : 2 * base].reshape(half, 2).min(1)
            self._most[half:base] = self._most[base : 2 * base].reshape(half, 2).max(1)
            base = half

    def _in_block(self, block: np.ndarray, after: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place of each block behind ``after`` whose excess is ``want``, or -1."""
        out = np.full(len(block), -1)
        for at in range(0, len(block), 1 << 16):
            cut = slice(at, at + (1 << 16))
            hit = (self._blocks[block[cut]] == want[cut, None]) & (np.arange(_BLOCK) > after[cut, None])
            out[cut] = np.where(hit.any(1), hit.argmax(1), -1)
        return out

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        want = self.excess[opens] - 1
        block = opens // _BLOCK
        place = self._in_block(block, opens % _BLOCK, want)
        out = np.where(place >= 0, block * _BLOCK + place, -1)
        left = np.flatnonzero(place < 0)
        want, node = want[left], block[left] + self._base
        holds = lambda x, w: (self._least[x] <= w) & (w <= self._most[x])
        climbing = np.ones(len(left), bool)
        while climbing.any():  # up, until the subtree to the right holds the excess
            right = np.where(climbing & (node % 2 == 0), node + 1, 0)
            found = climbing & (right > 0) & holds(right, want)
            node = np.where(found, right, np.where(climbing, node // 2, node))
            climbing &= ~found
        while True:  # down to the first block that holds it
            inner = node < self._base
            if not inner.any():
                break
            child = 2 * np.where(inner, node, 0)
            node = np.where(inner, np.where(holds(child, want), child, child + 1), node)
        block = node - self._base
        out[left] = block * _BLOCK + self._in_block(block, np.full(len(left), -1), want)
        return out

    def leaf_pairs(self) -> np.ndarray:
        """How many pairs ``()`` open before each place."""
        pair = np.zeros(len(self.bits) + 1, np.int64)
        pair[1:-1] = self.bits[:-1] & ~self.bits[1:]
        return np.cumsum(pair)


class Trie:
    """The trie of sorted paths. Nodes are numbered in preorder, the root is 0."""

    def __init__(self, length: np.ndarray, turns: np.ndarray):
        """``length``: turns of each path; ``turns``: (high, low) digests of all, one after another."""
        off = np.cumsum(length) - length
        common = np.minimum(length[1:], length[:-1])
        a, b = ranges(off[:-1], common), ranges(off[1:], common)
        other = np.flatnonzero((turns[a] != turns[b]).any(1))
        first = np.cumsum(common) - common
        nearest = np.concatenate([other, [len(a)]])[np.searchsorted(other, first)]
        self.shared = np.concatenate([[0], np.minimum(nearest - first, common)]).astype(np.int64)
        new = length - self.shared
        closed = np.concatenate([[0], length[:-1] - self.shared[1:]])
        runs = np.concatenate([[1], np.stack([closed, new], 1).reshape(-1), [length[-1] + 1]])
        bits = np.repeat(np.concatenate([[True], np.tile([False, True], len(length)), [False]]), runs)
        self.tree = Parentheses(bits)
        opens = np.flatnonzero(bits)
        closes = self.tree.find_close(opens)
        self.size = (closes - opens + 1) // 2
        pairs = self.tree.leaf_pairs()
        self.leaves = pairs[closes + 1] - pairs[opens]
        self.depth = self.tree.excess[opens] - 1
        self.end = np.cumsum(new)  # the node where each path ends
        # Where a node's last turn stands in ``turns``; the root has none.
        self.turn = ranges(off + self.shared, new)
        # A node's parent is the last node before it that is one less deep.
        n = len(opens)
        key = self.depth * n + np.arange(n)
        order = np.argsort(key)
        self.parent = order[np.searchsorted(key[order], (self.depth - 1) * n + np.arange(n)) - 1]
        self.parent[0] = -1

    def __len__(self) -> int:
        return len(self.size)

    def under(self, x: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = np.concatenate([[0], np.cumsum(x)])
        first = np.arange(len(self))
        return total[first + self.size] - total[first]

    def least_under(self, x: np.ndarray) -> np.ndarray:
        """Minima over subtrees: of two powers of two that overlap."""
        first, out = np.arange(len(self)), np.empty(len(self), np.int64)
        level = np.frompyfunc(lambda s: int(s).bit_length() - 1, 1, 1)(self.size).astype(np.int64)
        step = x
        for k in range(int(level.max()) + 1):
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(step[first[here]], step[first[here] + self.size[here] - (1 << k)])
            step = np.minimum(step[: -(1 << k)], step[1 << k :]) if len(step) > 1 << k else step
        return out


def rebuild(conversations: DataFrame, groups_of: int = 5, heads: int = 9) -> DataFrame:
    """``conv_id, path, sizes``: digests of the turns of every rebuilt conversation, and their texts' bytes.

    Conversation c takes the first h turns of conversation c - c % ``groups_of`` and its own from
    there on; h is the CRC-32 of c in decimal modulo ``heads``.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    told = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select((F.col("conv_id") - F.col("conv_id") % groups_of).alias("base"), "conv_id", F.struct("turn", told.alias("d"), F.octet_length(text).cast("bigint").alias("b")).alias("t"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = own.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.join(head, "base", "left").withColumn("h", h)
    path = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return both.select("conv_id", path.alias("path")).select(
        "conv_id", F.unhex(F.array_join(F.transform("path", lambda x: x["d"]), "")).alias("path"), F.transform("path", lambda x: x["b"]).alias("sizes")
    )


_SHARD = "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, path binary, blob binary"
_NODES = ["conv_id", "depth", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    n = len(next(iter(columns.values())))
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    made = (columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], _ARROW[k]) if c in columns else pa.nulls(n, _ARROW[k]) for c, k in zip(names, kinds, strict=True))
    return pa.RecordBatch.from_arrays(list(made), names=list(names))


def _digests(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _keys(path: bytes) -> list[bytes]:
    """A name of 16 bytes for each prefix of a path, the empty one first."""
    out = [hashlib.md5(b"").digest()]
    for at in range(0, len(path), 16):
        out.append(hashlib.md5(out[-1] + path[at : at + 16]).digest())
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a run of sorted conversations: whole ones, spines, and who ends on a spine."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some).combine_chunks()
    ids = table.column("conv_id").to_numpy()
    paths = table.column("path").to_pylist()
    sizes = table.column("sizes").combine_chunks()
    size = sizes.flatten().to_numpy(zero_copy_only=False)
    del some, table
    trie = Trie(np.array([len(p) // 16 for p in paths]), _digests(b"".join(paths)))
    n = len(trie)
    weight = np.concatenate([[0], size[trie.turn]])
    ends = np.bincount(trie.end, minlength=n)
    least = np.full(n, _FAR)
    np.minimum.at(least, trie.end, ids)
    members, smallest = trie.under(ends), trie.least_under(least)
    saved = trie.under((members - 1) * weight)
    children = np.bincount(trie.parent[1:], minlength=n)

    number, last = np.arange(n), trie.end[-1]
    left = number <= trie.end[0]
    right = (number <= last) & (last < number + trie.size)
    spine = left | right
    inner = np.flatnonzero(~spine)
    first = np.flatnonzero(np.concatenate([[True], trie.end[1:] != trie.end[:-1]]))
    who = dict(zip(trie.end[first].tolist(), np.split(ids, first[1:]), strict=True))
    names = dict(zip(np.flatnonzero(left).tolist(), _keys(paths[0]), strict=True)) | dict(zip(np.flatnonzero(right).tolist(), _keys(paths[-1]), strict=True))

    if len(inner):
        up = trie.parent[inner]
        on = spine[up]
        sums = [hashlib.sha256(",".join(map(str, who[k].tolist())).encode()).hexdigest() if k in who else _NOBODY for k in inner.tolist()]
        yield _batch(
            _SHARD, kind=np.zeros(len(inner), np.int32), conv_id=smallest[inner], depth=trie.depth[inner], parent_conv_id=pa.array(smallest[up], mask=on),
            parent_key=[names[u] if s else None for u, s in zip(up.tolist(), on.tolist(), strict=True)],
            n_convs=members[inner], n_children=children[inner], n_leaves=trie.leaves[inner], saved_tokens=saved[inner], ends_sha256=sums,
        )

    # What hangs on each spine node and is no spine itself, added to the node's own part.
    top = inner[spine[trie.parent[inner]]]
    hook = trie.parent[top]

    def hanging(x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(n, np.int64) if start is None else start.astype(np.int64)
        np.add.at(out, hook, x[top])
        return out

    near = least.copy()
    np.minimum.at(near, hook, smallest[top])
    parts = [hanging(members, ends), hanging(np.ones(n, np.int64)), hanging(trie.leaves), hanging(saved)]
    rows = []
    for path, on in ((paths[0], left), (paths[-1], right))[: 1 if last == trie.end[0] else 2]:
        at = np.flatnonzero(on)
        told = left[at] if rows else np.zeros(len(at), bool)  # by the other spine
        rows.append((path, pack(weight[at], np.where(told, _FAR, near[at]), *(np.where(told, 0, x[at]) for x in parts))))
    yield _batch(_SHARD, kind=[1] * len(rows), path=[p for p, _ in rows], blob=[b for _, b in rows])
    held = [(names[k], who[k]) for k in np.flatnonzero(spine).tolist() if k in who]
    if held:
        yield _batch(_SHARD, kind=[2] * len(held), key=[k for k, _ in held], conv_id=[int(x[0]) for _, x in held], blob=[pack(gaps(x)) for _, x in held])


_SPINE = "key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spines' nodes, each once: a trie over the spines, with what hangs on them added up."""
    rows = sorted((p, b) for batch in batches for p, b in zip(batch.column("path").to_pylist(), batch.column("blob").to_pylist(), strict=True))
    if not rows:
        return
    trie = Trie(np.array([len(p) // 16 for p, _ in rows]), _digests(b"".join(p for p, _ in rows)))
    n = len(trie)
    weight, members, children, leaves, saved = sums = [np.zeros(n, np.int64) for _ in range(5)]
    least = np.full(n, _FAR)
    names: list[bytes] = [b""] * n
    path = np.zeros(1, np.int64)
    for (raw, blob), shared, end in zip(rows, trie.shared.tolist(), trie.end.tolist(), strict=True):
        path = np.concatenate([path[: shared + 1], np.arange(end - len(raw) // 16 + shared, end) + 1])
        weight[path], near, *parts = unpack(blob)
        least[path] = np.minimum(least[path], near)
        for total, x in zip(sums[1:], parts, strict=True):
            total[path] += x
        for k, name in zip(path.tolist(), _keys(raw), strict=True):
            names[k] = name
    children += np.bincount(trie.parent[1:], minlength=n)
    members = trie.under(members)
    smallest = trie.least_under(least)
    up = trie.parent
    yield _batch(
        _SPINE, key=names, conv_id=smallest, depth=trie.depth, parent_conv_id=pa.array(smallest[up], mask=up < 0), n_convs=members, n_children=children,
        n_leaves=trie.under(leaves + (children == 0)), saved_tokens=trie.under(saved + (members - 1) * weight),
    )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each spine node's ids, from its shards' runs in order; one run is held at a time."""
    key, sha = None, None
    for batch in batches:
        done = []
        for k, blob in zip(batch.column("key").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            text = ",".join(map(str, np.cumsum(unpack(blob)[0]).tolist()))
            if k == key:
                sha.update(f",{text}".encode())
            else:
                if sha:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
        if done:
            yield _batch("key binary, ends_sha256 string", key=[k for k, _ in done], ends_sha256=[s for _, s in done])
    if sha:
        yield _batch("key binary, ends_sha256 string", key=[key], ends_sha256=[sha.hexdigest()])


def nodes(rebuilt: DataFrame, own: Scratch, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``conv_id, path, sizes`` as :func:`rebuild` makes them.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes of texts that members share with the smallest one, over
    the subtree), ``ends_sha256`` (of the ids of conversations that end there).
    """
    rebuilt = own.keep(rebuilt)
    total = rebuilt.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard))
    ordered = rebuilt.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = own.keep(ordered.mapInArrow(_shard, _SHARD))
    spine = own.keep(found.where("kind = 1").select("path", "blob").repartition(1).mapInArrow(_merge, _SPINE))
    sums = found.where("kind = 2").select("key", "conv_id", "blob").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_sums, "key binary, ends_sha256 string")
    spines = spine.join(sums, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY)))
    inner = found.where("kind = 0").select(_NODES)
    hung = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    columns = [c for c in _NODES if c != "parent_key"]
    return inner.where("parent_key IS NULL").select(columns).unionByName(hung.select(columns)).unionByName(spines.select(columns))

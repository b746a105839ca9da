"""Sharding by virtual slots against plain Python."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxlore.llm import sharding
from boxlore.session import Scratch
from tests.llm.test_documents import DOCS, corpus


@pytest.fixture
def own(spark):
    with Scratch(spark) as scratch:
        yield scratch


def edited(current, held, shards):
    """The edit by definition: current {slot: shard}, held {slot: bytes}."""
    total, out, load, left = sum(held.values()), {}, [0] * shards, []
    for shard in set(current.values()):
        running = 0
        for slot in sorted((s for s in current if current[s] == shard), key=lambda s: (-held.get(s, 0), s)):
            running += held.get(slot, 0)
            if shard < shards and running * shards <= total:
                out[slot], load[shard] = shard, load[shard] + held.get(slot, 0)
            else:
                left.append(slot)
    for slot in sorted(left, key=lambda s: (-held.get(s, 0), s)):
        shard = load.index(min(load))
        out[slot], load[shard] = shard, load[shard] + held.get(slot, 0)
    return out


def as_map(frame):
    rows = frame.collect()
    assert len({r.version for r in rows}) <= 1 and len({r.vslot for r in rows}) == len(rows)
    return {r.vslot: r.shard for r in rows}


def test_edits_follow_the_definition(spark, own):
    held = {s: (s * 7919) % 1000 if s % 5 else 0 for s in range(64)} | {7: 20_000}
    load = spark.createDataFrame([(s, 1, b) for s, b in held.items() if b], "vslot int, n_rows bigint, bytes bigint")
    one = sharding.first_map(spark, 5, 64)
    now = as_map(one)
    for shards in (5, 6, 4):
        one = own.keep(sharding.edit(one, load, shards))
        want = edited(now, held, shards)
        now = as_map(one)
        assert now == want and set(now.values()) <= set(range(shards)) and len(now) == 64
    assert one.first().version == 4
    again = as_map(sharding.edit(one, load, 4))
    assert sum(again[s] != now[s] for s in now) <= sum(edited(now, held, 4)[s] != now[s] for s in now)
    empty = sharding.edit(sharding.first_map(spark, 3, 16), load.limit(0), 3)
    assert as_map(empty) == {s: s % 3 for s in range(16)}


def test_growing_moves_a_share(spark, own):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") * 37 % 200).cast("int")).alias("text"))
    rows = sharding.slotted(docs, own, slots=512)
    load = own.keep(sharding.loads(rows))
    before = own.keep(sharding.edit(sharding.first_map(spark, 9, 512), load, 9))
    after = own.keep(sharding.edit(before, load, 10))
    moved = before.alias("a").join(after.alias("b"), "vslot").where("a.shard <> b.shard").join(load, "vslot")
    assert moved.agg(F.sum("bytes")).first()[0] < 0.13 * load.agg(F.sum("bytes")).first()[0]


def test_every_row_has_its_place(spark, own):
    data = corpus() + [(5, "same", None, 1, "x", None)] * 300 + [(None, t, None, 1, "x", None) for t in ("a", "a", None, "b")] + [(5, "other", None, 1, "x", None)]
    docs = spark.createDataFrame(data, DOCS).repartition(5)
    got = sharding.shard_by_bytes(docs, own, 7, slots=128).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in data), key=str)
    assert sorted(((r.key, r["size"], r.crc) for r in got), key=str) == want
    places, held, shard = defaultdict(list), defaultdict(int), {}
    for r in got:
        places[r.shard].append(r.place)
        held[r.vslot] += r["size"]
        assert shard.setdefault(r.vslot, r.shard) == r.shard and r.version == 2
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert shard.items() <= edited({s: s % 7 for s in range(128)}, held, 7).items()
    assert len({r.vslot for r in got if r.key == 5 and r["size"] == 12}) > 1  # a pile of copies is dealt out
    again = sharding.shard_by_bytes(docs.repartition(2), own, 7, slots=128).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_by_bytes(docs.limit(0), own, 7).count() == 0


def test_sizes_are_near_equal(spark, own):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 3 == 0, 5).otherwise((F.col("id") * 91 % 700).cast("int"))).alias("text"))
    size = [r.b for r in sharding.shard_by_bytes(docs, own, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 24 and max(size) - min(size) < 1000


def test_maps_and_shards_are_files(spark, own, tmp_path):
    docs = spark.createDataFrame([(i % 50, "t" * (i % 40), i, i) for i in range(200)] + [(1, "copy", 9, 9)] * 200, "doc_id bigint, text string, shard int, vslot int")
    first = sharding.first_map(spark, 3, 32)
    second = own.keep(sharding.edit(first, sharding.loads(sharding.slotted(docs, own, slots=32)), 3))
    sharding.save(first, f"{tmp_path}/map")
    sharding.save(second, f"{tmp_path}/map")
    assert as_map(sharding.load_map(spark, f"{tmp_path}/map")) == as_map(second)
    assert as_map(sharding.load_map(spark, f"{tmp_path}/map", 1)) == as_map(first)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save(second, f"{tmp_path}/map")
    sharding.write_shards(docs, second, f"{tmp_path}/out", slots=32)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    at = as_map(second)
    assert all(at[r._vslot] == r._shard for r in back.collect())

"""Shards by fixed virtual slots: records are hashed into slots, a stored map says where slots lie.

DataFrame functions only. A record's virtual slot never changes; only the map from slots to
shards does, and every edit of it is a new version. The map is edited by the bytes that each slot
holds: a shard keeps its slots, heaviest first, up to a fair share, and what is left over goes,
heaviest first, to the shard with the least bytes. So balancing, growing and shrinking are one
operation, and only slots that have to move do. All decisions are made on the table of slots
(thousands of rows, whatever the input); of a document only its key, size and checksum are moved.

Definitions. A record is told by its key, its size and the CRC-32 of its text; a null text is
empty, a null key is a key like any other. Equal rows are counted before they are shuffled, and
every :data:`LOT` copies of a record are hashed apart, so that neither a hot key nor a pile of
copies makes a slot heavy. Within a shard rows stand by virtual slot, key, size, checksum.
An empty table has no rows and a map with no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlore.session import Scratch

SLOTS = 8192
LOT = 64
OVERHEAD = 8  # bytes of a row besides its text


def virtual_slot(*of: str, slots: int = SLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, crc, lot, copies`` of a table of documents: its rows, without their texts."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("crc"))
    counted = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    lots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / LOT)))
    return counted.withColumn("lot", lots).select("key", "size", "crc", "lot", F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("bigint").alias("copies"))


def loads(rows: DataFrame) -> DataFrame:
    """``vslot, n_rows, bytes`` of records that carry a ``vslot``."""
    return rows.groupBy("vslot").agg(F.sum("copies").alias("n_rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map, made before anything is known of the records: slots in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def edit(current: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for ``shards`` shards and the bytes that slots hold now.

    Ties go to the smaller slot and to the smaller shard; a slot without bytes stays, unless its
    shard is gone.
    """
    slot = current.join(load.select("vslot", "bytes"), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint")))
    heaviest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("bytes").over(Window.partitionBy("version"))
    slot = slot.withColumn("stays", (F.col("shard") < shards) & (F.sum("bytes").over(heaviest) * shards <= total))
    # Both sides of the next line are one row: as many numbers as there are slots, or shards.
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("bigint"), lambda a, k: a + k["bytes"]))
    one = slot.agg(
        F.max("version").alias("version"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("left"),
        F.collect_list(F.when(F.col("stays"), F.struct("vslot", "shard", "bytes"))).alias("kept"),
    ).withColumn("held", held)
    least = lambda s: F.array_position(s["held"], F.array_min(s["held"])) - 1
    start = F.struct(F.col("held"), F.expr("CAST(array() AS array<struct<vslot:int,shard:int>>)").alias("picks"))
    dealt = F.aggregate(
        "left", start,
        lambda s, x: F.struct(
            F.transform(s["held"], lambda b, i: F.when(i == least(s), b - x["less"]).otherwise(b)).alias("held"),
            F.concat(s["picks"], F.array(F.struct(x["vslot"].alias("vslot"), least(s).cast("int").alias("shard")))).alias("picks"),
        ),
        lambda s: s["picks"],
    )
    kept = F.transform("kept", lambda k: F.struct(k["vslot"].alias("vslot"), k["shard"].alias("shard")))
    placed = one.select((F.col("version") + 1).alias("version"), F.explode(F.concat(kept, dealt)).alias("at"))
    return placed.select("version", "at.vslot", "at.shard")


def save(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored map; a version that is there already is an error, never replaced."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of a map, the newest if none is named."""
    stored = spark.read.parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "vslot", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """One row per document: ``key, size, crc, vslot, version, shard, place``.

    ``place`` counts from 0 in every shard. It is the sum of the rows of the shard's slots before,
    and of the rows before in the slot, so no task ever sorts a whole shard.
    """
    count = rows.groupBy("vslot").agg(F.sum("copies").alias("n_rows"))
    slot = slot_map.join(count, "vslot")
    slot = slot.withColumn("first", F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n_rows")).drop("n_rows")
    before = Window.partitionBy("vslot").orderBy("key", "size", "crc", "lot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # At most as many rows as there are slots.
    placed = ranked.join(F.broadcast(slot), "vslot")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
    return placed.select("key", "size", "crc", "vslot", "version", "shard", (F.col("first") + F.col("rank")).alias("start"), copy).select(
        "key", "size", "crc", "vslot", "version", "shard", (F.col("start") + F.col("copy")).alias("place")
    )


def slotted(docs: DataFrame, own: Scratch, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """:func:`records` with their virtual slots, kept as a table: the texts are read once."""
    return own.keep(records(docs, key, text).withColumn("vslot", virtual_slot("key", "size", "crc", "lot", slots=slots)))


def write_shards(docs: DataFrame, slot_map: DataFrame, folder: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Whole documents as Parquet files, one folder per shard of ``slot_map``, rows by virtual slot.

    Copies of a record beyond its first lot are dealt to lots by their place in the input.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    taken = {c.lower() for c in docs.columns}
    name = lambda x: x if x not in taken else name(f"_{x}")
    k, size, crc, lot, at, shard = (name(x) for x in ("key_", "size_", "crc_", "lot_", "vslot", "shard"))
    rows = docs.withColumn(k, F.col(key)).withColumn(size, (F.octet_length(raw) + OVERHEAD).cast("bigint")).withColumn(crc, F.crc32(raw))
    piles = rows.groupBy(k, size, crc).agg(F.count("*").alias("n")).where(F.col("n") > LOT).select(*(F.col(c).alias(f"{c}p") for c in (k, size, crc)), F.ceil(F.col("n") / LOT).alias(name("lots_")))
    rows = rows.join(piles, F.col(k).eqNullSafe(F.col(f"{k}p")) & (F.col(size) == F.col(f"{size}p")) & (F.col(crc) == F.col(f"{crc}p")), "left")
    rows = rows.withColumn(lot, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(name("lots_"))), F.lit(0)).cast("bigint"))
    rows = rows.withColumn(at, virtual_slot(k, size, crc, lot, slots=slots)).join(F.broadcast(slot_map.select(F.col("vslot").alias(at), F.col("shard").alias(shard))), at)
    part = F.pmod(F.hash(at), F.lit(files_per_shard))
    rows.select(*docs.columns, at, shard).repartition(shard, part).sortWithinPartitions(shard, at, key).write.partitionBy(shard).parquet(folder)


def shard_by_bytes(docs: DataFrame, own: Scratch, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """:func:`place` of all documents under a map whose first version is edited by their bytes."""
    rows = slotted(docs, own, key, text, slots)
    slot_map = own.keep(edit(first_map(docs.sparkSession, shards, slots), loads(rows), shards))
    return place(rows, slot_map)

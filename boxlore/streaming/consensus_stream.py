"""Resumable vote consensus on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlore import schemas
from boxlore.operators.consensus import vote_consensus

STORED = "ann_id bigint, voter int, vote boolean, at timestamp, file string, row bigint, batch_id bigint"
_ORDER = ("at", "file", "row")
ROWS = 250_000  # votes a task sorts
FAN = 8  # parts of one level that are merged into one of the next
_LEVEL = 10**12  # parts of batches are numbered from 0, merged ones from -_LEVEL downwards


def incremental_consensus(spark: SparkSession, votes_dir: str, results_dir: str, checkpoint_dir: str, files_per_batch: int = 10) -> int:
    """Take up all vote files that have arrived, then stop; call again to go on.

    The state is one vote per annotation and voter and batch, in a folder per batch that a replay
    of the batch overwrites. A batch only writes its own votes; :func:`compact` merges parts as
    they become many. :func:`results` decides from all of them, the last vote of a voter counts, so
    neither batch size, order of arrival nor a restart changes the answer. Returns the number of
    batches this call ran.
    """
    ran = []

    def store(batch: DataFrame, batch_id: int) -> None:
        last = _last(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        last.write.mode("overwrite").parquet(f"{results_dir}/part={batch_id}")
        ran.append(batch_id)

    votes = spark.readStream.schema(schemas.VOTE).option("maxFilesPerTrigger", files_per_batch).parquet(votes_dir)
    placed = votes.select(
        "ann_id", "voter", "vote", F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    query = (
        placed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if ran:
        compact(spark, results_dir)
    return len(ran)


def parts(spark: SparkSession, results_dir: str) -> dict[int, int]:
    """Votes of every part that holds any, by the number of the part."""
    found = spark.read.schema(f"{STORED}, part bigint").parquet(results_dir).groupBy("part").count().collect()  # a row per part
    return {r["part"]: r["count"] for r in found}


def compact(spark: SparkSession, results_dir: str, fan: int = FAN) -> int:
    """Merge ``fan`` parts of a level into one part of the next, one vote per annotation and voter, until none has as many.

    A vote is rewritten once a level, so a batch costs in proportion to its own votes times the
    logarithm of the number of batches, and there are at most ``fan`` parts a level to read. The
    merged part is written before its sources are emptied: votes that lie in both for a while, or
    come back with a replayed batch, are the same votes and count once. Returns the merges done.
    """
    done = 0
    while True:
        levels: dict[int, list[int]] = {}
        for part in parts(spark, results_dir):
            levels.setdefault(max(-part, 0) // _LEVEL, []).append(part)
        full = next((level for level in sorted(levels) if len(levels[level]) >= fan), None)
        if full is None:
            return done
        # The oldest first; a part of a level is numbered by the last batch in it.
        some = sorted(levels[full], key=lambda p: abs(p) % _LEVEL)[:fan]
        last = abs(some[-1]) % _LEVEL
        rows = _last(spark.read.schema(STORED).parquet(*[f"{results_dir}/part={p}" for p in some])).withColumn("batch_id", F.lit(last).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{results_dir}/part={-(full + 1) * _LEVEL - last}")
        nothing = spark.createDataFrame([], STORED)
        for part in some:
            nothing.write.mode("overwrite").parquet(f"{results_dir}/part={part}")
        done += 1


def _last(votes: DataFrame) -> DataFrame:
    """The latest vote of each voter on each annotation: by file time, file name and row.

    Rows are sorted for it, and a file may be as large as it likes, so they are dealt out first.
    """
    dealt = votes.repartition(max(1, -(-votes.count() // ROWS)), "ann_id", "voter")
    picked = dealt.groupBy("ann_id", "voter").agg(F.max(F.struct(*_ORDER, "vote")).alias("v"))
    return picked.select("ann_id", "voter", "v.vote", *[f"v.{c}" for c in _ORDER])


def stored_votes(spark: SparkSession, results_dir: str) -> DataFrame:
    """One row per annotation and voter over all batches."""
    return _last(spark.read.schema(STORED).parquet(results_dir).select("ann_id", "voter", "vote", *_ORDER))


def results(spark: SparkSession, results_dir: str) -> DataFrame:
    """Consensus of every annotation voted on so far: ``ann_id, yes, no, consensus``."""
    return vote_consensus(stored_votes(spark, results_dir).select("ann_id", "voter", "vote"))

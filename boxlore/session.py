"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "boxlore") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    A machine-local folder is chosen only in local mode and only when nothing is set,
    because on a cluster it would vanish together with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="boxlore-"))
    return sc.getCheckpointDir()


SCRATCH = "boxlore_scratch"


class Scratch:
    """Owner of intermediate tables: whatever it keeps is dropped by :meth:`close` or a ``with`` block.

    Tables are managed tables of a scratch database that lies in the shared folder, so that
    dropping one also removes its files, without any call below the Spark SQL API.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH} LOCATION '{shared_dir(spark)}/{SCRATCH}'")

    def keep(self, df: DataFrame, buckets: tuple[str, int] | None = None) -> DataFrame:
        """Write ``df`` and read it back; with ``buckets``, in so many by a column, whose groups then need no shuffle.

        Cuts the lineage of iterative steps, keeps column pruning for later readers, and
        survives the loss of executors.
        """
        name = f"{SCRATCH}.t_{uuid.uuid4().hex}"
        writer = df.write.format("parquet")
        (writer.bucketBy(buckets[1], buckets[0]) if buckets else writer).saveAsTable(name)
        self.names.append(name)
        table = self.spark.table(name)
        table._scratch_name = name
        return table

    def discard(self, *tables: DataFrame) -> None:
        """Drop tables that nothing reads any more before the owner is closed."""
        for name in (t._scratch_name for t in tables):
            self.names.remove(name)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self, count: int = 1) -> None:
        """Drop the ``count`` oldest tables that are still kept."""
        for _ in range(min(count, len(self.names))):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(0)}")

    def close(self) -> None:
        self.drop(len(self.names))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_OPEN: list[Scratch] = []


def owner(spark: SparkSession) -> Scratch:
    """The owner of tables that live until :func:`release`; for results that are read after the call."""
    if not _OPEN or _OPEN[-1].spark is not spark:
        _OPEN.append(Scratch(spark))
    return _OPEN[-1]


@contextmanager
def owned(spark: SparkSession) -> Iterator[Scratch]:
    """What :func:`owner` and :func:`materialise` keep inside is dropped at the end."""
    with Scratch(spark) as own:
        _OPEN.append(own)
        try:
            yield own
        finally:
            _OPEN.remove(own)


def materialise(df: DataFrame) -> DataFrame:
    """Keep ``df`` as a table until :func:`release`."""
    return owner(df.sparkSession).keep(df)


def release(spark: SparkSession) -> None:
    """Drop every table of the :func:`owner` of this session.

    Call it when the results that were built on them have been written or collected.
    """
    for owner in [o for o in _OPEN if o.spark is spark]:
        owner.close()
        _OPEN.remove(owner)

"""Session settings and the place where long lineages are cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app_name: str = "fieldline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the adaptive settings these jobs are written for.

    Shuffle partitions are left to the cluster unless given; adaptive execution
    merges small ones and splits skewed joins.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where none is set (tests, local runs) a folder beside the warehouse is set;
    on a cluster that is refused.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


# Paths given out by ``new_path`` and not removed yet, in order.
_GIVEN: dict[str, None] = {}


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    _GIVEN[path] = None
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    files, place = _file_system(spark, path)
    files.delete(place, True)
    _GIVEN.pop(path, None)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but keeps columns prunable and sizes
    known, and survives the loss of executors. ``discard`` removes the table
    once it is spent; what is left goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    for df in stored:
        remove(df.sparkSession, df._stored_at)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``make()`` as a stored table; the intermediate tables stored on the way are removed."""
    before = set(_GIVEN)
    out = materialise(make(), name)
    for path in [p for p in _GIVEN if p not in before and p != out._stored_at]:
        remove(spark, path)
    return out

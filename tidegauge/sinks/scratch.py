"""Working folders in the storage that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Folders made within ``cleared``, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode one below the warehouse serves where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _MADE.get():
        _MADE.get()[-1].append(folder)
    return folder


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the working folders that were made inside, also after a failure.

    What is computed inside must be written or collected there: a DataFrame that still reads
    a working folder cannot be used afterwards.
    """
    own: list[str] = []
    token = _MADE.set((*_MADE.get(), own))
    try:
        yield
    finally:
        _MADE.reset(token)
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """The rows computed once, into reliable storage, with their lineage cut.

    Unlike a cache this survives the loss of executors, and it keeps the
    partitioning, so aggregates by the same key do not shuffle again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows written once to the shared folder and read back from there."""
    folder = new_folder(df.sparkSession, f"staged-{purpose}")
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

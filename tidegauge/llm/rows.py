"""Row-wise Arrow work that every document operator shares."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows and UTF-8 bytes that a Python worker holds as objects at a time.
SLICE_ROWS, SLICE_BYTES = 2000, 2 << 20


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under fixed names; whatever else the table has stays out."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in wanted.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with columns c0, c1, ..., which clash with nothing, and the new name of each."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new.__getitem__


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the numbered columns, under the names they had."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded rows and bytes; one row may exceed the bytes."""
    start, used = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or used + (n or 0) > size):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n or 0
    if len(lengths) > start:
        yield batch.slice(start)


def give_back() -> None:
    """Free memory goes back to the system: a worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers find this package, and are small between tasks.

    On a cluster the package is installed or given by --py-files; where the driver
    only has it in a folder, workers on the same storage look there too.
    """
    context = df.sparkSession.sparkContext
    context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, text: str, added: T.StructType, make: Callable[[list], list], keep: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` (or those of ``keep``) and those that ``make(texts)`` gives, a list each.

    ``make`` gets the values of column ``text`` (None for null). A column of ``df``
    that has the name of an added one is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in added.fieldNames()]
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    arrow = [to_arrow(f.dataType) for f in added]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = make(part.column(text).to_pylist())
                extra = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + extra, names)

    return map_arrow(df, run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the storage that driver and executors share.

    Where spark.checkpoint.dir names none, local mode (tests) takes one below the
    warehouse; on a cluster that is an error, as the folder could be the driver's own.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder, lineage cut."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""What the operators share: checkpoints that outlive an executor, and inputs."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators.components import checkpoint, shared_folder, stored

__all__ = ["checkpoint", "frugal", "read", "release", "shared_folder", "spare", "stored", "text_input"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_input(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads; others may have any names."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def spare(name: str, docs: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(df: DataFrame) -> None:
    """Shuffle files behind a checkpoint go once the driver collects what used them; let it do so now, before more are written."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that gives its memory back at the end of a task.

    Spark keeps Python workers for later tasks; what one task freed would otherwise count against the executor until then.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass

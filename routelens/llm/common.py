"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if Spark runs on this machine alone, else an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='documents-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and lineage ends there.

    It outlives lost executors. The cluster's owner clears the folder, as for checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/documents-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts in one Arrow batch from the JVM to a Python worker, and their bytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
           "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold ``BATCHES`` at most, as whole texts are large; set in the session.

    A setting that someone chose, other than Spark's own, is left.
    """
    for name, (usual, most) in BATCHES.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, most)


_HELD: dict = {}


def held(key: object, build: Callable[[], T]) -> T:
    """The object of that key, kept for the next tasks of this Python worker.

    A worker keeps one object alone: those of other operators make room for it.
    """
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go what the worker holds, before work that needs none of it."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds. Of a NULL id: NULL."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, NULL as an empty one."""
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str,
           most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        start = held = 0
        for row, size in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)

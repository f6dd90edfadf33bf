"""Steps that are read more than once: written to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir. Only a local session may leave that unset; then the warehouse is taken."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex[:12]}"


def file_folder(spark: SparkSession) -> str:
    """shared_folder with its scheme, so that Spark and tasks that write files there mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else uri)


def write_batch(uri: str, batch: pa.RecordBatch) -> None:
    """Write a record batch as one file, below a name of its own until it is whole: a lost task leaves no half file."""
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(temp) as out, pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    fs.move(temp, path)


def read_batch(uri: str) -> pa.RecordBatch:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f, pa.ipc.open_stream(f) as stream:
        return stream.read_next_batch()


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Steps written here hand at most about ``size`` at a time to Python. Spark doubles a batch's memory while it fills, outside the heap and for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: later steps don't compute it again, and a lost executor costs its tasks alone."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Delete written steps that nothing reads any more."""
    for step in steps:
        spark = step.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, key: str, rows_a_task: int = 50_000) -> DataFrame:
    """rows dealt by key to as many tasks as the session shuffles to, and to more from rows_a_task on: a small file of wide work is one task otherwise."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_a_task))
    return rows.repartition(parts, key)


def once_each(rows: DataFrame, on: str, work: Callable[[DataFrame], DataFrame], columns: Sequence[str], few: int = 200_000) -> DataFrame:
    """rows with ``columns`` of what ``work`` adds to the distinct values of the column ``on`` (its only input), so equal values are worked once.

    Up to ``few`` distinct values go to all tasks, more of them are joined. Null stays null and is worked like any other value.
    """
    out = written(work(rows.select(on).distinct()).select(on, *columns))
    key = "_" + on
    known = out.withColumnRenamed(on, key)
    return rows.join(F.broadcast(known) if out.count() <= few else known, F.col(on).eqNullSafe(F.col(key)), "left").drop(key)

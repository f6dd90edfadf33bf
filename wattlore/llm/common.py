"""Shared plumbing of the training-data operators: shared work folders, materialised steps, Arrow access to text."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, with its scheme, so that Spark and tasks mean the same place.

    Lies in the folder the cluster names in ``spark.checkpoint.dir``; only a local session may leave that unset, and then the
    session's warehouse folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/wattlore-work"
        spark.conf.set("spark.checkpoint.dir", base)
    path, fs = _hadoop(spark, base)
    return f"{fs.makeQualified(path).toString().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def remove(spark: SparkSession, *uris: str) -> None:
    """Delete folders that work_dir has named and nothing reads any more."""
    for uri in uris:
        path, fs = _hadoop(spark, uri)
        fs.delete(path, True)


def discard(*steps: DataFrame) -> None:
    """Delete steps that materialize has written and nothing reads any more; what was read from them must be written itself."""
    for step in steps:
        remove(step.sparkSession, step.step_path)


def open_fs(uri: str):
    """(filesystem, path) of a folder that work_dir has named, usable in tasks."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        return fs.FileSystem.from_uri("s3:" + rest)
    if not rest:
        raise ValueError(f"{uri} names no file system: take a folder from work_dir")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts: list[bytes]) -> None:
    """Write one file whole: a new name while it is written, then a move, so that a lost task leaves no half file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    fs.move(temp, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_col(df: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def blocks_for(df: DataFrame, text: str = "text", chars_per_block: int = 16_000_000) -> int:
    """How many blocks of about chars_per_block characters a table of texts makes; one pass over the text lengths."""
    total = df.select(F.sum(F.length(df[text])).alias("n")).first()["n"]
    return max(1, -(-int(total or 0) // chars_per_block))


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and what they hold counts against the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without a copy; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]

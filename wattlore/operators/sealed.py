"""Hashes of sealed files: a file's own SHA-256 from its lines as rows, against a registry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.steps import written


def sealed_hash(df: DataFrame, order: str, line: str, by: str, piece_bytes: int = 8 << 20) -> DataFrame:
    """by, n, sha256 of each file's lines in order, as sha256sum tells them: every line ends with a newline. Null lines aren't lines.

    Lines are sorted over all partitions and packed into pieces of about piece_bytes there. SHA-256 goes from front to back, so
    a file's pieces then pass through one task, one after another and none of them kept.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter(F.col(line).isNotNull()).select(F.col(by).cast("string").alias("name"), F.col(order).alias("o"), F.col(line).cast("string").alias("line"))
    ordered = rows.repartitionByRange(parts, "name", "o").sortWithinPartitions("name", "o", "line").drop("o")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, name, lines, size = TaskContext.get().partitionId(), 0, None, [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([part], pa.int32()), pa.array([piece], pa.int64()), pa.array([len(lines)], pa.int64()), pa.array(["".join(lines).encode()], pa.binary())], ["name", "part", "piece", "n", "data"])
        for b in batches:
            for who, text in zip(b.column("name").to_pylist(), b.column("line").to_pylist()):
                if lines and (who != name or size >= piece_bytes):
                    yield make()
                    piece, lines, size = piece + 1, [], 0
                name = who
                lines.append(text + "\n")
                size += len(text)
        if lines:
            yield make()

    packed = written(ordered.mapInArrow(pack, "name string, part int, piece long, n long, data binary"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, name, sha, n, began = [], None, hashlib.sha256(), 0, False
        for b in batches:
            for who, k, data in zip(b.column("name").to_pylist(), b.column("n").to_pylist(), b.column("data")):
                if began and who != name:
                    done.append((name, n, sha.hexdigest()))
                    sha, n = hashlib.sha256(), 0
                name, began = who, True
                sha.update(data.as_buffer())
                n += k
        if began:
            done.append((name, n, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["name", "n", "sha256"])

    out = packed.repartition("name").sortWithinPartitions("name", "part", "piece").select("name", "n", "data").mapInArrow(digest, "name string, n long, sha256 string")
    return out.withColumnRenamed("name", by)


def check_sealed(hashes: DataFrame, registry: DataFrame, by: str) -> DataFrame:
    """by, status: OK where a file has the registered n and sha256, CHANGED where not, MISSING where the registry lacks it, GONE where only the registry has it."""
    known = registry.select(F.col(by), F.col("n").alias("_n"), F.col("sha256").alias("_h"))
    rows = hashes.join(known, by, "full")
    status = F.when(F.col("_h").isNull(), "MISSING").when(F.col("sha256").isNull(), "GONE").when((F.col("n") == F.col("_n")) & (F.col("sha256") == F.col("_h")), "OK").otherwise("CHANGED")
    return rows.select(by, status.alias("status"))

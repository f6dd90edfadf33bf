"""The stateless and windowed operators on streams: windowed statistics with a watermark, batch operators on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_stats(stream: DataFrame, ts: str, by: Sequence[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics by time window and key; rows later than ``late`` are left out, so state is bounded."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a narrow batch operator (evidence, ratio codes, posterior) to a stream and append Parquet, once for all that is there."""
    return score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Sensor series: regular grids, windows, ridge fits, forecasts and three-sigma anomalies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.determinism import hash_key, hash_number


def regularize(df: DataFrame, interval: str = "1 hour", series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Every series on its own grid from its first to its last time; gaps are null rows with is_missing; rows off the grid go."""
    span = df.groupBy(series).agg(F.min(ts).alias("a"), F.max(ts).alias("z"))
    grid = span.select(series, F.explode(F.sequence("a", "z", F.expr(f"interval {interval}"))).alias(ts))
    return grid.join(df.withColumn("_here", F.lit(True)), [series, ts], "left").withColumn("is_missing", F.col("_here").isNull()).drop("_here")


def range_window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def latest_n(df: DataFrame, n: int, series: str = "series_id", ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(series).orderBy(F.desc(ts))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def window_stats(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """n, mean, std (n - 1; 0 for one row), min, max."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def sliding_windows(df: DataFrame, size: int, step: int, value: str, series: str = "series_id", ts: str = "ts", digits: int = 4) -> DataFrame:
    """Complete windows of ``size`` rows every ``step`` rows: their first and last time and statistics, from a moving frame
    rather than from collected rows."""
    w = Window.partitionBy(series).orderBy(ts)
    frame = w.rowsBetween(-(size - 1), 0)
    rows = df.withColumns({
        "_i": F.row_number().over(w), "start": F.first(ts).over(frame), "n": F.count(F.lit(1)).over(frame), "mean": F.round(F.avg(value).over(frame), digits),
        "std": F.round(F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0)), digits), "min": F.min(value).over(frame), "max": F.max(value).over(frame),
    })
    whole = rows.filter((F.col("n") == size) & ((F.col("_i") - size) % step == 0))
    return whole.select(series, ((F.col("_i") - size) / step).cast("long").alias("window"), "start", F.col(ts).alias("end"), "mean", "std", "min", "max")


def gram(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Sums of products of (1, features, target): all that a least-squares fit needs, one row for each group."""
    names = ["1", *features, target]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    rows = df.dropna(subset=[*features, target])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(col(a) * col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])


def fit_linear(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ("series_id",), ridge: float = 1e-6, min_rows: int = 10) -> DataFrame:
    """by, n, bias, coef (map), r2, residual variance of (A'A + ridge I) w = A'y, solved in tasks from gram's sums."""
    k = len(features) + 1

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                w = np.linalg.solve(g[:k, :k] + ridge * np.eye(k), g[:k, k])
                rss = g[k, k] - 2 * w @ g[:k, k] + w @ g[:k, :k] @ w
                tss = max(g[k, k] - g[0, k] ** 2 / r["n"], 1e-10)
                out.append({**{b: r[b] for b in by}, "n": r["n"], "bias": w[0], "coef": dict(zip(features, w[1:].tolist())), "r2": 1 - rss / tss})
            yield pd.DataFrame(out, columns=[*by, "n", "bias", "coef", "r2"])

    sums = gram(df, features, target, by).filter(F.col("n") >= min_rows)
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", n long, bias double, coef map<string,double>, r2 double"
    return sums.mapInPandas(solve, schema)


def forecast_hold_last(df: DataFrame, model: DataFrame, features: Sequence[str], target: str, h: int, mix: float = 0.1, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """series, step, forecast with the last features held: y_t = f + (y0 - f) * mix ** t."""
    last = df.groupBy(series).agg(F.max_by(F.struct(*features, target), ts).alias("l"))
    f = F.col("bias")
    for x in features:
        f = f + F.col("coef")[x] * F.col(f"l.{x}")
    rows = last.join(model, series).withColumn("f", f).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(series, "step", (F.col("f") + (F.col(f"l.{target}") - F.col("f")) * F.pow(F.lit(mix), F.col("step"))).alias("forecast"))


def anomalies_3sigma(df: DataFrame, value: str, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows further than k standard deviations from their group's mean, with the bounds; groups need 3 rows and a spread.

    The groups' statistics are aggregated first and joined, so a long series isn't sorted or held for them.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).filter("n >= 3 and std > 0")
    bounds = stats.withColumns({"low": F.col("mean") - k * F.col("std"), "high": F.col("mean") + k * F.col("std")})
    return df.join(bounds.drop("n"), list(by)).filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def array_anomalies(signal: Column, k: float = 3.0) -> Column:
    """struct(error, indices) of an array of numbers: fewer than 3 numbers are an error, a constant array has no anomaly."""
    n = F.size(signal)
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(signal, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)
    sd = F.sqrt(var)
    idx = F.filter(F.transform(signal, lambda x, i: F.when((sd > 0) & (F.abs(x - mean) > k * sd), i)), lambda i: i.isNotNull())
    bad = signal.isNull() | (n < 3) | F.exists(signal, lambda x: x.isNull() | F.isnan(x))
    return F.when(bad, F.struct(F.lit("needs at least 3 numbers").alias("error"), F.lit(None).cast("array<int>").alias("indices"))).otherwise(F.struct(F.lit(None).cast("string").alias("error"), idx.alias("indices")))


def series_profile(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def sample_windows(df: DataFrame, length: int, n: int, p_outlier: float = 0.4, scale: float = 5.0, seed: str | int = 0, series: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """n windows of ``length`` values with starts chosen by hash; a share has one point, chosen by hash, scaled."""
    w = Window.partitionBy(series).orderBy(ts)
    rows = df.withColumns({"_v": F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(0, length - 1)), "_k": hash_key(seed, series, ts)})
    picked = rows.filter(F.size("_v") == length).orderBy("_k", series, ts).limit(n)
    odd = (hash_number(f"{seed}-o", series, ts) / float(1 << 32)) < p_outlier
    at = F.pmod(hash_number(f"{seed}-i", series, ts), F.lit(length))
    signal = F.transform("_v", lambda x, i: F.when(F.col("outlier") & (i == F.col("outlier_at")), x * scale).otherwise(x))
    return picked.withColumns({"outlier": odd, "outlier_at": at}).select(series, F.col(ts).alias("start"), signal.alias("signal"), "outlier", F.when(F.col("outlier"), F.col("outlier_at")).alias("outlier_at"))

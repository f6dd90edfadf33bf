"""Order, splits, quotas and samples that are the same on any cluster: everything random follows md5(seed | id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_key(seed: str | int, *cols: str | Column) -> Column:
    """md5 hex of ``seed|col|col``; sorting by it is a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def hash_number(seed: str | int, *cols: str | Column) -> Column:
    """The first 32 bits of hash_key as a long."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("long")


def split_by_group(df: DataFrame, group: str, fractions: Sequence[tuple[str, float]], seed: str | int, rule: str = "boundary") -> DataFrame:
    """Add ``split``: groups in hash order are cut at floor boundaries; all rows of a group share its split.

    rule "boundary" cuts at floor(n * cumulative share); "counts" gives each split floor(n * share) groups and the last one
    the rest. Only the distinct groups are ranked, not the rows, and no task ranks them all: a group's rank is its rank among
    those with the same first three digits of the hash, after all groups of lower digits.
    """
    groups = df.select(group).distinct().withColumn("_k", hash_key(seed, group)).withColumn("_b", F.substring("_k", 1, 3))
    sizes = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_s"))  # 4096 rows at most
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_k", group))
    ranked = groups.withColumn("_r", own).join(sizes, "_b").withColumn("_r", F.col("_r") + F.col("_before"))
    edge, total, out = F.lit(0).cast("long"), 0.0, F.lit(fractions[-1][0])
    edges = []
    for name, share in fractions[:-1]:
        total += share
        edge = F.floor(F.col("_n") * round(total, 9)) if rule == "boundary" else edge + F.floor(F.col("_n") * share)
        edges.append((name, edge))
    for name, e in reversed(edges):
        out = F.when(F.col("_r") <= e, name).otherwise(out)
    return df.join(ranked.select(group, out.alias("split")), group)


def quota_sample(df: DataFrame, by: str, quota: DataFrame, seed: str | int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(first ``n`` rows of each class in hash order, shortage by class). quota: by, n — a small table."""
    w = Window.partitionBy(by).orderBy(hash_key(seed, id_col), id_col)
    rows = df.join(quota.withColumnRenamed("n", "_quota"), by).withColumn("_r", F.row_number().over(w)).filter("_r <= _quota").drop("_r", "_quota")
    have = rows.groupBy(by).agg(F.count(F.lit(1)).alias("have"))
    short = quota.join(have, by, "left").select(by, F.col("n").alias("wanted"), F.coalesce("have", F.lit(0)).alias("have")).withColumn("short", F.col("wanted") - F.col("have")).filter("short > 0")
    return rows, short


def largest_remainder(counts: DataFrame, by: str, n: int, floor: int = 0) -> DataFrame:
    """by, n: n rows dealt in proportion to count, remainders to the largest fractions (ties by name), each at least floor."""
    total = Window.partitionBy()
    exact = F.col("count") * n / F.sum("count").over(total)
    base = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), F.asc(by))
    left = F.lit(n) - F.sum("_base").over(total)
    got = F.col("_base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return base.select(by, "count", F.least(F.greatest(got, F.lit(floor)), "count").cast("long").alias("n"))


def proportional_sample(df: DataFrame, by: str, n: int, seed: str | int, id_col: str, floor: int = 0) -> DataFrame:
    """n rows with the classes' shares kept by largest remainder; rows within a class in hash order."""
    counts = df.groupBy(by).count()
    quota = largest_remainder(counts, by, n, floor).select(by, "n")
    return quota_sample(df, by, quota, seed, id_col)[0]


def stratified_folds(df: DataFrame, label: str, k: int, seed: str | int, id_col: str) -> DataFrame:
    """Add ``fold``: round robin over the hash order within each class."""
    w = Window.partitionBy(label).orderBy(hash_key(seed, id_col), id_col)
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))


def content_hash(df: DataFrame, order: str) -> DataFrame:
    """One row: n and a reproducible hash of all rows in order of a key.

    Each row's sha256 is reduced per key range first: the hashes of 4096 buckets, in order, are hashed again.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    keyed = df.select(F.substring(F.md5(F.col(order).cast("string")), 1, 3).alias("b"), F.md5(F.col(order).cast("string")).alias("k"), row.alias("h"))
    part = keyed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("content_hash"))


def distribution_drift(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """by, share_a, share_b, drift for every class of either."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(by).count()
        return counts.select(by, (F.col("count") / F.sum("count").over(Window.partitionBy())).alias(name))

    both = shares(a, "share_a").join(shares(b, "share_b"), by, "full")
    return both.select(by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("share_a", "share_b")]).withColumn("drift", F.abs(F.col("share_a") - F.col("share_b")))

"""Connected components by alternating large-star and small-star rounds; nothing goes to the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One round over written edges (u, v), u > v, which it deletes in the end: every larger (or smaller) neighbour of a node is tied to its least neighbour.

    The least neighbours are aggregated first and written, so the join that follows has a row per node on one side and
    Spark can split a node with very many edges on the other.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
    tied = near.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    new = materialize(out.filter("u <> v").distinct(), name)
    discard(least, edges)
    return new


def _sum(edges: DataFrame) -> tuple:
    row = edges.select(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node that edges (a, b: long) name; nulls are ignored."""
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pairs, "links")
    before = None
    while (at := _sum(now)) != before:
        before = at
        if not at[0]:
            break
        now = _star(_star(now, True, "large-star"), False, "small-star")
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return tied.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

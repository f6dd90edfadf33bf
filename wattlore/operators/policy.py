"""Evaluation of questioning policies from snapshots: stop points, reports, budget curves, paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def stop_index(snaps: DataFrame, tau: float = 0.8, eps: float = 0.02, max_queries: int = 3, by: str = "traj_id") -> DataFrame:
    """by, q, reason: the first snapshot whose rule fires (entropy, no candidates, voi, budget), else the last."""
    reason = F.when(F.col("entropy") < tau, "entropy").when(F.col("n_cands") == 0, "no_candidates").when(F.col("best_voi") < eps, "voi").when(F.col("n_queries") >= max_queries, "budget")
    rows = snaps.withColumn("reason", reason)
    out = rows.groupBy(by).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("q", "reason"))).alias("s"), F.max("q").alias("last"))
    return out.select(by, F.coalesce("s.q", "last").alias("q"), F.coalesce("s.reason", F.lit("exhausted")).alias("reason"))


def adaptive_report(snaps: DataFrame, stops: DataFrame, labels: DataFrame, by: str = "traj_id", group: str = "level", bins: int = 15) -> DataFrame:
    """Accuracy, mean queries and cost, reasons, at the stop point, for each group and ALL. labels: by, group, label.

    Where snaps has posterior (map of class to probability): also NLL (probabilities of at least 1e-12), hit at 2 (ties in
    order of class) and ECE over ``bins`` equal bins of the largest probability, each weighted by its share of the rows.
    """
    rows = snaps.join(stops, [by, "q"]).join(labels, by)
    more = []
    if "posterior" in snaps.columns:
        ranked = F.array_sort(F.transform(F.map_entries("posterior"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
        rows = rows.withColumn("_r", ranked).withColumns({"_conf": -F.col("_r")[0]["p"], "_own": F.greatest(F.coalesce(F.col("posterior")[F.col("label")], F.lit(0.0)), F.lit(1e-12))})
        right = (F.col("_r")[0]["k"] == F.col("label")).cast("double")
        rows = rows.withColumns({"_bin": F.least(F.floor(F.col("_conf") * bins), F.lit(bins - 1)), "_gap": F.col("_conf") - right})
        in_bin = [F.abs(F.sum(F.when(F.col("_bin") == i, F.col("_gap")).otherwise(0.0))) for i in range(bins)]
        two = F.exists(F.slice("_r", 1, 2), lambda e: e["k"] == F.col("label")).cast("double")
        more = [F.avg(-F.log("_own")).alias("nll"), F.avg(two).alias("hit_2"), (reduce(lambda x, y: x + y, in_bin) / F.count(F.lit(1))).alias("ece")]
    out = rows.rollup(group).agg(*more, F.count(F.lit(1)).alias("n"), F.avg((F.col("top1") == F.col("label")).cast("double")).alias("accuracy"), F.avg("n_queries").alias("queries"), F.avg("cost").alias("cost"), *[F.count_if(F.col("reason") == r).alias(f"stop_{r}") for r in ("entropy", "no_candidates", "voi", "budget", "exhausted")])
    return out.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("ALL")))


def budget_curve(snaps: DataFrame, labels: DataFrame, budgets: Sequence[int], by: str = "traj_id") -> DataFrame:
    """budget, accuracy, cost with each trajectory's last snapshot within the budget carried forward."""
    grid = snaps.select(by).distinct().withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    last = grid.join(snaps, by).filter(F.col("n_queries") <= F.col("budget")).groupBy(by, "budget").agg(F.max_by(F.struct("top1", "cost"), "q").alias("s"))
    return last.join(labels, by).groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s.top1") == F.col("label")).cast("double")).alias("accuracy"), F.avg("s.cost").alias("cost"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired_permutation(df: DataFrame, a: str, b: str, n: int = 20_000, seed: int = 0, run: int = 10_000) -> DataFrame:
    """mean difference and sign-flip p = (count + 1) / (n + 1).

    A row's sign in a permutation comes from its difference, its number among rows of the same difference, the permutation
    and the seed, so the result does not depend on how rows are laid out. Equal differences are counted first and dealt out
    again in runs of ``run``, so neither the rows, nor a value that very many share, nor the permutations sit in one place.
    """
    d = (F.col(a) - F.col(b)).cast("double").alias("d")
    counted = df.select(d).filter("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    runs = counted.select("d", "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / run))).alias("run"))
    spread = runs.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "d", "run")
    rows = spread.select("d", F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("c")) - 1)).alias("i"))
    keyed = rows.select("d", F.xxhash64("d", "i", F.lit(seed)).alias("key"))
    words = -(-n // 64)

    def signed(frames):
        total, count, sums = 0.0, 0, np.zeros(words * 64)
        each = _mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for pdf in frames:
            x, keys = pdf["d"].to_numpy(), pdf["key"].to_numpy().view(np.uint64)
            total, count = total + x.sum(), count + len(x)
            for at in range(0, len(x), 1024):
                bits = np.unpackbits(_mixed(keys[at : at + 1024, None] ^ each).astype("<u8").view(np.uint8), axis=1)
                sums += 2.0 * (x[at : at + 1024] @ bits)
        yield pd.DataFrame({"j": np.arange(n), "s": sums[:n] - total, "t": total, "c": count})

    sums = keyed.mapInPandas(signed, "j long, s double, t double, c long").groupBy("j").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    hits = F.sum((F.abs("s") >= F.abs("t") - 1e-9).cast("long"))
    return sums.agg(F.max("c").alias("n"), (F.max("t") / F.max("c")).alias("mean_diff"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def binomial_two_sided(b: int, c: int, exact: int = 1000) -> float:
    """Exact McNemar p of two discordant counts.

    Beyond ``exact`` the tail is added up from its largest term downwards, by the ratio of neighbours, until terms no longer
    count: some multiple of the square root of b + c terms, and no number with more than 64 bits.
    """
    n, k = b + c, min(b, c)
    if n <= exact:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    total, term, i = 0.0, 1.0, k
    while term > total * 1e-17:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)))


def mcnemar_exact(df: DataFrame, a: str, b: str) -> tuple[int, int, float]:
    """(a right only, b right only, p) of two boolean columns."""
    row = df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c")).first()
    return row["b"], row["c"], binomial_two_sided(row["b"], row["c"])

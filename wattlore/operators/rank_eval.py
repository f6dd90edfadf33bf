"""Retrieval evaluation: query derivation, splits, ranking metrics, ablations, grades, agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.determinism import hash_key, split_by_group  # noqa: F401  part of this module's surface
from .retrieval import bm25_topk
from .textindex import bm25_index


def derive_queries(units: DataFrame, chunks: DataFrame, definition: str = r"^(.{2,20}?)(是指|指的是| is defined as | means )") -> DataFrame:
    """type, query, gold_chunk_ids, gold_doc_id, source_unit_id from headings, captions and definitions."""
    gold = chunks.select(F.explode("unit_ids").alias("unit_id"), "chunk_id").groupBy("unit_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_chunk_ids"))
    w = Window.partitionBy("doc_id").orderBy("order")
    nxt = F.first(F.when(F.col("type") != "title", F.col("unit_id")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = units.withColumn("_next", nxt)
    heads = rows.filter("type = 'title' and level >= 1").select(F.lit("heading").alias("type"), F.regexp_replace("text", r"^[0-9.．、\s()（）]+", "").alias("query"), F.col("_next").alias("unit_id"), "doc_id", "order")
    captions = rows.filter("caption is not null and caption <> ''").select(F.lit("caption").alias("type"), F.col("caption").alias("query"), "unit_id", "doc_id", "order") if "caption" in units.columns else None
    said = rows.filter((F.col("type") == "paragraph") & F.col("text").rlike(definition)).select(F.lit("definition").alias("type"), F.regexp_extract("text", definition, 1).alias("query"), "unit_id", "doc_id", "order")
    every = reduce(DataFrame.unionByName, [x for x in (heads, captions, said) if x is not None])
    return every.join(gold, "unit_id", "left").select("type", "query", "gold_chunk_ids", F.col("doc_id").alias("gold_doc_id"), F.col("unit_id").alias("source_unit_id"), "order")


def dedup_queries(queries: DataFrame, type_order: Sequence[str] = ("heading", "caption", "definition"), least: int = 4) -> DataFrame:
    """First query of each text in order of type and position; too short ones and those without gold go."""
    rank = F.array_position(F.array(*[F.lit(t) for t in type_order]), F.col("type"))
    w = Window.partitionBy("query").orderBy(rank, "gold_doc_id", "order", "source_unit_id")
    fine = queries.filter((F.length("query") >= least) & (F.size(F.coalesce("gold_chunk_ids", F.array())) > 0))
    return fine.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("gold_chunk_ids", F.array_sort(F.array_distinct("gold_chunk_ids")))


def cap_sample(queries: DataFrame, per_type: Mapping[str, int], per_doc: int = 25, seed: str | int = 0, default: int = 0, doc: str = "gold_doc_id", id_col: str = "qid") -> DataFrame:
    """In hash order: at most per_doc for each type and document, then at most per_type[type] (default for others)."""
    by_doc = Window.partitionBy("type", doc).orderBy(hash_key(seed, id_col), id_col)
    by_type = Window.partitionBy("type").orderBy(hash_key(seed, id_col), id_col)
    cap = F.lit(default)
    for t, n in per_type.items():
        cap = F.when(F.col("type") == t, n).otherwise(cap)
    rows = queries.withColumn("_d", F.row_number().over(by_doc)).filter(F.col("_d") <= per_doc)
    return rows.withColumn("_t", F.row_number().over(by_type)).filter(F.col("_t") <= cap).drop("_d", "_t")


def ranking_metrics(results: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), by: str = "type", config: str | None = None) -> DataFrame:
    """Recall at ks, MRR (places to 10) and document recall at 5 for each class and ALL.

    results: qid, item_id, rank[, doc_id][, config]; gold: qid, by, item_id (one row for each gold item)[, doc_id].
    A query without a hit counts 0.
    """
    keys = ([config] if config else []) + ["qid"]
    first = results.join(gold.select("qid", "item_id").distinct(), ["qid", "item_id"]).groupBy(*keys).agg(F.min("rank").alias("at"))
    asked = gold.select("qid", by).distinct()
    if config:
        asked = asked.crossJoin(F.broadcast(results.select(config).distinct()))  # a row for each configuration
    rows = asked.join(first, keys, "left")
    if "doc_id" in results.columns and "doc_id" in gold.columns:
        doc = results.join(gold.select("qid", "doc_id").distinct(), ["qid", "doc_id"]).groupBy(*keys).agg(F.min("rank").alias("doc_at"))
        rows = rows.join(doc, keys, "left")
    else:
        rows = rows.withColumn("doc_at", F.lit(None).cast("int"))
    hit = lambda c, k: F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), *[hit("at", k).alias(f"recall_{k}") for k in ks], F.avg(F.when(F.col("at") <= 10, 1.0 / F.col("at")).otherwise(0.0)).alias("mrr"), hit("doc_at", 5).alias("doc_5")]
    if config:
        out = rows.groupingSets([[F.col(config), F.col(by)], [F.col(config)]], F.col(config), F.col(by)).agg(*aggs)
    else:
        out = rows.rollup(by).agg(*aggs)
    return out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("ALL")))


def channel_ablation(runs: Mapping[str, DataFrame], gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), by: str = "type") -> DataFrame:
    """ranking_metrics of several result sets in one job."""
    rows = reduce(DataFrame.unionByName, [r.withColumn("config", F.lit(name)) for name, r in runs.items()])
    return ranking_metrics(rows, gold, ks, by, "config")


def rrf_grid(channels: DataFrame, gold: DataFrame, grid: DataFrame, k: int = 60, cut: int = 10) -> tuple[DataFrame, DataFrame]:
    """(metrics of each weight pair, the best by recall at 5, then MRR). channels: qid, item_id, channel, rank; grid:
    grid_id, sub, summary — a stated list of pairs."""
    w = F.when(F.col("channel") == "sub", F.col("sub")).when(F.col("channel") == "summary", F.col("summary")).otherwise(1.0)
    fused = channels.crossJoin(F.broadcast(grid)).groupBy("grid_id", "qid", "item_id").agg(F.round(F.sum(w / (k + F.col("rank"))), 12).alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("grid_id", "qid").orderBy(F.desc("score"), "item_id"))).filter(F.col("rank") <= cut)
    metrics = ranking_metrics(ranked, gold, (5, 10), "type", "grid_id").filter("type = 'ALL'").drop("type", "doc_5")
    best = metrics.agg(F.max_by("grid_id", F.struct(F.round("recall_5", 9), F.round("mrr", 9), -F.col("grid_id"))).alias("grid_id"))
    return metrics.join(F.broadcast(grid), "grid_id"), best


def chunking_ablation(strategies: Mapping[str, DataFrame], queries: DataFrame, k: int = 10, ks: Sequence[int] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(metrics by strategy and type, queries without gold by strategy). strategies: chunks (chunk_id, unit_ids, tokens) of
    each way of chunking; queries: qid, type, tokens, source_unit_id. Gold is every chunk that holds the source unit."""
    runs, metrics, skipped = {}, [], []
    for name, chunks in strategies.items():
        held = chunks.select(F.explode("unit_ids").alias("source_unit_id"), F.col("chunk_id").alias("item_id"))
        gold = queries.select("qid", "type", "source_unit_id").join(held, "source_unit_id").select("qid", "type", "item_id")
        skipped.append(queries.join(gold.select("qid").distinct(), "qid", "left_anti").agg(F.count(F.lit(1)).alias("skipped")).withColumn("config", F.lit(name)))
        runs[name] = bm25_topk(queries.select("qid", "tokens"), bm25_index(chunks, "chunk_id", "tokens", "chunk"), "chunk", k)
        metrics.append(ranking_metrics(runs[name], gold, ks).withColumn("config", F.lit(name)))
    return reduce(DataFrame.unionByName, metrics), reduce(DataFrame.unionByName, skipped)


def lexical_grade(pairs: DataFrame, idf: DataFrame, t: Sequence[float] = (0.2, 0.5, 0.8), bonus: float = 0.15) -> DataFrame:
    """Grade 0-3 of (qid, item_id, query_tokens, tokens, heading_tokens): idf-weighted share of the query's terms in the body
    (idf at least 0.1, unknown terms 1), a bonus where the heading shares a term, cut at 1; no query terms give 1."""
    terms = pairs.select("qid", "item_id", F.explode_outer(F.array_distinct("query_tokens")).alias("term"), "tokens").join(idf.select("term", "idf"), "term", "left")
    w = F.greatest(F.coalesce("idf", F.lit(1.0)), F.lit(0.1))
    cover = terms.groupBy("qid", "item_id").agg(F.sum(F.when(F.col("term").isNotNull() & F.array_contains("tokens", F.col("term")), w).otherwise(0.0)).alias("hit"), F.sum(F.when(F.col("term").isNotNull(), w).otherwise(0.0)).alias("all"))
    rows = pairs.select("qid", "item_id", F.arrays_overlap("query_tokens", "heading_tokens").alias("head")).join(cover, ["qid", "item_id"])
    score = F.least(F.lit(1.0), F.round(F.col("hit") / F.col("all") + F.when(F.col("head"), bonus).otherwise(0.0), 9))
    grade = F.when(F.col("all") == 0, 1).when(score >= t[2], 3).when(score >= t[1], 2).when(score >= t[0], 1).otherwise(0)
    return rows.select("qid", "item_id", F.when(F.col("all") == 0, 0.0).otherwise(score).alias("coverage"), grade.alias("grade"))


def filter_expand_regrade(hits: DataFrame, again: DataFrame, near: DataFrame, grades: DataFrame, min_keep: int = 3, cap: int = 8) -> DataFrame:
    """Two fixed rounds: keep hits graded at least min_keep; queries that keep none take the second search's results
    (``again``); neighbours of what is kept join in, all are graded again, at most ``cap`` in order of grade and score.

    hits, again: qid, item_id, score; near: qid, item_id, from_id; grades: qid, item_id, grade.
    """
    good = grades.filter(F.col("grade") >= min_keep).select("qid", "item_id", "grade")
    kept = hits.join(good, ["qid", "item_id"])
    empty = hits.select("qid").distinct().join(kept.select("qid").distinct(), "qid", "left_anti")
    second = again.join(empty, "qid").join(hits.select("qid", "item_id"), ["qid", "item_id"], "left_anti").join(good, ["qid", "item_id"])
    base = kept.unionByName(second).withColumn("expanded_from", F.lit(None).cast(hits.schema["item_id"].dataType))
    grown = near.join(base.select("qid", F.col("item_id").alias("from_id"), "score"), ["qid", "from_id"]).join(base.select("qid", "item_id"), ["qid", "item_id"], "left_anti").join(good, ["qid", "item_id"])
    grown = grown.groupBy("qid", "item_id", "grade").agg(F.max("score").alias("score"), F.min("from_id").alias("expanded_from"))
    every = base.unionByName(grown.select(base.columns))
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), F.desc("score"), "item_id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def filter_effect_report(before: DataFrame, after: DataFrame, gold: DataFrame, by: str = "type") -> DataFrame:
    """hit, precision before and after, gold dropped and gained, sizes for each class and ALL. Inputs: qid, items / gold."""
    rows = gold.select("qid", by, "gold").join(before.select("qid", F.col("items").alias("b")), "qid", "left").join(after.select("qid", F.col("items").alias("a")), "qid", "left")
    empty = F.array().cast(before.schema["items"].dataType)
    rows = rows.withColumns({"a": F.coalesce("a", empty), "b": F.coalesce("b", empty)})
    n = lambda c: F.size(F.array_intersect(c, "gold"))
    prec = lambda c: F.avg(F.when(F.size(c) > 0, n(c) / F.size(c)).otherwise(0.0))
    out = rows.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((n("b") > 0).cast("double")).alias("hit_before"), F.avg((n("a") > 0).cast("double")).alias("hit_after"),
        prec("b").alias("precision_before"), prec("a").alias("precision_after"), F.sum(((n("b") > 0) & (n("a") == 0)).cast("long")).alias("gold_dropped"),
        F.sum(((n("b") == 0) & (n("a") > 0)).cast("long")).alias("gold_gained"), F.avg(F.size("b")).alias("size_before"), F.avg(F.size("a")).alias("size_after"),
    )
    return out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("ALL")))


def graded_pair_sample(candidates: DataFrame, n: int, shares: Mapping[str, float], seed: str | int = 0) -> DataFrame:
    """Pairs (qid, item_id, bucket) by quota: each pair once, in the first bucket of ``shares``' order that has it."""
    rank = F.array_position(F.array(*[F.lit(b) for b in shares]), F.col("bucket"))
    one = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "item_id").orderBy(rank))).filter("_r = 1")
    quota = F.lit(0)
    for b, s in shares.items():
        quota = F.when(F.col("bucket") == b, int(round(n * s))).otherwise(quota)
    w = Window.partitionBy("bucket").orderBy(hash_key(seed, "qid", "item_id"))
    return one.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).drop("_r")


def agreement(df: DataFrame, a: str, b: str, k: int = 4, keep_from: int = 2) -> tuple[DataFrame, DataFrame]:
    """(n, exact, within_one, keep agreement, quadratic weighted kappa; confusion counts) of two raters' grades 0..k-1.

    Kappa is null where chance leaves nothing to disagree about; rows that lack a grade are left out.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))  # at most k rows
    w = lambda x, y: F.pow((F.col(x) - F.col(y)) / F.lit(max(1, k - 1)), F.lit(2))
    expected = ra.crossJoin(F.broadcast(rb)).agg(F.sum(w("a", "b") * F.col("na") * F.col("nb")).alias("e"))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    seen = pairs.agg(F.sum("n").alias("n"), share(F.col("a") == F.col("b")).alias("exact"), share(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"), share((F.col("a") >= keep_from) == (F.col("b") >= keep_from)).alias("keep"), F.sum(w("a", "b") * F.col("n")).alias("o"))
    summary = seen.crossJoin(F.broadcast(expected)).withColumn("kappa", F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e")))
    return summary.drop("o", "e"), pairs

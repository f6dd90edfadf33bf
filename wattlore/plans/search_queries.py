"""Registered queries of layered retrieval: documents, their lines and their headings as layers of one written index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import rank_eval, retrieval, textindex
from .queries import UNITS_SQL, benchmark_gold, benchmark_queries, query, table, units, words

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}]{2,}')"
#: Lines that count as headings.
HEADING = r"[A-Z]"


def okapi_sql(n: str, source: str, k: int = 30, asked: str = "q") -> str:
    """CTEs that end in k{n} (qid, item_id, score, rank), BM25 of a layer; source has item_id and w, asked has qid, t and qtf."""
    return f"""d{n} AS ({source}), st{n} AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d{n}),
p{n} AS (SELECT item_id, t, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT item_id, len(w) AS dl, unnest(w) AS t FROM d{n}) GROUP BY item_id, t),
r{n} AS (SELECT t, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p{n}, st{n} GROUP BY t), i{n} AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r{n}) ELSE raw END AS idf FROM r{n}),
s{n} AS (SELECT qid, item_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM {asked} JOIN i{n} USING (t) JOIN p{n} USING (t), st{n} GROUP BY ALL),
k{n} AS (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM s{n} WHERE score > 0 QUALIFY rank <= {k})"""


ASKED_SQL = f"b AS (SELECT item_id AS qid, {_WORDS} AS w FROM benchmark), q AS (SELECT qid, t, count(*) AS qtf FROM (SELECT qid, unnest(w) AS t FROM b) GROUP BY ALL)"
LAYERS_SQL = f"""{UNITS_SQL}, {ASKED_SQL}, {okapi_sql('c', f"SELECT doc_id::VARCHAR AS item_id, {_WORDS} AS w FROM documents")},
{okapi_sql('l', f'''SELECT doc_id || '-' || "order" AS item_id, {_WORDS} AS w FROM u WHERE text IS NOT NULL''')}, {okapi_sql('h', f'''SELECT doc_id::VARCHAR AS item_id, {_WORDS} AS w FROM u WHERE "order" = 0''')},
m AS (SELECT qid, split_part(item_id, '-', 1) AS item_id, min(rank) AS best FROM kl GROUP BY ALL), kp AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY best, item_id) AS rank FROM m QUALIFY rank <= 30),
f AS (SELECT qid, item_id, round(sum(w / (60 + rank)), 12) AS score FROM (SELECT qid, item_id, rank, 1.0::DOUBLE AS w FROM kc UNION ALL SELECT qid, item_id, rank, 1.2 FROM kp UNION ALL SELECT qid, item_id, rank, 0.3 FROM kh) GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id)::INTEGER AS rank FROM f QUALIFY rank <= 30)"""


def layers(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], Column]:
    """(layers chunk, sub and summary, the document that a line's item_id belongs to)."""
    rows = units(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), words("text").alias("tokens"))
    lines = rows.select(F.col("unit_id").alias("item_id"), words("text").alias("tokens"))
    heads = rows.filter("`order` = 0").select(F.col("doc_id").alias("item_id"), words("text").alias("tokens"))
    return {"chunk": docs, "sub": lines, "summary": heads}, F.nullif(F.regexp_extract("item_id", r"^(.*)-\d+$", 1), F.lit(""))


def two_way(spark: SparkSession, sf_dir: str, mode: str, k: int) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    parts, parents = layers(spark, sf_dir)
    index = textindex.layered_index(parts)
    chunks = parts["chunk"].select(F.col("item_id").cast("string").alias("chunk_id"), "tokens")
    return retrieval.search(queries, index, chunks, parents, mode, k, 30).select("qid", "item_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {LAYERS_SQL} SELECT qid, item_id, round(score, 9) AS score, rank FROM g WHERE rank <= 10")
def two_way_search(spark, sf_dir):
    """Documents by BM25, by their best line and by their heading, fused."""
    return two_way(spark, sf_dir, "two_way", 10)


@query(f"""WITH {LAYERS_SQL}, z AS (SELECT g.qid, g.item_id, list_distinct(b.w) AS t, d.w FROM g JOIN b USING (qid) JOIN dc d USING (item_id)), y AS (SELECT qid, item_id, len(t) AS n, list_filter(list_transform(t, lambda x: list_position(w, x)), lambda p: p > 0) AS places FROM z),
x AS (SELECT qid, item_id, coalesce(round(len(places) / n + 0.3 * len(places) / (list_max(places) - list_min(places) + 1), 9), 0) AS score FROM y) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id)::INTEGER AS rank FROM x QUALIFY rank <= 10""")
def reranked_search(spark, sf_dir):
    """The same, its thirty best ranked again by how many of the query's words they have and how close together."""
    return two_way(spark, sf_dir, "two_way_rerank", 10)


@query(f"""WITH {UNITS_SQL}, b AS (SELECT item_id AS qid, {_WORDS} AS w FROM benchmark WHERE regexp_matches(text, '{HEADING}')), q AS (SELECT qid, t, count(*) AS qtf FROM (SELECT qid, unnest(w) AS t FROM b) GROUP BY ALL), {okapi_sql('a', f'''SELECT doc_id || '-' || "order" AS item_id, {_WORDS} AS w FROM u WHERE "order" % 3 = 0''', 10)},
m AS (SELECT qid, split_part(item_id, '-', 1) AS item_id, min(rank) AS best FROM ka GROUP BY ALL) SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY best, item_id)::INTEGER AS rank FROM m QUALIFY rank <= 10""")
def anchor_hits(spark, sf_dir):
    """Queries with a capital letter against every third line, each document at its best line's place."""
    queries = benchmark_queries(spark, sf_dir)
    rows = units(spark, sf_dir).filter(F.col("order") % 3 == 0)
    index = textindex.layered_index({"anchor": rows.select(F.col("unit_id").alias("item_id"), words("text").alias("tokens"))})
    parents = rows.select(F.col("unit_id").alias("item_id"), F.col("doc_id").cast("string").alias("parent_id"))
    return retrieval.anchor_channel(queries, index, parents, HEADING).select("qid", "item_id", "rank")


@query(f"""WITH {LAYERS_SQL}, gold AS (SELECT DISTINCT b.item_id AS qid, d.doc_id::VARCHAR AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), every AS (SELECT unnest([0.5, 1.2]) AS sub, qid, item_id, kc.rank AS rc, kp.rank AS rl FROM kc FULL JOIN kp USING (qid, item_id)),
e AS (SELECT sub, qid, item_id, row_number() OVER (PARTITION BY sub, qid ORDER BY round(coalesce(1.0 / (60 + rc), 0) + coalesce(sub / (60 + rl), 0), 12) DESC, item_id) AS rank FROM every), hit AS (SELECT sub, gold.qid, min(e.rank) AS rank FROM gold JOIN e USING (qid, item_id) GROUP BY ALL),
wanted AS (SELECT DISTINCT qid, unnest([0.5, 1.2]) AS sub FROM gold) SELECT n.sub::DOUBLE AS sub, count(*)::BIGINT AS n, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM wanted n LEFT JOIN hit ON hit.qid = n.qid AND hit.sub = n.sub GROUP BY n.sub""")
def fusion_grid(spark, sf_dir):
    """Recall of two channels' fusion for two weights of the line channel."""
    queries = benchmark_queries(spark, sf_dir)
    parts, parents = layers(spark, sf_dir)
    index = textindex.layered_index({"chunk": parts["chunk"], "sub": parts["sub"]})
    ranks = lambda df, name: df.select("qid", "item_id", F.lit(name).alias("channel"), "rank")
    channels = ranks(retrieval.bm25_topk(queries, index, "chunk", 30), "bm25").unionByName(ranks(retrieval.subchunk_channel(queries, index, parents, 30), "sub"))
    gold = benchmark_gold(spark, sf_dir).select("qid", F.lit("all").alias("type"), F.col("item_id").cast("string").alias("item_id"))
    grid = spark.createDataFrame([(0, 0.5, 0.0), (1, 1.2, 0.0)], "grid_id int, sub double, summary double")
    metrics, _ = rank_eval.rrf_grid(channels, gold, grid)
    return metrics.select("sub", "n", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr")])

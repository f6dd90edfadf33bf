"""Registered queries: the analytics operators over the whole driver tables, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import determinism as D
from ..operators import bayes, chunking, claims, corpus, datasets, fusion, graph, logs, policy, rank_eval, records, retrieval, series, textindex
from ..streaming import anomalies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- corpus: a unit is a line of a document ---------------------------------------------------------------------------

UNITS_SQL = """u AS (SELECT doc_id, i AS "order", lines[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(len(lines))) AS r(i)),
n AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' END AS reason, CASE WHEN "order" = 0 OR length(text) <= 20 THEN 'title' ELSE 'paragraph' END AS type, "order" // 10 AS page FROM u)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("order", "text"))
    kind = F.when((F.col("order") == 0) | (F.length("text") <= 20), "title").otherwise("paragraph")
    return lines.withColumns({"type": kind, "page": F.floor(F.col("order") / 10).cast("int"), "unit_id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("order").cast("string")), "doc_dir": F.col("doc_id").cast("string"), "block_order": F.col("order")})


@query(f"WITH {UNITS_SQL} SELECT 'empty' AS reason, count(*)::BIGINT AS count FROM n WHERE reason = 'empty' HAVING count(*) > 0")
def noise_counts(spark, sf_dir):
    return corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])[1]


@query(f"""WITH {UNITS_SQL} SELECT doc_id, count(*)::BIGINT AS n_units, (max(page) + 1)::INTEGER AS n_pages, sum(length(text))::BIGINT AS n_chars,
CASE WHEN max(page) + 1 >= 20 THEN 'thesis' ELSE 'article' END AS doc_kind FROM n WHERE reason IS NULL GROUP BY doc_id""")
def document_profile(spark, sf_dir):
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    return corpus.doc_profile(kept).select("doc_id", "n_units", F.col("n_pages").cast("int").alias("n_pages"), "n_chars", "doc_kind")


@query(f"WITH {UNITS_SQL} SELECT coalesce(type, 'ALL') AS name, count(*)::BIGINT AS n FROM n WHERE reason IS NULL GROUP BY ROLLUP (type)")
def cleaning_report(spark, sf_dir):
    kept, dropped = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    return corpus.cleaning_report(kept, dropped).filter("kind = 'unit'").select("name", "n")


@query(f"""WITH {UNITS_SQL}, t AS (SELECT *, CASE WHEN type = 'title' THEN row_number() OVER (PARTITION BY doc_id, type ORDER BY "order") END AS k FROM n WHERE reason IS NULL),
l AS (SELECT *, CASE WHEN type = 'title' AND NOT (k > 1 AND length(text) > 15) THEN CASE WHEN k = 1 THEN 0 ELSE 2 END END AS level FROM t)
SELECT doc_id, count(*) FILTER (level = 0)::BIGINT AS first_titles, count(*) FILTER (level = 2)::BIGINT AS headings, count(*) FILTER (level IS NULL)::BIGINT AS paragraphs FROM l GROUP BY doc_id""")
def title_levels(spark, sf_dir):
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    out = corpus.infer_title_level(kept, max_len=15, patterns=())
    return out.groupBy("doc_id").agg(F.count_if(F.col("level") == 0).alias("first_titles"), F.count_if(F.col("level") == 2).alias("headings"), F.count_if(F.col("level").isNull()).alias("paragraphs"))


def sectioned(spark, sf_dir) -> DataFrame:
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    return corpus.section_path(corpus.infer_title_level(kept, max_len=60, patterns=()), "doc_id", "order").withColumn("doc_title", F.concat(F.lit("d"), "doc_id"))


@query(f"""WITH {UNITS_SQL}, t AS (SELECT *, CASE WHEN type = 'title' THEN row_number() OVER (PARTITION BY doc_id, type ORDER BY "order") END AS k FROM n WHERE reason IS NULL),
l AS (SELECT *, CASE WHEN type = 'title' AND k > 1 AND length(text) <= 60 THEN text END AS head, type = 'paragraph' OR (k > 1 AND length(text) > 60) AS body FROM t),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "order" ROWS UNBOUNDED PRECEDING) AS path FROM l)
SELECT doc_id, count(*)::BIGINT AS n_runs FROM (SELECT doc_id, path, lag(path) OVER w AS prev, row_number() OVER w AS r FROM s WHERE body WINDOW w AS (PARTITION BY doc_id ORDER BY "order"))
WHERE r = 1 OR path IS DISTINCT FROM prev GROUP BY doc_id""")
def section_run_counts(spark, sf_dir):
    runs = chunking.section_runs(sectioned(spark, sf_dir))
    return runs.groupBy("doc_id").agg(F.max("run_id").cast("long").alias("n_runs"))


@query(f"""WITH {UNITS_SQL}, t AS (SELECT *, CASE WHEN type = 'title' THEN row_number() OVER (PARTITION BY doc_id, type ORDER BY "order") END AS k FROM n WHERE reason IS NULL)
SELECT doc_id, sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS n_units FROM t WHERE type = 'paragraph' OR (k > 1 AND length(text) > 60) GROUP BY doc_id""")
def dp_chunks(spark, sf_dir):
    """Dynamic-programming chunks keep every unit once and every character."""
    runs = chunking.glue_cost(chunking.section_runs(sectioned(spark, sf_dir)))
    chunks = chunking.assemble_chunks(chunking.dp_segment(runs))
    return chunks.groupBy("doc_id").agg(F.sum(F.col("char_len") - (F.size("unit_ids") - 1)).cast("long").alias("chars"), F.sum(F.size("unit_ids")).cast("long").alias("n_units"))


@query()
def dp_chunk_report(spark, sf_dir):
    runs = chunking.glue_cost(chunking.section_runs(sectioned(spark, sf_dir)))
    return chunking.chunk_report(chunking.assemble_chunks(chunking.dp_segment(runs)))[1]


@query(f"WITH {UNITS_SQL} SELECT least(length(text) // 100 * 100, 900)::BIGINT AS bucket, count(*)::BIGINT AS n FROM n WHERE reason IS NULL GROUP BY 1")
def length_buckets(spark, sf_dir):
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    return chunking.chunk_report(kept.withColumn("char_len", F.length("text")))[0]


@query(f"""WITH {UNITS_SQL}, l AS (SELECT length(text) AS c, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS k FROM n WHERE reason IS NULL)
SELECT count(*)::BIGINT AS n, min(c) FILTER (r = floor(k * 0.1) + 1)::INTEGER AS p10, min(c) FILTER (r = floor(k * 0.5) + 1)::INTEGER AS p50, min(c) FILTER (r = floor(k * 0.9) + 1)::INTEGER AS p90,
max(c)::INTEGER AS max, count(*) FILTER (c < 120)::BIGINT AS n_short FROM l""")
def length_quantiles(spark, sf_dir):
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    return chunking.chunk_report(kept.withColumn("char_len", F.length("text")))[1]


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？；.!?;\\n]+[。！？；.!?;]?')) AS s FROM documents)
SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, trim(s, ' ') AS s FROM s) WHERE length(s) BETWEEN 10 AND 200 AND regexp_matches(s, 'the|der|que|de') AND length(regexp_replace(s, '[^$]', '', 'g')) < 4 GROUP BY doc_id""")
def trigger_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("unit_id"), "text", F.lit("paragraph").alias("type"))
    return graph.explode_sentences(rows, ["the", "der", "que", "de"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- text index and retrieval ----------------------------------------------------------------------------------------

WORD = r"[\p{L}]{2,}"
BM25_SQL = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]{2,}') AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, t, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) GROUP BY doc_id, t),
r AS (SELECT t, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY t),
i AS (SELECT t, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id AS qid, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{2,}')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id AS item_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN i USING (t) JOIN p USING (t), st GROUP BY ALL),
k AS (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 10)"""


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def document_index(spark, sf_dir) -> textindex.Index:
    """BM25 over documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("tokens"))
    return textindex.bm25_index(docs, "doc_id", "tokens", "chunk")


def benchmark_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), words("text").alias("tokens"))


def benchmark_ranks(spark, sf_dir) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    top = retrieval.bm25_topk(queries, document_index(spark, sf_dir), "chunk", 30)
    scored = top.withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item_id"))).filter("rank <= 10")


@query(f"WITH {BM25_SQL} SELECT * FROM k")
def bm25_top10(spark, sf_dir):
    return benchmark_ranks(spark, sf_dir)


def benchmark_gold(spark, sf_dir) -> DataFrame:
    """(qid, lang, item_id): documents that contain a benchmark text, found by its longest inner word, then by the text."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    inner = F.slice(F.split("q", r"\s+"), 2, F.greatest(F.size(F.split("q", r"\s+")) - 2, F.lit(1)))
    b = b.withColumn("w", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"])
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hit = d.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).join(b.select("w").distinct(), "w")
    return b.join(hit, "w").join(d, "doc_id").filter(F.contains("text", F.col("q"))).select("qid", "lang", F.col("doc_id").alias("item_id"))


@query(f"""WITH {BM25_SQL}, g AS (SELECT b.item_id AS qid, d.lang, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT g.qid, min(rank) AS hit FROM g JOIN k USING (qid, item_id) GROUP BY g.qid), a AS (SELECT DISTINCT qid, lang FROM g)
SELECT coalesce(lang, 'ALL') AS lang, count(*)::BIGINT AS n, round(avg((coalesce(hit, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(hit, 99) <= 3)::INT), 6) AS recall_3, round(avg((coalesce(hit, 99) <= 5)::INT), 6) AS recall_5,
round(avg((coalesce(hit, 99) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM a LEFT JOIN f USING (qid) GROUP BY ROLLUP (lang)""")
def retrieval_eval(spark, sf_dir):
    m = rank_eval.ranking_metrics(benchmark_ranks(spark, sf_dir), benchmark_gold(spark, sf_dir), by="lang")
    return m.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")])


@query()
def rank_fusion(spark, sf_dir):
    """BM25 over documents fused with BM25 over an index of their sub-chunks, each document at its best sub-chunk's place."""
    benchmark = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words("text").alias("tokens"))
    subs = textindex.split_subchunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    index = textindex.bm25_index(subs.select("sub_id", words("body").alias("tokens")), "sub_id", "tokens", "sub")
    parents = textindex.parent_of_subchunk("item_id", subs.schema["parent_id"].dataType.simpleString())
    fused = retrieval.rrf_fuse({"bm25": benchmark_ranks(spark, sf_dir), "sub": retrieval.subchunk_channel(benchmark, index, parents)})
    return fused.select("qid", "item_id", F.round("score", 9).alias("score"))


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]{2,}')) AS term FROM documents)
SELECT term, count(*)::BIGINT AS freq, row_number() OVER (ORDER BY count(*) DESC, term)::INTEGER AS rank FROM t GROUP BY term QUALIFY rank <= 40""")
def vocabulary_top(spark, sf_dir):
    return textindex.vocab_stats(document_index(spark, sf_dir))[1].select("term", "freq", "rank")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS item_id, round(list_dot_product(e, embedding::DOUBLE[]) / sqrt(list_dot_product(e, e)), 5) AS score FROM q, embeddings)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def dense_top5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    queries = rows.filter("item_id % 20 = 0").withColumnRenamed("item_id", "qid")
    top = retrieval.dense_topk(queries, rows, 15).withColumn("score", F.round("score", 5))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item_id"))).filter("rank <= 5")


@query(f"""WITH {UNITS_SQL} SELECT a.doc_id AS qid, a.doc_id || '-' || b."order" AS item_id, a.doc_id || '-' || a."order" AS from_id FROM u a JOIN u b ON a.doc_id = b.doc_id AND abs(a."order" - b."order") = 1""")
def neighbour_units(spark, sf_dir):
    """Every line is a hit."""
    rows = units(spark, sf_dir).select("doc_id", F.col("order").alias("seq"), F.col("unit_id").alias("chunk_id"), F.array().cast("array<string>").alias("section_path"))
    hits = rows.select(F.col("doc_id").alias("qid"), F.col("chunk_id").alias("item_id"))
    return retrieval.neighbors(hits, rows, 1, same_section=False)


@query(f"WITH {UNITS_SQL} SELECT doc_id, sum(length(text))::BIGINT AS chars FROM n WHERE reason IS NULL AND regexp_matches(text, '[^ ]') GROUP BY doc_id")
def subchunk_chars(spark, sf_dir):
    """Sub-chunks of all lines lose no character of their sentences."""
    kept, _ = corpus.drop_noise(units(spark, sf_dir), ["title", "paragraph"])
    subs = textindex.split_subchunks(kept.select(F.struct("doc_id", "order").cast("string").alias("chunk_id"), "text", "doc_id"), "chunk_id", "text")
    return subs.groupBy(F.regexp_extract("parent_id", r"\{(-?\d+)", 1).cast("long").alias("doc_id")).agg(F.sum(F.length("body")).alias("chars"))


# ---- evaluation, splits and samples ----------------------------------------------------------------------------------

RANKED_GROUPS = "g AS (SELECT source, row_number() OVER (ORDER BY md5('s1|' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))"


@query(f"WITH {RANKED_GROUPS} SELECT doc_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS split FROM documents JOIN g USING (source)")
def split_documents(spark, sf_dir):
    return D.split_by_group(table(spark, sf_dir, "documents"), "source", [("train", 0.7), ("dev", 0.1), ("test", 0.2)], "s1").select("doc_id", "split")


@query("""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('c|' || doc_id), doc_id) AS d FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('c|' || doc_id), doc_id) AS t FROM a WHERE d <= 5) SELECT doc_id, lang FROM b WHERE t <= 40""")
def capped_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"), "source")
    return rank_eval.cap_sample(rows, {}, 5, "c", 40, "source", "doc_id").select("doc_id", F.col("type").alias("lang"))


@query("""WITH c AS (SELECT lang, count(*) AS k FROM documents GROUP BY lang), e AS (SELECT lang, k, k * 100 / sum(k) OVER () AS x FROM c),
q AS (SELECT lang, least(floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) <= 100 - sum(floor(x)) OVER () THEN 1 ELSE 0 END, k) AS quota FROM e)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('p|' || doc_id), doc_id) AS r FROM documents) JOIN q USING (lang) WHERE r <= quota""")
def proportional_documents(spark, sf_dir):
    return D.proportional_sample(table(spark, sf_dir, "documents"), "lang", 100, "p", "doc_id").select("doc_id", "lang")


@query("""WITH a AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents GROUP BY lang), b AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round(coalesce(a.s, 0), 6) AS share_a, round(coalesce(b.s, 0), 6) AS share_b, round(abs(coalesce(a.s, 0) - coalesce(b.s, 0)), 6) AS drift FROM a FULL JOIN b USING (lang)""")
def language_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = D.distribution_drift(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "lang")
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("share_a", "share_b", "drift")])


@query("""WITH p AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), x AS (SELECT a, sum(n) AS na FROM p GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM p GROUP BY b),
e AS (SELECT sum(power(a - b, 2) * na * nb) AS e FROM x, y), o AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (a = b) / sum(n) AS exact, sum(n * power(a - b, 2)) AS o FROM p)
SELECT n, round(coalesce(exact, 0), 6) AS exact, round(CASE WHEN e > 0 THEN 1 - o * n / e END, 6) AS kappa FROM o, e""")
def label_agreement(spark, sf_dir):
    return rank_eval.agreement(table(spark, sf_dir, "labels"), "quality", "toxic", 2, 1)[0].select("n", F.round("exact", 6).alias("exact"), F.round("kappa", 6).alias("kappa"))


@query("SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*)::BIGINT AS n FROM documents GROUP BY CUBE (lang, source)")
def document_distribution(spark, sf_dir):
    return datasets.distribution_report(table(spark, sf_dir, "documents"), ["lang", "source"]).drop("share")


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY md5('f|' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM documents")
def document_folds(spark, sf_dir):
    return D.stratified_folds(table(spark, sf_dir, "documents"), "lang", 5, "f", "doc_id").select("doc_id", "fold")


# ---- knowledge graph: triples of the trade tables --------------------------------------------------------------------

TRIPLES_SQL = """t AS (SELECT 'supplier' || s_suppkey AS head, 'supplier' AS head_type, 'IN' AS relation, n_name AS tail, 'nation' AS tail_type, 1 AS support FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'nation', 'PART_OF', r_name, 'region', 2 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_mktsegment, 'segment', 'SOLD_IN', n_name, 'nation', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def triples(spark, sf_dir) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    own = lambda h, ht, rel, tl, tt, n: [h.alias("head"), F.lit(ht).alias("head_type"), F.lit(rel).alias("relation"), tl.alias("tail"), F.lit(tt).alias("tail_type"), n.cast("long").alias("support_count")]
    a = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*own(F.concat(F.lit("supplier"), "s_suppkey"), "supplier", "IN", F.col("n_name"), "nation", F.lit(1)))
    b = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*own(F.col("n_name"), "nation", "PART_OF", F.col("r_name"), "region", F.lit(2)))
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").count().select(*own(F.col("c_mktsegment"), "segment", "SOLD_IN", F.col("n_name"), "nation", F.col("count")))
    return a.unionByName(b).unionByName(c)


def edges(spark, sf_dir) -> DataFrame:
    return triples(spark, sf_dir).withColumnsRenamed({"head": "source", "tail": "target"}).withColumn("confidence", F.lit(0.6))


@query(f"""WITH {TRIPLES_SQL}, e AS (SELECT head AS name, head_type AS type FROM t UNION ALL SELECT tail, tail_type FROM t) SELECT name, type, count(*)::BIGINT AS degree FROM e GROUP BY ALL""")
def graph_nodes(spark, sf_dir):
    rows = triples(spark, sf_dir).withColumn("doc_ids", F.array().cast("array<string>"))
    return graph.build_nodes_edges(rows)[0].select("name", "type", "degree")


@query(f"WITH {TRIPLES_SQL} SELECT CASE relation WHEN 'SOLD_IN' THEN 'unknown_relation' WHEN 'PART_OF' THEN 'bad_tail_type' END AS reason, count(*)::BIGINT AS count FROM t WHERE relation <> 'IN' GROUP BY 1")
def triple_rejects(spark, sf_dir):
    allowed = spark.createDataFrame([("IN", "supplier", "nation"), ("PART_OF", "nation", "planet")], "relation string, head_type string, tail_type string")
    return graph.check_triples(triples(spark, sf_dir), allowed)[1]


@query(f"WITH {TRIPLES_SQL} SELECT x.head AS a, x.relation AS r1, x.tail AS b, y.relation AS r2, y.tail AS c, (x.support + y.support)::BIGINT AS support FROM t x JOIN t y ON x.tail = y.head WHERE x.relation = 'IN' AND y.relation = 'PART_OF'")
def two_hop(spark, sf_dir):
    return graph.two_hop_pairs(edges(spark, sf_dir), [("IN", "PART_OF")])


@query(f"""WITH {TRIPLES_SQL}, p AS (SELECT x.head AS qid, x.head || '|' || x.relation || '|' || x.tail AS path, x.support AS support, 1 AS n_hops FROM t x WHERE x.relation = 'IN'
UNION ALL SELECT x.head, x.head || '|IN|' || x.tail || '|PART_OF|' || y.tail, least(x.support, y.support), 2 FROM t x JOIN t y ON x.tail = y.head AND y.relation = 'PART_OF' WHERE x.relation = 'IN')
SELECT qid, path, support::BIGINT AS support, n_hops FROM p""")
def graph_paths(spark, sf_dir):
    e = edges(spark, sf_dir)
    starts = e.filter("relation = 'IN'").select(F.col("source").alias("qid"), F.col("source").alias("entity"))
    return graph.expand_paths(starts, e, ["IN", "PART_OF"], 2, "out").select("qid", F.array_join("path", "|").alias("path"), "support", "n_hops")


@query(f"""WITH {TRIPLES_SQL}, s AS (SELECT head AS anchor, relation, array_to_string(list_sort(list(DISTINCT tail)), ',') AS expected, max(support)::BIGINT AS max_support, 'out' AS direction FROM t GROUP BY ALL
UNION ALL SELECT tail, relation, array_to_string(list_sort(list(DISTINCT head)), ','), max(support)::BIGINT, 'in' FROM t GROUP BY ALL) SELECT * FROM s""")
def graph_questions(spark, sf_dir):
    return graph.relation_qa_seeds(edges(spark, sf_dir)).select("anchor", "relation", F.array_join("expected", ",").alias("expected"), "max_support", "direction")


@query(f"""WITH {TRIPLES_SQL}, a AS (SELECT *, support >= 2 AS high, row_number() OVER (PARTITION BY relation, support >= 2 ORDER BY md5('e|' || head || '|' || relation || '|' || tail)) AS r FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY CASE WHEN r <= 3 THEN 0 ELSE 1 END, r, CASE WHEN high THEN 0 ELSE 1 END) AS p FROM a) SELECT head AS source, relation, tail AS target FROM b WHERE p <= 6""")
def edge_sample(spark, sf_dir):
    return graph.stratified_edge_sample(edges(spark, sf_dir), 6, "e").select("source", "relation", "target")


# ---- measurement records: a user's events by type are five measures --------------------------------------------------

EVENT_TYPES_SQL = "y AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))"
_PIVOT = ", ".join(f"round(sum(value) FILTER (i = {i}), 3) AS {g}" for i, g in enumerate(records.GASES, 1))
RECORDS_SQL = f"{EVENT_TYPES_SQL}, g AS (SELECT user_id, ts::DATE AS day, {_PIVOT} FROM events JOIN y USING (event_type) GROUP BY ALL)"


def measures(spark, sf_dir, by_day: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.broadcast(e.select("event_type").distinct().withColumn("i", F.row_number().over(Window.orderBy("event_type"))))  # the five event types
    keys = ["user_id", F.to_date("ts").alias("day")] if by_day else ["user_id"]
    return e.join(kinds, "event_type").groupBy(*keys).agg(*[F.round(F.sum(F.when(F.col("i") == i, F.col("value"))), 3).alias(g) for i, g in enumerate(records.GASES, 1)])


_EV = ", ".join(f"CASE WHEN {g} > {t} THEN true WHEN {g} IS NOT NULL THEN false END AS {g}_elevated" for g, t in records.ATTENTION.items())
EVIDENCE_SQL = f"v AS (SELECT *, {_EV}, CASE WHEN CH4 + C2H2 + C2H4 + C2H6 > 150 THEN true WHEN CH4 + C2H2 + C2H4 + C2H6 IS NOT NULL THEN false END AS TDCG_elevated, CASE WHEN C2H2 > 50 THEN true WHEN C2H2 IS NOT NULL THEN false END AS gas_rate_rapid FROM g)"
SYMPTOMS = [*[f"{g}_elevated" for g in records.GASES], "TDCG_elevated", "gas_rate_rapid"]


@query(f"WITH {RECORDS_SQL}, {EVIDENCE_SQL} SELECT user_id, day::VARCHAR AS day, {', '.join(SYMPTOMS)} FROM v")
def evidence(spark, sf_dir):
    return records.derive_evidence(measures(spark, sf_dir)).select("user_id", F.col("day").cast("string").alias("day"), *SYMPTOMS)


def _code(num: str, den: str, low: int, mid: int, high: int, a: float, b: float) -> str:
    return f"CASE WHEN {den} = 0 THEN 1 WHEN {num} / {den} < {a} THEN {low} WHEN {num} / {den} < {b} THEN {mid} WHEN {num} / {den} IS NOT NULL THEN {high} END"


CODES_SQL = f"c AS (SELECT *, {_code('C2H2', 'C2H4', 0, 1, 2, 0.1, 3)} AS code1, {_code('CH4', 'H2', 1, 0, 2, 0.1, 1)} AS code2, {_code('C2H4', 'C2H6', 0, 1, 2, 1, 3)} AS code3 FROM v)"
FAULTS = sorted({f for r in records.RATIO_RULES for f in r[4]})
_BOOST = ", ".join(
    "CASE WHEN H2 + CH4 + C2H2 + C2H4 + C2H6 IS NULL THEN 0 ELSE greatest(0, " + ", ".join(f"CASE WHEN code1 IN ({', '.join(map(str, a))}) AND code2 IN ({', '.join(map(str, b))}) AND code3 IN ({', '.join(map(str, c))}) THEN {w} ELSE 0 END" for _, a, b, c, fs, w in records.RATIO_RULES if f in fs) + f") END AS boost_{f}"
    for f in FAULTS
)
BOOST_SQL = f"b AS (SELECT *, {_BOOST} FROM c)"


def boosted(spark, sf_dir, by_day: bool = True) -> DataFrame:
    return records.match_rules(records.ratio_codes(records.derive_evidence(measures(spark, sf_dir, by_day))), FAULTS)


@query(f"WITH {RECORDS_SQL}, {EVIDENCE_SQL}, {CODES_SQL}, {BOOST_SQL} SELECT user_id, day::VARCHAR AS day, code1, code2, code3, {', '.join(f'boost_{f}::DOUBLE AS boost_{f}' for f in FAULTS)} FROM b")
def ratio_rules(spark, sf_dir):
    return boosted(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), "code1", "code2", "code3", *[f"boost_{f}" for f in FAULTS])


#: A stated parameter set for the queries: prior by class, p_true by class and symptom.
PRIOR = {f: round((i + 1) / sum(range(1, len(FAULTS) + 1)), 4) for i, f in enumerate(FAULTS)}
CPT = {f: {s: round(0.1 + 0.8 * ((3 * i + 5 * j) % 11) / 10, 3) for j, s in enumerate(SYMPTOMS)} for i, f in enumerate(FAULTS)}
_LIKE = ", ".join(f"{PRIOR[f]}" + "".join(f" * CASE WHEN {s} THEN {CPT[f][s]} WHEN NOT {s} THEN {round(1 - CPT[f][s], 3)} ELSE 1 END" for s in SYMPTOMS) + f" AS l_{f}" for f in FAULTS)
_SUM = " + ".join(f"l_{f}" for f in FAULTS)
_FUSE = ", ".join(f"CASE WHEN boost_{f} > 0 THEN 0.7 * l_{f} / z + 0.3 * boost_{f} ELSE l_{f} / z END AS m_{f}" for f in FAULTS)
POSTERIOR_SQL = f"""l AS (SELECT *, {_LIKE} FROM b), z AS (SELECT *, {_SUM} AS z FROM l), m AS (SELECT *, {_FUSE} FROM z), o AS (SELECT *, {' + '.join(f'm_{f}' for f in FAULTS)} AS zz FROM m),
x AS (SELECT *, {', '.join(f'm_{f} / zz AS p_{f}' for f in FAULTS)} FROM o)"""
SCORED_SQL = f"{RECORDS_SQL}, {EVIDENCE_SQL}, {CODES_SQL}, {BOOST_SQL}, {POSTERIOR_SQL}"


def scored(spark, sf_dir, by_day: bool = True) -> DataFrame:
    rows = bayes.naive_bayes_posterior(boosted(spark, sf_dir, by_day), PRIOR, CPT, SYMPTOMS)
    return bayes.fuse_rules(rows, FAULTS)


@query(f"WITH {SCORED_SQL} SELECT user_id, day::VARCHAR AS day, {', '.join(f'round(p_{f}, 6) AS p_{f}' for f in FAULTS)} FROM x")
def posterior(spark, sf_dir):
    return scored(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), *[F.round(f"p_{f}", 6).alias(f"p_{f}") for f in FAULTS])


_T = ", ".join(f"power(greatest(p_{f}, 1e-12), 1 / 1.5) AS t_{f}" for f in FAULTS)
_TS = " + ".join(f"t_{f}" for f in FAULTS)


@query(f"WITH {SCORED_SQL}, t AS (SELECT *, {_T} FROM x), s AS (SELECT *, {_TS} AS ts FROM t) SELECT user_id, day::VARCHAR AS day, round({' + '.join(f'(-t_{f} / ts * log2(t_{f} / ts))' for f in FAULTS)}, 5) AS entropy, round(greatest({', '.join(f't_{f}' for f in FAULTS)}) / ts, 5) AS top1_prob FROM s")
def entropy_report(spark, sf_dir):
    rows = bayes.uncertainty(bayes.temperature_scale(scored(spark, sf_dir), FAULTS, 1.5), FAULTS)
    return rows.select("user_id", F.col("day").cast("string").alias("day"), F.round("entropy", 5).alias("entropy"), F.round("top1_prob", 5).alias("top1_prob"))


_TRUTH = "CASE greatest(coalesce(H2, -1), coalesce(CH4, -1), coalesce(C2H2, -1), coalesce(C2H4, -1), coalesce(C2H6, -1)) " + " ".join(f"WHEN {g} THEN '{FAULTS[i]}'" for i, g in enumerate(records.GASES)) + " END"


def labelled(spark, sf_dir, by_day: bool = True) -> DataFrame:
    """Scored rows with a fault by a fixed rule: which measure is the largest."""
    top = F.greatest(*[F.coalesce(g, F.lit(-1.0)) for g in records.GASES])
    truth = F.lit(None).cast("string")
    for i, g in reversed(list(enumerate(records.GASES))):
        truth = F.when(F.col(g) == top, FAULTS[i]).otherwise(truth)
    return scored(spark, sf_dir, by_day).withColumn("fault", truth)


_OWN = "CASE fault " + " ".join(f"WHEN '{f}' THEN p_{f}" for f in FAULTS) + " END"
_CONF = f"greatest({', '.join(f'p_{f}' for f in FAULTS)})"


@query(f"""WITH {SCORED_SQL}, f AS (SELECT *, {_TRUTH} AS fault FROM x), r AS (SELECT {_OWN} AS own, {_CONF} AS conf, {' + '.join(f"power(p_{f} - (fault = '{f}')::INT, 2)" for f in FAULTS)} AS brier FROM f),
bins AS (SELECT least(floor(conf * 15), 14)::BIGINT AS bin, count(*)::BIGINT AS n, avg(conf) AS c, avg((own = conf)::INT) AS a, sum(-ln(greatest(own, 1e-12))) AS nll, sum(brier) AS brier FROM r GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(a * n) / sum(n), 5) AS top1, round(sum(nll) / sum(n), 5) AS nll, round(sum(brier) / sum(n), 5) AS brier, round(sum(abs(c - a) * n) / sum(n), 5) AS ece FROM bins""")
def calibration(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return bayes.calibration_metrics(rows, FAULTS, "fault")[0].select("n", *[F.round(c, 5).alias(c) for c in ("top1", "nll", "brier", "ece")])


@query(f"""WITH {RECORDS_SQL}, {EVIDENCE_SQL}, f AS (SELECT *, {_TRUTH} AS class FROM v), c AS (SELECT class, count(*) AS n, {', '.join(f'count(*) FILTER ({s}) AS "{s}"' for s in SYMPTOMS)} FROM f GROUP BY class),
u AS (UNPIVOT c ON {', '.join(f'"{s}"' for s in SYMPTOMS)} INTO NAME symptom VALUE pos)
SELECT class, symptom, n::BIGINT AS n, pos::BIGINT AS pos, CASE WHEN sum(pos) OVER w = 0 THEN 0.5 ELSE round((pos + 1) / (n + 2), 5) END AS p_true, CASE WHEN sum(pos) OVER w = 0 THEN 0.5 ELSE round((sum(pos) OVER w - pos + 1) / (sum(n) OVER w - n + 2), 5) END AS p_false FROM u WINDOW w AS (PARTITION BY symptom)""")
def learned_parameters(spark, sf_dir):
    return bayes.learned_table(labelled(spark, sf_dir), "fault", SYMPTOMS)


@query()
def cross_validation(spark, sf_dir):
    rows = D.stratified_folds(labelled(spark, sf_dir), "fault", 3, "cv", "user_id")
    rows = rows.withColumn("half", F.pmod(D.hash_number("h", "user_id", "day"), F.lit(2)))
    out = bayes.cross_validate(rows, "fault", FAULTS, SYMPTOMS)
    return out.select(F.col("fold").cast("long").alias("fold"), *[F.round(c, 5).alias(c) for c in ("nll_default", "nll_weights", "nll_both", "t")])


_MIXED = [f"CASE WHEN boost_{f} > 0 THEN {'g' if i == 0 else '0.7'} * l_{f} / z + (1 - {'g' if i == 0 else '0.7'}) * boost_{f} ELSE l_{f} / z END" for i, f in enumerate(FAULTS)]


@query(f"""WITH {SCORED_SQL}, tried AS (SELECT *, {_TRUTH} AS fault, user_id % 2 AS half, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS g FROM z),
won AS (SELECT half, g, CASE fault {' '.join(f"WHEN '{f}' THEN {m}" for f, m in zip(FAULTS, _MIXED))} END / ({' + '.join(_MIXED)}) AS p FROM tried) SELECT half::BIGINT AS half, g AS value, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM won WHERE p IS NOT NULL GROUP BY half, g""")
def fusion_sweep(spark, sf_dir):
    """One coordinate round of fitting: the loss for every weight of the first fault, in two halves at once."""
    table_ = bayes.patterns(labelled(spark, sf_dir).withColumn("half", F.col("user_id") % 2), "fault", SYMPTOMS, FAULTS, ["half"])
    scored_ = fusion.score_patterns(table_.select("*", *fusion.stated_params(PRIOR, CPT, FAULTS, SYMPTOMS)), FAULTS, SYMPTOMS)
    out = fusion.sweep(scored_, ["half"], F.array(*[F.lit(0.7)] * len(FAULTS)), 0)
    return out.select("half", "value", F.round("nll", 6).alias("nll"))


@query()
def next_questions(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("record", F.concat_ws("-", "user_id", "day"))
    gains = bayes.information_gain(rows, "record", FAULTS, SYMPTOMS, PRIOR, CPT)
    costs = spark.createDataFrame([(s, 0.0 if i < 5 else 0.5) for i, s in enumerate(SYMPTOMS)], "symptom string, cost double")
    return bayes.recommend(gains, "record", costs).select("record", "rank", "symptom", "voi", "action")


_MASK = ", ".join(f"{{'k': md5('m|' || user_id || '|{g}'), 'm': '{g}'}}" for g in records.GASES)


@query(f"""WITH {EVENT_TYPES_SQL}, g AS (SELECT user_id, {_PIVOT} FROM events JOIN y USING (event_type) GROUP BY user_id), o AS (SELECT *, list_transform(list_sort([{_MASK}]), lambda z: z.m) AS o FROM g)
SELECT user_id || '-' || level AS sim_id, array_to_string(list_sort(o[1:k]), ',') AS masked, {', '.join(f"CASE WHEN NOT list_contains(o[1:k], '{g}') THEN {g} END AS visible_{g}" for g in records.GASES)} FROM o, (VALUES ('light', 1), ('medium', 2), ('heavy', 3)) AS l(level, k)""")
def masked_records(spark, sf_dir):
    out = records.mask_measures(measures(spark, sf_dir, False), "user_id", seed="m")
    return out.select("sim_id", F.array_join("masked", ",").alias("masked"), *[f"visible_{g}" for g in records.GASES])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, round(l_quantity, 0), round(l_discount, 2) ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_returnflag, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM r WHERE k = 1 GROUP BY 1""")
def rounded_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.round(F.col("l_quantity").cast("double"), 0).alias("q"), F.round(F.col("l_discount").cast("double"), 2).alias("d"))
    out = records.dedup_rounded(rows, ["q", "d"], "l_returnflag", ["l_orderkey", "l_linenumber"])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("SELECT l_returnflag, count(*)::BIGINT AS count FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1")
def skipped_labels(spark, sf_dir):
    mapping = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "label string, fault string")
    return records.map_labels(table(spark, sf_dir, "lineitem"), mapping, "l_returnflag")[1]


@query("""WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 25 THEN 'A' WHEN l_discount > 0.05 THEN 'R' ELSE 'N' END AS p FROM lineitem), c AS (SELECT unnest(['A', 'N', 'R']) AS class),
s AS (SELECT class, count(*) FILTER (y = class)::BIGINT AS support, count(*) FILTER (p = class)::BIGINT AS predicted, count(*) FILTER (y = class AND p = class)::BIGINT AS tp FROM p, c GROUP BY class)
SELECT class, support, predicted, tp, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall FROM s""")
def class_metrics(spark, sf_dir):
    pred = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_discount") > 0.05, "R").otherwise("N")
    out = bayes.class_report(table(spark, sf_dir, "lineitem").withColumn("pred", pred), "l_returnflag", "pred")
    return out.filter("class not in ('MACRO', 'WEIGHTED')").select("class", "support", "predicted", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# ---- series ----------------------------------------------------------------------------------------------------------

HOURLY_SQL = "h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value, count(*) AS k FROM events GROUP BY ALL)"


def hourly(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("k"))


@query(f"WITH {HOURLY_SQL}, g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY series_id) SELECT series_id, count(*)::BIGINT AS n, count(*) FILTER (h.ts IS NULL)::BIGINT AS missing FROM g LEFT JOIN h USING (series_id, ts) GROUP BY series_id")
def regular_grid(spark, sf_dir):
    return series.regularize(hourly(spark, sf_dir)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_missing").alias("missing"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT series_id, row_number() OVER o AS i, first_value(ts) OVER f AS start, ts AS "end", round(avg(value) OVER f, 4) AS mean, round(coalesce(stddev_samp(value) OVER f, 0), 4) AS std, count(*) OVER f AS n FROM h
WINDOW o AS (PARTITION BY series_id ORDER BY ts), f AS (PARTITION BY series_id ORDER BY ts ROWS 23 PRECEDING)) SELECT series_id, ((i - 24) // 12)::BIGINT AS window, start, "end", mean, std FROM w WHERE n = 24 AND (i - 24) % 12 = 0""")
def moving_windows(spark, sf_dir):
    return series.sliding_windows(hourly(spark, sf_dir), 24, 12, "value").select("series_id", "window", "start", "end", "mean", "std")


@query("SELECT user_id, event_type, count(value)::BIGINT AS n, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def value_stats(spark, sf_dir):
    return series.window_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 8)


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1 HAVING count(value) >= 3 AND stddev_samp(value) > 0) SELECT event_id, event_type, round(m, 4) AS mean FROM events JOIN s USING (event_type) WHERE abs(value - m) > 3 * d""")
def three_sigma(spark, sf_dir):
    return series.anomalies_3sigma(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "event_type", F.round("mean", 4).alias("mean"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def latest_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return series.latest_n(rows, 3, "user_id", "at").select("event_id", "user_id")


@query(f"WITH {HOURLY_SQL} SELECT series_id, count(*)::BIGINT AS n, round(regr_slope(value, k::DOUBLE), 3) AS slope, round(regr_r2(value, k::DOUBLE), 3) AS r2 FROM h GROUP BY series_id HAVING count(*) >= 10")
def linear_fit(spark, sf_dir):
    fit = series.fit_linear(hourly(spark, sf_dir), ["k"], "value")
    return fit.select("series_id", "n", F.round(F.col("coef")["k"], 3).alias("slope"), F.round("r2", 3).alias("r2"))


@query("SELECT user_id AS series_id, count(*)::BIGINT AS n, min(ts) AS start, max(ts) AS \"end\" FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY user_id")
def profile_in_range(spark, sf_dir):
    rows = series.range_window(table(spark, sf_dir, "events"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return series.series_profile(rows.withColumnRenamed("user_id", "series_id"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(value)::BIGINT AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std FROM events GROUP BY ALL")
def stream_window_stats(spark, sf_dir):
    out = anomalies.windowed_stats(table(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# ---- training sets ---------------------------------------------------------------------------------------------------

@query("""WITH w AS (SELECT conv_id, turn, role, text, count(*) OVER p AS before, coalesce(sum(length(text)) OVER p, 0) AS chars, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, k::BIGINT AS decision_index, before::INTEGER AS n_messages, chars::BIGINT AS chars, md5(text) AS target FROM w WHERE role = 'assistant'""")
def chat_prefixes(spark, sf_dir):
    rows = datasets.decision_prefixes(table(spark, sf_dir, "conversations"))
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["text"])).cast("long")
    return rows.select("conv_id", "turn", "decision_index", F.size("messages").alias("n_messages"), chars.alias("chars"), F.md5("target").alias("target"))


@query("""WITH a AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 5 = 3 THEN 'bad_arguments' END, CASE WHEN turn % 7 = 1 THEN 'bad_order' END, CASE WHEN turn % 3 = 1 THEN 'unknown_function' END, CASE WHEN turn % 7 = 1 THEN 'unmatched_id' END) AS errors FROM a""")
def chat_export_errors(spark, sf_dir):
    """Each answer after a call and its result, exported and checked. Some calls name no known tool, some have broken arguments,
    some have two results for one call."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    calls = lambda on: F.when(on, F.array(F.struct(F.when(F.col("turn") % 3 == 1, "gone").otherwise("look").alias("name"), F.when(F.col("turn") % 5 == 3, "{").otherwise('{"q":1}').alias("arguments"))))
    turn = lambda role, text, c: F.struct(F.lit(role).alias("role"), text.alias("text"), c.alias("tool_calls"))
    none = calls(F.lit(False))
    result = turn("tool", F.lit("[]"), none)
    messages = F.concat(F.array(turn("user", F.lit("?"), none), turn("assistant", F.lit(""), calls(F.lit(True))), result), F.when(F.col("turn") % 7 == 1, F.array(result)).otherwise(F.slice(F.array(result), 1, 0)))
    out = datasets.validate_chat(datasets.export_chat(rows.select("conv_id", "turn", messages.alias("messages"), F.col("text").alias("target"))), tools=["look"])
    return out.select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query()
def leaking_texts(spark, sf_dir):
    """Whole turns of training conversations that are alike to turns of test conversations, a fifth, to more than 0.9.

    All pairs of whole texts are too many for SQL; tests hold it against brute force.
    """
    rows = D.split_by_group(table(spark, sf_dir, "conversations"), "conv_id", [("train", 0.8), ("test", 0.2)], "leaks")
    side = lambda name: rows.filter(F.col("split") == name).select(F.struct("conv_id", "turn").alias(f"{name}_id"), "text")
    leaks = datasets.near_duplicate_leaks(side("train"), side("test"))
    return leaks.select(*[F.col(f"{s}_id.{c}").alias(f"{s}_{c}") for s in ("train", "test") for c in ("conv_id", "turn")], F.round("jaccard", 6).alias("jaccard"))


@query("""SELECT l_orderkey, max(struct_pack(s := l_discount, i := l_linenumber)).i AS chosen, min(struct_pack(s := l_discount, i := l_linenumber)).i AS rejected, round((max(l_discount) - min(l_discount))::DOUBLE, 6) AS gap FROM lineitem GROUP BY l_orderkey HAVING round((max(l_discount) - min(l_discount))::DOUBLE, 6) >= 0.05""")
def preference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").cast("double").alias("score"), F.col("l_linenumber").alias("candidate_id"))
    return datasets.preference_pairs(rows, "l_orderkey", "score", "candidate_id", 0.05)


@query("""WITH q(event_type, n) AS (SELECT event_type, 5 + 400 * ((row_number() OVER (ORDER BY event_type)) % 2) FROM (SELECT DISTINCT event_type FROM events)),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('q|' || event_id), event_id) AS k FROM events) SELECT event_id, event_type FROM r JOIN q USING (event_type) WHERE k <= n""")
def quota_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    quota = e.select("event_type").distinct().withColumn("n", 5 + 400 * (F.row_number().over(Window.orderBy("event_type")) % 2))
    return D.quota_sample(e, "event_type", quota, "q", "event_id")[0].select("event_id", "event_type")


# ---- logs, claims and policies ---------------------------------------------------------------------------------------

@query("""SELECT coalesce(l_linestatus, 'ALL') AS l_linestatus, count(*)::BIGINT AS n, round(avg((l_quantity > 25)::INT), 6) AS large, round(avg((l_discount > 0.05)::INT) FILTER (l_returnflag = 'R'), 6) AS cheap, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_cheap FROM lineitem GROUP BY ROLLUP (l_linestatus)""")
def metric_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).alias("large"), F.when(F.col("l_returnflag") == "R", F.col("l_discount") > 0.05).alias("cheap"))
    return logs.summarize(rows, ["large", "cheap"], "l_linestatus").select("l_linestatus", "n", F.round("large", 6).alias("large"), F.round("cheap", 6).alias("cheap"), "n_cheap")


@query("""WITH h AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT event_id, CASE WHEN h.user_id IS NOT NULL THEN 'made' ELSE 'repeated' END AS reason FROM p LEFT JOIN h USING (user_id, event_type) WHERE h.user_id IS NOT NULL OR r > 1""")
def repeated_calls(spark, sf_dir):
    """The second half of the month against the first, the calls already made."""
    rows = table(spark, sf_dir, "events").withColumns({"signature": F.col("event_type"), "at": F.struct("ts", "event_id")})
    since = F.lit("2024-01-16 00:00:00").cast(rows.schema["ts"].dataType)
    return logs.duplicate_calls(rows.filter(F.col("ts") < since), rows.filter(F.col("ts") >= since), "user_id", "at")[1].select("event_id", "reason")


VIOLATED = "CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'DATA' WHEN l_returnflag = 'A' AND l_tax > 0.07 THEN 'EVIDENCE' END"


@query(f"""WITH c AS (SELECT l_orderkey, {VIOLATED} AS x, l_linestatus = 'O' AS obs, l_quantity > 10 AS supported FROM lineitem), b AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (NOT supported OR coalesce(x = 'EVIDENCE', false)) AS bad, count(*) FILTER (x = 'DATA') AS hard, count(*) FILTER (obs AND x = 'EVIDENCE') AS fab FROM c GROUP BY 1)
SELECT o_orderkey AS item_id, coalesce(n, 0)::BIGINT AS n_claims, round(coalesce(bad / n, 1), 6) AS unsupported_ratio, CASE WHEN coalesce(hard, 0) = 0 AND coalesce(fab, 0) = 0 AND coalesce(bad / n, 1) <= 0.3 THEN 'PASS' WHEN o_orderkey % 4 >= 3 THEN 'ABSTAIN' ELSE 'REVISION' END AS verdict FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""")
def claim_verdicts(spark, sf_dir):
    x = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), "DATA").when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07), "EVIDENCE")
    checks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("id"), F.when(F.col("l_linestatus") == "O", "observation").otherwise("mechanism").alias("type"), F.array_compact(F.array(x)).alias("violated"), (F.col("l_quantity") > 10).alias("supported"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 4).alias("iteration"))
    return claims.claim_verdict(checks, items).withColumn("unsupported_ratio", F.round("unsupported_ratio", 6))


SNAPS = "s AS (SELECT l_orderkey AS traj_id, l_linenumber AS q, min(l_discount) * 20 AS entropy, min(l_quantity) AS n_cands, min(l_tax) AS best_voi, l_linenumber - 1 AS n_queries FROM lineitem GROUP BY ALL)"


@query(f"""WITH {SNAPS}, r AS (SELECT *, CASE WHEN entropy < 0.3 THEN 'entropy' WHEN n_cands = 0 THEN 'no_candidates' WHEN best_voi < 0.02 THEN 'voi' WHEN n_queries >= 3 THEN 'budget' END AS reason FROM s)
SELECT traj_id, coalesce(min(q) FILTER (reason IS NOT NULL), max(q))::INTEGER AS q, coalesce(arg_min(reason, q) FILTER (reason IS NOT NULL), 'exhausted') AS reason FROM r GROUP BY traj_id""")
def stop_points(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("traj_id"), F.col("l_linenumber").cast("int").alias("q"))
    snaps = rows.agg((F.min("l_discount") * 20).alias("entropy"), F.min("l_quantity").alias("n_cands"), F.min("l_tax").alias("best_voi")).withColumn("n_queries", F.col("q") - 1)
    return policy.stop_index(snaps, tau=0.3)


@query("""WITH i AS (SELECT event_type AS arm, user_id % 3 AS type, user_id % 5 AS sub, event_id % 3 <> 0 AS injected, CASE WHEN value > 60 THEN 'PASS' ELSE 'REVISION' END AS v FROM events)
SELECT arm, type, sub AS subtype, count(*) FILTER (injected)::BIGINT AS n, round(avg((v <> 'PASS')::INT) FILTER (injected), 6) AS detected, round(avg((v <> 'PASS')::INT) FILTER (NOT injected), 6) AS false_positive FROM i GROUP BY GROUPING SETS ((arm), (arm, type), (arm, sub))""")
def detection(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("eval_id", F.col("event_id"))
    empty = F.array().cast("array<string>")
    runs = rows.select("eval_id", F.col("event_type").alias("arm"), F.when(F.col("value") > 60, "PASS").otherwise("REVISION").alias("verdict"), empty.alias("violated"))
    injected = rows.select("eval_id", (F.col("user_id") % 3).alias("type"), (F.col("user_id") % 5).alias("subtype"), (F.col("event_id") % 3 != 0).alias("injected"), empty.alias("expected"))
    out = claims.detection_report(runs, injected)
    return out.select("arm", "type", "subtype", "n", F.round("detected", 6).alias("detected"), F.round("false_positive", 6).alias("false_positive"))


@query()
def permutation_test(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("a", F.col("value") * 1.0)
    return policy.paired_permutation(rows.withColumn("b", F.lit(50.0)), "a", "b")

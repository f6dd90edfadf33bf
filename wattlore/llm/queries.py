"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digest, format_chats, read_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = materialize(format_chats(turns.unionByName(extra)), "chats")
    return chat_digest(read_chats(formatted))


SQL_OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)((?:/?s>)|(?:/?(?:ROLE|INST)\])|(?:TURN\]))', '\1\\\2\3', 'g') AS esc,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS first FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN first THEN length('<s>[ROLE]' || role || '[/ROLE]</s>') ELSE length('[TURN]') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_archives

    return read_archives(archive_pages(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to
FROM g
"""

def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest = materialize(write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")), "manifest")
    return read_token_files(manifest)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_groups

    return ngram_jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


SQL_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 90 * (na + nb - shared)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.doc_id WHERE r.root < t.b),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN m USING (doc_id)
"""

#: Fixed values of the rule list: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op7_sql(rounds: int = 10) -> str:
    steps = [
        f"""k{i} AS (SELECT kind, host, sum(m)::DOUBLE AS m FROM (SELECT kind, host, 0.15 * w AS m FROM s UNION ALL
  SELECT e.kind, e.dst, 0.85 * k.m * e.n / d.n FROM k{i - 1} k JOIN e ON e.kind = k.kind AND e.src = k.host JOIN d ON d.kind = e.kind AND d.src = e.src) GROUP BY kind, host)"""
        for i in range(1, rounds + 1)
    ]
    rules = ", ".join(str(r) for r in URL_RULES)
    return rf"""
WITH rules(v, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM u),
b AS (SELECT row, h || p.p AS rule, v FROM p AS p0(page_id, html, host, path, row) JOIN rules p ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p.p)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p.p) DESC, h || p.p) = 1),
j AS (SELECT p.*, rule, v FROM p LEFT JOIN b USING (row)),
s AS (SELECT CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY v) AS w FROM j WHERE rule IS NOT NULL GROUP BY v, host),
x AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
y AS (SELECT src, dst, count(*) AS n FROM x WHERE src <> dst AND src <> '' GROUP BY src, dst),
e AS (SELECT 'trust' AS kind, src, dst, n FROM y UNION ALL SELECT 'distrust', dst, src, n FROM y),
d AS (SELECT kind, src, sum(n) AS n FROM e GROUP BY kind, src),
k0 AS (SELECT kind, host, 0.15 * w AS m FROM s),
{", ".join(steps)},
f AS (SELECT host, coalesce(sum(m) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(m) FILTER (kind = 'distrust'), 0) AS d FROM k{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN f.d > f.t THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN f ON f.host = j.host
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    rows = docs.select("doc_id", "text")
    return identify(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import top_k

    docs = table(spark, sf_dir, "documents")
    return top_k(docs, F.coalesce(docs["doc_id"] % 20 == 0, F.lit(False)), k=10)


SQL_OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM w),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM w),
p AS (SELECT doc_id, t, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM t GROUP BY doc_id, t),
f AS (SELECT t, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / mean))), 6) AS score
  FROM p AS q JOIN p USING (t) JOIN f USING (t), g WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s QUALIFY rank <= 10
"""


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_repair import damage, repair_conversations

    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_benchmark_decontamination, op3_exact_top_k, op4_token_files, op5_suffix_tree_scores,
        op6_ngram_jaccard_join, op7_url_filters, op8_language_id, op9_chat_formatting, op10_warc_bundles,
        op11_simhash_near_dedup, op12_conversation_repair, op13_conversation_prefix_trie,
    )
}
SQL: dict[str, str] = {
    "op3_exact_top_k": SQL_OP3, "op6_ngram_jaccard_join": SQL_OP6, "op7_url_filters": _op7_sql(), "op9_chat_formatting": SQL_OP9, "op10_warc_bundles": SQL_OP10,
}

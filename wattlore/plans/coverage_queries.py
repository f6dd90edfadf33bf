"""Registered queries of call scores, sealed files, derived queries, trajectories, exports, graph search and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes, datasets, graph, logs, rank_eval, textindex
from .queries import TRIPLES_SQL, UNITS_SQL, edges, query, table, units

# ---- calls ----------------------------------------------------------------------------------------------------------------

_CALL = "named_struct('name', '{name}', 'arguments', {arguments})"


def _call(name: str, arguments: str) -> str:
    return _CALL.format(name=name, arguments=arguments)


_LOOK, _FIND = """concat('{"q":"gas in old oil","n":', o_custkey, '}')""", """'{"list":["b","a"]}'"""
_GOLD = f"array({_call('look', _LOOK)}, {_call('find', _FIND)}, {_call('look', '''concat('{\"q\":\"', o_orderstatus, '\"}')''')})"
#: What a prediction has, and each gold call's share.
_PRED = [
    (f"array({_call('look', _LOOK)}, {_call('find', _FIND)}, {_call('look', '''concat('{\"q\":\"', o_orderstatus, '\"}')''')})", [1.0, 1.0, 1.0]),
    (f"array({_call('look', '''concat('{\"q\":\"', o_orderstatus, '\"}')''')}, {_call('look', '''concat('{\"q\":\"oil and gas in it\",\"n\":', o_custkey + 1, '}')''')})", [0.5, 0.0, 1.0]),
    (f"array({_call('find', '''concat('{\"list\":[\"a\",\"b\"],\"n\":', o_custkey, '}')''')}, {_call('look', '''concat('{\"n\":', o_custkey, '.0000001}')''')})", [0.5, 1.0, 0.0]),
    (f"slice(array({_call('look', _LOOK)}), 1, 0)", [0.0, 0.0, 0.0]),
]
_SHARES = str([s for _, s in _PRED])


def _predicted(spark, sf_dir):
    which = F.expr("CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {p}" for i, (p, _) in enumerate(_PRED)) + " END")
    return table(spark, sf_dir, "orders").withColumns({"gold": F.expr(_GOLD), "pred": which, "gold_ask": F.lit(None).cast("boolean"), "pred_ask": F.lit(None).cast("boolean")})


@query(f"SELECT o_orderkey, round(list_sum({_SHARES}[o_orderkey % 4 + 1]) / 3, 6) AS params, o_orderkey % 4 = 0 AS tool, o_orderkey % 4 = 0 AS complete FROM orders")
def call_scores(spark, sf_dir):
    """Three gold calls for each order against the same calls, calls in another order, near and missing ones."""
    return logs.score_calls(_predicted(spark, sf_dir)).select("o_orderkey", F.round("params", 6).alias("params"), "tool", "complete")


@query(f"SELECT o_orderkey AS item_id, unnest([0, 1, 2])::INTEGER AS pos, unnest({_SHARES}[o_orderkey % 4 + 1]) AS share FROM orders")
def required_call_shares(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    flat = lambda c, at: rows.select(F.col("o_orderkey").alias("item_id"), F.posexplode(c).alias(at, "x")).select("item_id", at, F.col("x.name").alias("tool"), F.col("x.arguments").alias("arguments"))
    return logs.match_required_calls(flat("gold", "pos"), flat("pred", "call_index")).select("item_id", "pos", "share")


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 0.5 ELSE 1 END WHEN 1 THEN 0.5 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 3 = 1 THEN 0.6 ELSE 0 END
  WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 3 = 1 THEN 0.5 ELSE 0 END WHEN 5 THEN CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 3 = 1 THEN 0.6 ELSE 0 END WHEN 6 THEN 0.5 END::DOUBLE AS faithfulness FROM orders""")
def typed_faithfulness(spark, sf_dir):
    """An answer for each order and type of evidence: with and without the passage, the names, the fault, the number, the place."""
    k, c = "o_orderkey % 8", "o_custkey % 3"
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"CASE {k} WHEN 0 THEN 'kb_chunk' WHEN 1 THEN 'kg_path' WHEN 2 THEN 'dga_label' WHEN 3 THEN 'ett_dataset' WHEN 4 THEN 'signal_inline' WHEN 5 THEN 'multi' WHEN 6 THEN 'kb_chunk' ELSE 'none' END AS type",
        f"CASE {k} WHEN 0 THEN IF({c} = 1, '???', 'the oil gauge reads low') WHEN 1 THEN 'found core only' WHEN 2 THEN IF(o_custkey % 2 = 0, 'an arc it is', 'a leak') WHEN 4 THEN IF({c} = 0, 'at 17', 'somewhere') WHEN 6 THEN 'oil gauge' ELSE IF({c} = 0, 'mean 41.5', IF({c} = 1, '趋势', 'no idea')) END AS answer",
        f"CASE {k} WHEN 1 THEN array('core', 'oil') WHEN 6 THEN array('oil gauge', 'winding') ELSE array('oil gauge', 'reads low') END AS anchors", f"NOT ({k} = 0 AND {c} = 0) AS retrieved", f"{k} = 0 AS hit", f"IF({k} = 2, 'arc', NULL) AS fault",
        f"IF({k} = 3 OR {k} = 5, 41.52D, NULL) AS forecast", f"IF({k} = 4 AND {c} < 2, array(17, 99), NULL) AS places",
    )
    return logs.evidence_faithfulness(rows).select("o_orderkey", "faithfulness")


@query("""SELECT doc_id AS seed_id, concat_ws(',', CASE WHEN doc_id % 10 >= 7 THEN 'not_train' END, CASE WHEN n_chars IN (SELECT n_chars FROM documents WHERE doc_id % 10 >= 9) OR n_chars % 50 = 7 THEN 'size' END, CASE WHEN substr(md5(coalesce(text, '')), 1, 2) IN (SELECT substr(md5(coalesce(text, '')), 1, 2) FROM documents WHERE doc_id % 10 >= 9) THEN 'print' END) AS hits FROM documents WHERE hits <> ''""")
def leaked_by_two_keys(spark, sf_dir):
    """Prompts that share a size or a print with test rows, or a size with a hold-out of its own."""
    d, last = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    seeds = d.select(F.col("doc_id").alias("seed_id"), F.when(last < 7, "train").when(last < 9, "dev").otherwise("test").alias("split"), F.col("n_chars").cast("string").alias("size"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 2).alias("print"))
    holdout = d.filter("n_chars % 50 = 7").select(F.col("n_chars").cast("string").alias("size"), F.lit(None).cast("string").alias("print"))
    out = datasets.leakage_by_key(seeds.select("seed_id"), seeds, holdout, "seed_id", ["size", "print"])
    return out.select("seed_id", F.array_join("hits", ",").alias("hits"))


@query("""SELECT o_orderkey, unnest(['number', 'fake_ref', 'span', 'scope', 'contradiction']) AS subtype, unnest(['DATA', 'EVIDENCE', 'EVIDENCE', 'SCOPE', 'SAFETY']) AS expected, unnest(['changed', 'value ' || (o_custkey + 1) || ' on A.', 'value ' || (o_custkey + 1) || ' on A.', 'value ' || (o_custkey + 1) || ' on B.', 'value ' || (o_custkey + 1) || ' on A. 无需处理。']) AS text,
  unnest(['E1', 'E1-none', 'E1', 'E1', 'E1']) AS ref, unnest(['s', 's', 'no such passage', 's', 's']) AS span FROM orders""")
def injected_faults(spark, sf_dir):
    """All five injectors on a claim for each order; a changed number is 0.7 or 1.3 times what it was."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("value "), F.col("o_custkey") + 1, F.lit(" on A.")).alias("text"), F.lit("E1").alias("ref"), F.lit("s").alias("span"))
    out = datasets.inject_errors(rows, ("o_orderkey", "o_custkey"), {"on A": "on B"})
    ratio = F.round(F.regexp_extract("text", r"([0-9.]+) on", 1).try_cast("double") / (F.col("o_custkey") + 1), 3)
    text = F.when((F.col("subtype") == "number") & F.least(F.abs(ratio - 0.7), F.abs(ratio - 1.3)).between(0, 0.006), "changed").otherwise(F.col("text"))
    return out.select("o_orderkey", "subtype", "expected", text.alias("text"), "ref", "span")


# ---- sealed files and training sets -------------------------------------------------------------------------------------

@query("""WITH h AS (SELECT role, count(*) AS n, sha256(string_agg(text || chr(10), '' ORDER BY conv_id * 1000 + turn)) AS sha256 FROM conversations WHERE text IS NOT NULL GROUP BY role) SELECT role, n::BIGINT AS n, sha256, CASE role WHEN 'user' THEN 'OK' WHEN 'assistant' THEN 'CHANGED' ELSE 'MISSING' END AS status FROM h""")
def sealed_files(spark, sf_dir):
    """The turns of each role as a file: its own SHA-256, against a registry that has one right, one with another count and one not at all."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    hashes = datasets.sealed_hash(rows, "at", "text", "role")
    registry = hashes.filter(F.col("role").isin("user", "assistant")).withColumn("n", F.col("n") + F.when(F.col("role") == "user", 0).otherwise(1))
    return hashes.join(datasets.check_sealed(hashes, registry, "role"), "role").select("role", "n", "sha256", "status")


@query("""SELECT o_orderkey AS seed_id, unnest([0, 1, 2, 3, 4])::INTEGER AS pos, unnest(['user', 'assistant', 'tool', 'assistant', 'tool']) AS role, unnest([NULL, o_custkey::VARCHAR, NULL, o_orderstatus, NULL]) AS arguments, unnest([o_orderpriority, NULL, 'error', NULL, o_orderdate::DATE::VARCHAR]) AS content FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0""")
def recovery_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("seed_id", F.col("o_orderkey"))
    wrong = rows.filter("o_orderkey % 3 = 0").select("seed_id", F.col("o_custkey").cast("string").alias("arguments"), F.lit("error").alias("error"))
    right = rows.filter("o_custkey % 2 = 0").select("seed_id", F.col("o_orderstatus").alias("arguments"), F.to_date("o_orderdate").cast("string").alias("content"))
    return datasets.error_recovery_rows(rows.select("seed_id", F.col("o_orderpriority").alias("query")), wrong, right)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'n=' || o_custkey || ';q=' || o_orderstatus WHEN 1 THEN 'q=' || o_orderstatus ELSE '' END AS kept FROM orders")
def key_parameters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(F.lit("look"), F.lit("find"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("tool"), F.to_json(F.struct(F.col("o_orderstatus").alias("q"), F.col("o_custkey").alias("n"), F.lit(1).alias("z"))).alias("arguments"))
    out = datasets.required_actions(rows, {"look": ["n", "q"], "find": ["q", "gone"]})
    said = F.transform(F.array_sort(F.map_entries("key_params")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("o_orderkey", F.array_join(said, ";").alias("kept"))


@query("""SELECT o_orderkey, '{"messages":[{"role":"user","content":"' || o_orderpriority || '"}],"chosen":{"role":"assistant","content":"' || o_orderstatus || '"},"rejected":{"role":"assistant","content":"' || (o_custkey % 3) || '"}}' AS record FROM orders WHERE o_orderkey % 5 <> 0""")
def preference_records(spark, sf_dir):
    """Pairs as records; a fifth of the pairs have equal texts and go."""
    rows = table(spark, sf_dir, "orders")
    name = lambda side: F.concat(F.lit(side), F.col("o_orderkey"))
    pairs = rows.select("o_orderkey", name("c").alias("chosen"), name("r").alias("rejected"))
    prompts = rows.select("o_orderkey", F.array(F.struct(F.lit("user").alias("role"), F.col("o_orderpriority").alias("text"))).alias("messages"))
    other = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise((F.col("o_custkey") % 3).cast("string"))
    texts = rows.select(name("c").alias("candidate_id"), F.col("o_orderstatus").alias("text")).unionByName(rows.select(name("r").alias("candidate_id"), other.alias("text")))
    return datasets.export_preference(pairs, prompts, texts, "o_orderkey")


# ---- query derivation ------------------------------------------------------------------------------------------------------

_DERIVED = f"""{UNITS_SQL}, k AS (SELECT *, doc_id || '-' || "order" AS unit_id FROM n), z AS (SELECT *, min(CASE WHEN type <> 'title' THEN "order" END) OVER (PARTITION BY doc_id ORDER BY "order" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM k),
d AS (SELECT 'heading' AS type, regexp_replace(text, '^[0-9.．、\\s()（）]+', '') AS query, CASE WHEN nxt IS NOT NULL THEN doc_id || '-' || nxt END AS source_unit_id, doc_id, "order" FROM z WHERE type = 'title' AND "order" > 0
UNION ALL SELECT 'definition', regexp_extract(text, '^(.{{2,20}}?)( en | in )', 1), unit_id, doc_id, "order" FROM z WHERE type = 'paragraph' AND regexp_matches(text, '^(.{{2,20}}?)( en | in )')),
g AS (SELECT *, CASE WHEN split_part(source_unit_id, '-', 2)::INT % 2 = 0 THEN 'c' || source_unit_id END AS gold FROM d)"""


def derived(spark, sf_dir):
    """Headings and definitions of documents' lines; every second line is a chunk."""
    rows = units(spark, sf_dir).withColumn("level", F.when(F.col("type") == "title", F.when(F.col("order") > 0, 1).otherwise(0)))
    chunks = rows.filter("`order` % 2 = 0").select(F.concat(F.lit("c"), "unit_id").alias("chunk_id"), F.array("unit_id").alias("unit_ids"))
    return rank_eval.derive_queries(rows, chunks, r"^(.{2,20}?)( en | in )")


@query(f"""WITH {_DERIVED} SELECT type, query, doc_id AS gold_doc_id, source_unit_id, coalesce(gold, '') AS gold FROM g""")
def derived_queries(spark, sf_dir):
    return derived(spark, sf_dir).select("type", "query", "gold_doc_id", "source_unit_id", F.coalesce(F.array_join("gold_chunk_ids", ","), F.lit("")).alias("gold"))


@query(f"""WITH {_DERIVED} SELECT type, query, doc_id AS gold_doc_id, source_unit_id FROM g WHERE length(query) >= 4 AND gold IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE type WHEN 'heading' THEN 1 ELSE 3 END, doc_id, "order", source_unit_id) = 1""")
def deduplicated_queries(spark, sf_dir):
    return rank_eval.dedup_queries(derived(spark, sf_dir)).select("type", "query", "gold_doc_id", "source_unit_id")


# ---- graph, recommendations, summaries -------------------------------------------------------------------------------------

@query(f"""WITH {TRIPLES_SQL}, q AS (SELECT s_suppkey AS qid, CASE s_suppkey % 3 WHEN 0 THEN 'supplier' || s_suppkey WHEN 1 THEN 'nowhere' ELSE 'nobody' END AS entity FROM supplier), e AS (SELECT qid, head || '|' || relation || '|' || tail AS path FROM q JOIN t ON t.head = q.entity)
SELECT q.qid, CASE WHEN entity = 'nobody' THEN 'no_match' WHEN entity = 'nowhere' THEN 'no_relation' ELSE 'ok' END AS status, coalesce(path, '') AS paths FROM q LEFT JOIN e USING (qid)""")
def searched_graph(spark, sf_dir):
    """Suppliers by name, a name without edges and one that the lexicon lacks."""
    k = F.col("s_suppkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit("where is supplier"), k, F.lit(" now?"))).when(k % 3 == 1, "who is nowhere ?").otherwise("???")
    rows = table(spark, sf_dir, "supplier").select(k.alias("qid"), asked.alias("query"), k)
    lexicon = [(f"supplier{r.s_suppkey}", f"supplier{r.s_suppkey}", "supplier") for r in rows.select("s_suppkey").collect()] + [("nowhere", "nowhere", "place")]  # the lexicon is a stated list
    out = graph.graph_search(rows.select("qid", "query"), edges(spark, sf_dir), lexicon, direction="out")
    return out.select("qid", "status", F.coalesce(F.array_join(F.transform("paths", lambda p: F.array_join(p["path"], "|")), ","), F.lit("")).alias("paths"))


@query(f"""WITH {TRIPLES_SQL}, w AS (SELECT head AS node, 0 AS way, support, head || ' in ' || tail AS sentence FROM t WHERE relation IN ('IN', 'PART_OF') UNION ALL SELECT tail, 1, support, head || ' in ' || tail FROM t WHERE relation IN ('IN', 'PART_OF')),
m AS (SELECT node AS symptom, sentence, min(way) AS way, max(support) AS s FROM w JOIN nation ON n_name = node GROUP BY ALL) SELECT symptom, sentence, row_number() OVER (PARTITION BY symptom ORDER BY way, s DESC, sentence)::INTEGER AS rank FROM m QUALIFY rank <= 2""")
def symptom_sentences(spark, sf_dir):
    """Two sentences on the edges at each nation, those that lead out of it first."""
    e = edges(spark, sf_dir).withColumn("evidence", F.array(F.struct(F.concat_ws(" in ", "source", "target").alias("sentence"))))
    mapping = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symptom"), F.col("n_name").alias("node"))
    return graph.symptom_evidence(mapping, e, ["IN", "PART_OF"])


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem), h AS (SELECT l_orderkey, bool_or(r = 1 AND f = 'A') AS one, bool_or(r <= 3 AND f = 'A') AS three FROM r GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(one::INT), 6) AS top1, round(avg(three::INT), 6) AS top3 FROM h""")
def recommended_hits(spark, sf_dir):
    """Lines of an order in turn as recommendations, returned ones as expected."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    recs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("rank"), F.col("l_returnflag").alias("symptom"))
    expected = recs.select("l_orderkey").distinct().withColumn("expected", F.array(F.lit("A")))
    out = bayes.recommendation_hit_rate(recs, expected, "l_orderkey")
    return out.select("n", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"))


_LEXICON = ["the", "der", "que", "and", "die", "les", "una", "est"]


@query(f"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？.!?]+[。！？.!?]?'), lambda x: length(trim(x)) > 8)[1] AS first, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w, source, coalesce(lang, '') AS lang FROM documents),
t AS (SELECT *, array_to_string(list_transform(list_sort([{{'p': list_position(w, x), 't': x}} FOR x IN {_LEXICON} IF list_contains(w, x)])[1:6], lambda y: y.t), ' ') AS terms FROM s)
SELECT doc_id, md5(substr(concat_ws(' ', trim(source || ' ' || lang), CASE WHEN trim(first) <> '' THEN first END, CASE WHEN terms <> '' THEN terms END), 1, 140)) AS summary FROM t""")
def document_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.array_compact(F.array(F.lit("x"), "source", "lang")).alias("section_path"), F.col("text").alias("body"))
    return textindex.extractive_summary(rows, _LEXICON).select(F.col("chunk_id").alias("doc_id"), F.md5("summary").alias("summary"))


@query(f"""WITH {UNITS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "order") AS r FROM n WHERE type = 'title' AND "order" > 0), t AS (SELECT doc_id, string_agg(text, '|' ORDER BY r) AS toc FROM h WHERE r <= 5 GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(doc_id || '-' || "order", ',' ORDER BY "order") AS ids FROM n GROUP BY doc_id) SELECT d.doc_id, md5(coalesce(toc, '')) AS toc, md5(coalesce(ids, '')) AS chunk_ids FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""")
def document_contents(spark, sf_dir):
    rows = units(spark, sf_dir).withColumn("level", F.when((F.col("type") == "title") & (F.col("order") > 0), 1))
    chunks = rows.select("doc_id", F.col("order").alias("seq"), F.col("unit_id").alias("chunk_id"))
    out = textindex.doc_index(table(spark, sf_dir, "documents").select("doc_id"), rows, chunks, 5)
    return out.select("doc_id", F.md5(F.coalesce(F.array_join(F.transform("toc", lambda t: t["title"]), "|"), F.lit(""))).alias("toc"), F.md5(F.coalesce(F.array_join("chunk_ids", ","), F.lit(""))).alias("chunk_ids"))


@query(f"""WITH {UNITS_SQL}, m AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY "order") AS nxt, regexp_matches(lower(text), '^(th|en|die)[a-z]*') AS mark, regexp_replace(text, '(?i)^(th|en|die)[a-z]*', '') AS body FROM n),
l AS (SELECT *, CASE WHEN type = 'paragraph' AND length(text) > 40 THEN sum(CASE WHEN type = 'paragraph' AND length(text) > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "order") END AS r FROM m)
SELECT doc_id, md5(substr(coalesce(arg_min(CASE WHEN length(body) < 40 THEN body || coalesce(nxt, '') ELSE body END, "order") FILTER (type = 'paragraph' AND mark), arg_min(nxt, "order") FILTER (type = 'title' AND mark AND nxt IS NOT NULL), string_agg(text, chr(10) ORDER BY "order") FILTER (r <= 2), ''), 1, 300)) AS abstract FROM l GROUP BY doc_id""")
def document_abstracts(spark, sf_dir):
    """The first line that begins like an abstract, here with certain syllables; else what follows such a title; else two paragraphs."""
    out = textindex.extract_abstract(units(spark, sf_dir), r"^(th|en|die)[a-z]*", 300)
    return out.select("doc_id", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract"))


_CJK = ["变压器", "变压", "器油", "温度", "dl/t 722", "升高"]


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '变压 器油 温度 升高' WHEN 1 THEN '变压器 甲乙 乙丙 温度' WHEN 2 THEN 'dl/t 722 abc 温度' ELSE '' END AS tokens FROM orders""")
def segmented_text(spark, sf_dir):
    """Runs of characters whose longest first word isn't the best, unknown stretches, words with other characters, single ones."""
    k = F.col("o_orderkey")
    said = F.element_at(F.array(*map(F.lit, ("变压器油温度升高", "变压器甲乙丙温度 7", "DL/T 722规，abc 12温度", "甲 x 1"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(textindex.tokenize_cjk(said, _CJK), " ").alias("tokens"))

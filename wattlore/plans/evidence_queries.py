"""Registered queries of claims, relations and chat records, each with SQL that works out the expected finding from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.steps import once_each, spread
from ..operators import chat_records, claims, graph, relations
from .queries import query, table

# ---- claims: every order has a tool result and claims about it, some of them off by d ------------------------------------

BASE_SQL = "b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS d, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 4).alias("d"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def results(rows: DataFrame) -> DataFrame:
    """item_id, ref, source, content: a tool result for each order."""
    result = F.expr("""struct(
      c AS H2, 1 AS C2H2, (c % 900) / 1000D AS primary_probability, concat('C2H2=', 2 * c, ' 超过注意值') AS interpretation, (c % 2000) / 1000D AS posterior_entropy_bits, array(c % 80 + 0.5D) AS predicted_ot, struct(k % 7 AS count) AS anomalies,
      struct(struct(k % 3 AS code_C2H2_C2H4, c % 3 AS code_CH4_H2, (k + c) % 3 AS code_C2H4_C2H6) AS ratio_codes) AS dga_analysis, array(struct('电弧放电' AS fault_name, (c % 900) / 1000D AS probability)) AS fault_ranking)""")
    args = F.expr("struct(c % 50 AS horizon, k % 100 AS lookback, concat('ETTh', k % 2 + 1) AS dataset, concat('T-', c % 9) AS device_id)")
    return rows.select(F.col("k").alias("item_id"), F.lit("call:0").alias("ref"), F.lit("tool").alias("source"), F.to_json(F.struct(result.alias("result"), args.alias("args"))).alias("content"))


#: id and text of each claim about an order.
SAID = {
    "gas": "concat('H2=', c + d, ' ppm')", "quoted": "concat('C2H2=', 2 * c + if(d = 2, 1, 0), ' 超过注意值')", "share": "concat('概率 ', (c % 900 + d) div 10, '.', (c % 900 + d) % 10, '%')", "temperature": "concat('油温 ', c % 80 + d, '.5℃')",
    "horizon": "concat('预测 ', c % 50 + if(d = 1, 1, 0), ' 步')", "lookback": "concat('回看 ', k % 100 + if(d = 2, 1, 0), ' 点')", "entropy": "concat('后验熵 ', (c % 2000 + 10 * d) div 1000, '.', lpad(string((c % 2000 + 10 * d) % 1000), 3, '0'), ' bit')",
    "count": "concat('检出 ', k % 7 + if(d = 3, 1, 0), ' 个')", "code": "concat('三比值 ', (k + if(d = 3, 1, 0)) % 3, '-', c % 3, ' - ', (k + c) % 3)", "class": "concat('电弧放电概率 ', (c % 900 + d) div 10, '.', (c % 900 + d) % 10, '%')",
}


def said(rows: DataFrame) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(i).alias("id"), F.expr(t).alias("text")) for i, t in SAID.items()))
    return rows.select(F.col("k").alias("item_id"), F.explode(parts).alias("x")).select("item_id", "x.id", "x.text")


@query(f"""WITH {BASE_SQL}, n AS (SELECT *, [c::DOUBLE, 1, (c % 900) / 1000, (c % 2000) / 1000, c % 80 + 0.5, k % 7, k % 3, c % 3, (k + c) % 3, c % 50, k % 100] AS nums, (c % 900 + d) / 10 AS pct FROM b),
s AS (SELECT *, abs(pct - (c % 900) / 1000 * 100) > 0.15 AND len(list_filter(nums, lambda n: abs(pct - n) <= greatest(0.05, 0.02 * greatest(abs(pct), abs(n))))) = 0 AS share FROM n),
w AS (SELECT k, unnest([
  {{'id': 'gas', 'wrong': CASE WHEN d > greatest(0.05, 0.02 * (c + d)) THEN 'gas' END}}, {{'id': 'quoted', 'wrong': CASE WHEN d = 2 AND c > 0 THEN 'gas' END}}, {{'id': 'share', 'wrong': CASE WHEN share THEN 'share' END}},
  {{'id': 'temperature', 'wrong': CASE WHEN d > greatest(0.05, 0.02 * (c % 80 + d + 0.5)) THEN 'temperature' END}}, {{'id': 'horizon', 'wrong': CASE WHEN d = 1 THEN 'horizon' END}}, {{'id': 'lookback', 'wrong': CASE WHEN d = 2 THEN 'lookback' END}},
  {{'id': 'entropy', 'wrong': CASE WHEN d >= 2 THEN 'entropy' END}}, {{'id': 'count', 'wrong': CASE WHEN d = 3 THEN 'count' END}}, {{'id': 'code', 'wrong': CASE WHEN d = 3 THEN 'code' END}},
  {{'id': 'class', 'wrong': concat_ws(',', CASE WHEN d >= 2 THEN 'class' END, CASE WHEN share THEN 'share' END)}}]) AS x FROM s)
SELECT k AS item_id, x.id AS id, coalesce(x.wrong, '') AS wrong FROM w""")
def claim_quantities(spark, sf_dir):
    """Ten claims on each order's tool result, one for each kind of quantity and one that quotes the result's own words."""
    rows = base(spark, sf_dir)
    own = said(rows)
    valid = own.select("item_id", "id", F.lit(0).alias("n"), F.lit("call:0").alias("ref"))
    out = claims.check_data(own, valid, claims.evidence_leaves(results(rows)))
    return out.select("item_id", "id", F.coalesce(F.array_join(F.transform("wrong", lambda w: w["kind"]), ","), F.lit("")).alias("wrong"))


@query(f"""WITH {BASE_SQL} SELECT k AS item_id, unnest(['near', 'far', 'cut', 'pairs', 'text', 'long', 'none', 'poses', 'blank']) AS id,
unnest([NULL, 'span_not_found', NULL, CASE WHEN d = 0 THEN 'span_not_found' END, CASE WHEN d = 1 THEN 'span_not_found' END, CASE WHEN d > 0 THEN 'span_not_found' END, 'no_such_ref', 'knowledge_as_observation', 'span_not_found']) AS reason FROM b""")
def cited_evidence(spark, sf_dir):
    """Nine citations for each order: of its tool result, by JSON, cut-off JSON and loose pairs, and of a text."""
    rows = base(spark, sf_dir)
    note = rows.select(F.col("k").alias("item_id"), F.lit("kb:1").alias("ref"), F.lit("kb").alias("source"), F.concat_ws(" ", F.lit("order of priority"), "priority", F.lit("and state"), "status").alias("content"))
    cite = lambda i, kind, ref, span: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), F.lit(ref).alias("ref"), F.expr(span).alias("span"))
    spans = F.array(
        cite("near", "mechanism", "call:0", """concat('{"H2": ', c, '.04}')"""), cite("far", "mechanism", "call:0", """concat('{"H2": ', 2 * c + 5, '}')"""), cite("cut", "mechanism", "call:0", """concat('{"result": {"anomalies": {"count": ', k % 7)"""),
        cite("pairs", "mechanism", "call:0", """concat('see "horizon": ', c % 50, ', "dataset": "ETTh', if(d = 0, 9, k % 2 + 1), '" there')"""), cite("text", "mechanism", "kb:1", "if(d = 1, 'priority of order', concat('priority  ', priority))"),
        cite("long", "mechanism", "kb:1", "concat('order of priority ', priority, ' and ', if(d = 0, 'state', 'not that'))"), cite("none", "mechanism", "kb:9", "priority"), cite("poses", "observation", "kb:1", "priority"), cite("blank", "mechanism", "call:0", "' '"),
    )
    cites = rows.select(F.col("k").alias("item_id"), F.explode(spans).alias("x")).select("item_id", "x.id", "x.type", F.lit("本次结果").alias("text"), F.lit(0).alias("n"), F.lit("").alias("source"), "x.ref", "x.span")
    return claims.check_evidence(cites, results(rows).unionByName(note)).select("item_id", "id", "reason")


@query(f"""WITH {BASE_SQL} SELECT k AS item_id, d <> 1 AND d <> 2 AS ok, CASE WHEN d = 1 THEN 'ETTH1,ETTH2' END AS datasets, CASE WHEN d = 2 THEN '44' END AS device FROM b""")
def claim_scopes(spark, sf_dir):
    """Data sets and devices that claims name against the arguments of the cited call."""
    rows = base(spark, sf_dir)
    own = rows.select(F.col("k").alias("item_id"), F.lit("1").alias("id"), F.expr("concat('etth', k % 2 + 1, if(d = 1, concat(' 与 ETTh', 2 - k % 2), ''), '，#', if(d = 2, 44, c % 9), ' 主变')").alias("text"))
    valid = own.select("item_id", "id", F.lit(0).alias("n"), F.lit("call:0").alias("ref"))
    return claims.check_applicability(own, valid, claims.evidence_leaves(results(rows))).select("item_id", "ok", F.array_join("datasets", ",").alias("datasets"), "device")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS r FROM lineitem),
x AS (SELECT l_orderkey AS item_id, 'call:' || l_linenumber AS ref, 'tool' AS source FROM l WHERE l_linenumber <= 2 UNION SELECT l_orderkey, 'kb:' || l_partkey, 'kb' FROM l WHERE r <= 3 UNION SELECT l_orderkey, 'kg:' || l_suppkey, 'kg' FROM l WHERE r <= 3 UNION SELECT l_orderkey, 'user:' || l_linenumber, 'user' FROM l)
SELECT item_id, ref, source FROM x""")
def citable_references(spark, sf_dir):
    """What an order may cite: its first lines as calls, three parts as passages, three suppliers as paths, every line as a turn."""
    rows = table(spark, sf_dir, "lineitem")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey"))).withColumn("item_id", F.col("l_orderkey"))
    calls = ranked.filter("l_linenumber <= 2").select("item_id", F.col("l_linenumber").alias("call_index"), F.lit("{}").alias("content"))
    chunks = ranked.select("item_id", "rank", F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("content"))
    paths = ranked.select("item_id", "rank", F.col("l_suppkey").alias("path_id"), F.col("l_linestatus").alias("content"))
    turns = ranked.select("item_id", F.col("l_linenumber").alias("turn"), F.col("l_returnflag").alias("content"))
    return claims.evidence_catalog(calls, chunks, paths, turns, cap=3).select("item_id", "ref", "source")


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each line of an order: cites by its return flag, with faults by line number and supplier."""
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "tool").when(F.col("l_returnflag") == "N", "kb").otherwise("web")
    ref = F.when(F.col("l_suppkey") % 3 == 0, F.lit("kb:")).otherwise(F.when(F.col("l_returnflag") == "A", "call:").otherwise("kb:"))
    evidence = F.array(F.struct(kind.alias("source"), F.concat(ref, F.col("l_partkey") % 5).alias("ref"), F.when(F.col("l_linenumber") == 3, " ").otherwise("x").alias("span")))
    return rows.select(F.col("l_orderkey").alias("item_id"), F.least("l_linenumber", F.lit(5)).alias("id"), F.when(F.col("l_suppkey") % 4 == 0, "guess").otherwise("diagnosis").alias("type"), F.when(F.col("l_linenumber") == 2, F.slice(evidence, 1, 0)).otherwise(evidence).alias("evidence"))


CLAIMS_SQL = """l AS (SELECT l_orderkey AS item_id, least(l_linenumber, 5) AS id, l_linenumber AS n, CASE WHEN l_suppkey % 4 = 0 THEN 'guess' ELSE 'diagnosis' END AS type, CASE l_returnflag WHEN 'A' THEN 'tool' WHEN 'N' THEN 'kb' ELSE 'web' END AS source, l_partkey % 5 AS p,
  CASE WHEN l_suppkey % 3 = 0 OR l_returnflag <> 'A' THEN 'kb:' ELSE 'call:' END AS prefix FROM lineitem),
e AS (SELECT *, list_filter([CASE WHEN count(*) OVER (PARTITION BY item_id, id) > 1 THEN 'duplicate_id' END, CASE WHEN type = 'guess' THEN 'bad_type' END, CASE WHEN n = 2 THEN 'no_evidence' END,
  CASE WHEN n <> 2 AND ((source = 'tool' AND prefix <> 'call:') OR (source = 'kb' AND prefix <> 'kb:')) THEN 'bad_ref' END, CASE WHEN n <> 2 AND source = 'web' THEN 'bad_source' END, CASE WHEN n = 3 THEN 'empty_span' END], lambda x: x IS NOT NULL) AS errors,
  CASE WHEN n <> 2 AND prefix || p <> 'call:1' AND prefix || p <> 'kb:1' THEN prefix || p ELSE '' END AS warnings FROM l)"""


@query(f"WITH {CLAIMS_SQL} SELECT item_id, id, array_to_string(errors, ',') AS errors, warnings FROM e")
def claim_errors(spark, sf_dir):
    rows = order_claims(spark, sf_dir)
    known = rows.select("item_id").distinct().select("item_id", F.explode(F.array(F.lit("call:1"), F.lit("kb:1"))).alias("ref"))
    return claims.validate_claims(rows, known).select("item_id", "id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {CLAIMS_SQL}, c AS (SELECT type, len(errors) = 0 AS fine, n <> 2 AS cites, source FROM e) SELECT coalesce(type, 'ALL') AS type, count(*)::BIGINT AS n, round(avg(fine::INT), 6) AS valid, round(avg(cites::INT), 6) AS with_evidence, round(avg((cites AND source = 'tool')::INT), 6) AS cites_tool, round(avg((cites AND source = 'kb')::INT), 6) AS cites_kb FROM c GROUP BY ROLLUP (type)""")
def claim_summary(spark, sf_dir):
    rows = order_claims(spark, sf_dir)
    checked = claims.validate_claims(rows, rows.select("item_id", F.lit("kb:1").alias("ref")))
    return claims.claims_report(checked).select("type", "n", *[F.round(c, 6).alias(c) for c in ("valid", "with_evidence", "cites_tool", "cites_kb")])


@query("""SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 AND o_totalprice < 200000 THEN 'unsupported_action' WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'contradicts_result' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 1 THEN 'dismisses_risk' END AS reason FROM orders""")
def claim_safety(spark, sf_dir):
    """Actions and all-clears against what was measured: large orders are measured, odd customers a risk."""
    k = F.col("item_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    text = F.when(k % 3 == 0, "建议停电检查").when(k % 3 == 1, "可继续运行").otherwise("继续观察")
    support = rows.select("item_id", (F.col("p") >= 200000).alias("measured"), (F.col("c") % 2 == 1).alias("high_risk"))
    return claims.check_safety(rows.select("item_id", F.lit("1").alias("id"), text.alias("text")), support).select("item_id", "reason")


@query("""SELECT o_orderkey AS item_id, CASE o_orderkey % 5 WHEN 0 THEN 'fault_attribution' WHEN 1 THEN 'ett_forecast' WHEN 2 THEN 'kg_search' WHEN 3 THEN 'rag_search' END AS tool, (3 + length(o_orderkey::VARCHAR))::INTEGER AS length FROM orders""")
def evidence_hints(spark, sf_dir):
    k = F.col("o_orderkey")
    words, kinds = (F.element_at(F.array(*map(F.lit, x)), (k % 5 + 1).cast("int")) for x in (("三比值", "油温℃", "与机理", "无依据", "无依据"), ("safety", "safety", "diagnosis", "recommendation", "diagnosis")))
    rows = table(spark, sf_dir, "orders").select(k.alias("item_id"), F.concat(words, k.cast("string")).alias("text"), kinds.alias("type"))
    out = claims.missing_evidence_tool(rows)
    return out.select("item_id", F.col("suggested_tool").alias("tool"), F.length("suggested_query").alias("length"))


# ---- relations: a sentence for each order line, with gaps by its numbers ------------------------------------------------

LEXICON = [
    ("绝缘受潮", "绝缘受潮", "Condition"), ("局部放电", "局部放电", "Fault"), ("放电故障", "放电故障", "Fault"), ("渗漏油", "渗漏油", "Fault"), ("异响", "异响", "Symptom"), ("乙炔", "乙炔", "Indicator"), ("酸值", "酸值", "Indicator"), ("铁心", "铁心", "Component"),
    ("油箱", "绝缘油", "Component"), ("更换", "更换", "Action"), ("色谱", "油色谱", "Method"), ("红外", "红外", "Method"), ("超声", "超声", "Method"), ("导则", "导则", "Standard"), ("规程", "规程", "Standard"), ("DL/T 722", "导则", "Standard"),
]
LINES_SQL = "x AS (SELECT l_orderkey, l_linenumber, l_partkey % 97 AS a, l_suppkey % 5 AS b, l_quantity::BIGINT AS q, l_linenumber % 4 AS d FROM lineitem)"


def told(spark: SparkSession, sf_dir: str, sentence: str) -> DataFrame:
    """l_orderkey, l_linenumber, relations of a sentence written from a line's numbers: a below 97, b below 5, q the quantity, d below 4."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 97 AS a", "l_suppkey % 5 AS b", "cast(l_quantity AS bigint) AS q", "l_linenumber % 4 AS d")
    rows = rows.selectExpr("l_orderkey", "l_linenumber", f"{sentence} AS sentence")
    one = F.transform("triples", lambda t: F.concat_ws(" ", t["head"], t["relation"], t["tail"]))
    work = lambda said: relations.extract_relations(graph.match_entities(said, LEXICON)).withColumn("found", F.array_join(F.array_sort(one), ";"))
    return once_each(rows, "sentence", work, ["found"]).select("l_orderkey", "l_linenumber", "found")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE d
  WHEN 0 THEN CASE WHEN a <= 76 AND b < 3 AND 2 * b + q + 2 <= 81 THEN '绝缘受潮 CAUSES 局部放电' ELSE '' END WHEN 1 THEN CASE WHEN b < 3 THEN '局部放电 PRODUCES 乙炔' ELSE '' END
  WHEN 2 THEN '' ELSE CASE WHEN a <= 78 THEN '异响 INDICATES 局部放电' ELSE '' END END AS found FROM x""")
def directional_relations(spark, sf_dir):
    """Causes at growing distance and behind growing numbers of clauses; a gas or no gas; a kind of fault; a sign."""
    return told(spark, sf_dir, """CASE d WHEN 0 THEN concat('绝缘受潮', repeat('甲', int(a)), '导致', repeat('，乙', int(b)), repeat('丙', int(q)), '局部放电') WHEN 1 THEN concat('局部放电析出', if(b < 3, '乙炔', '酸值'))
      WHEN 2 THEN '局部放电引起放电故障' ELSE concat('异响', repeat('甲', int(a)), '表明局部放电') END""")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN d < 2 AND a + 2 <= 40 AND b < 4 THEN '局部放电 TREATED_BY 更换' ELSE '' END AS found FROM x""")
def treatment_relations(spark, sf_dir):
    """Treatments with and without a word of obligation, at growing distance, and in an enumeration of four faults."""
    return told(spark, sf_dir, "concat(if(b = 4, '渗漏油、放电故障、渗漏油、', ''), '局部放电', repeat('甲', int(a)), if(d < 2, '建议', '或许'), '更换')")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE d WHEN 0 THEN CASE WHEN a <= 13 AND a + 2 <= 40 THEN '局部放电 DETECTED_BY 红外' ELSE '' END WHEN 1 THEN CASE WHEN b < 2 THEN '局部放电 DETECTED_BY 红外' ELSE '' END
  WHEN 2 THEN '局部放电 DETECTED_BY 红外' ELSE '局部放电 DETECTED_BY 油色谱;局部放电 DETECTED_BY 红外' END AS found FROM x""")
def detection_relations(spark, sf_dir):
    """Methods at growing distance from the verb, behind a list's comma, three of which the nearest counts, and two that both count."""
    return told(spark, sf_dir, """CASE d WHEN 0 THEN concat('红外', repeat('甲', int(a)), '发现局部放电') WHEN 1 THEN concat('发现异常的局部放电', if(b < 2, '与', '、'), '红外')
      WHEN 2 THEN concat('色谱与超声与红外', repeat('甲', int(b)), '测得局部放电') ELSE '色谱与红外判断局部放电' END""")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN d <> 3 AND b IN (0, 1, 2) THEN '局部放电 LOCATED_IN 铁心' ELSE '' END AS found FROM x""")
def location_relations(spark, sf_dir):
    """A component right before a fault, with particles, other words, and a blocked pair."""
    return told(spark, sf_dir, "concat(if(d = 3, '油箱', '铁心'), CASE b WHEN 0 THEN '' WHEN 1 THEN '的' WHEN 2 THEN '内部' WHEN 3 THEN '有' ELSE '内部的' END, if(d = 3, '渗漏油', '局部放电'))")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN d < 2 THEN CASE WHEN a <= 80 THEN '乙炔 SPECIFIED_IN 导则' ELSE '' END ELSE CASE WHEN a <= 80 THEN '乙炔 SPECIFIED_IN 规程' ELSE '' END END AS found FROM x""")
def standard_relations(spark, sf_dir):
    """A standard named by number rules out one named by title; without numbers, titles count, at growing distance."""
    return told(spark, sf_dir, "if(d < 2, concat('规程DL/T 722', repeat('甲', int(a)), '乙炔'), concat('规程', repeat('甲', int(a)), '乙炔'))")


# ---- chat records and arguments -----------------------------------------------------------------------------------------

_U, _A = '{"role":"user","content":"q"}', '{"role":"assistant","content":"a"}'
_CALL = '{"role":"assistant","content":"","tool_calls":[{"id":"1","type":"function","function":{"name":"f","arguments":"{}"}}]}'
_RESULT = '{"role":"tool","tool_call_id":"1","content":"r"}'


def _with(call: str) -> str:
    return f'{_U},{{"role":"assistant","tool_calls":{call}}},{_A}'


#: Messages of a record and the codes that they have to get.
RECORDS = [
    (f"{_U},{_A}", ""), (f"{_U},{_CALL},{_RESULT},{_A}", ""), (_U, "no_messages"), (f"{_A},{_U}", "bad_first,last_not_assistant"), (f'{{"role":"system","content":"s"}},{_A}', "no_user"), (f'{_U},{{"role":"x"}},{_A}', "bad_role"),
    (f'{_U},{{"role":"assistant","content":"a","name":"n"}}', "extra_field"), (f'{_U},{{"role":"assistant","content":3}}', "bad_content"), (f'{{"role":"user","content":""}},{_A}', "empty_content"), (f'{_U},{{"role":"assistant"}}', "empty_answer"),
    (_with("[]"), "bad_calls"), (_with('[{"type":"function","function":{"name":"f","arguments":"1"}}]'), "no_id"), (_with('[{"id":"1","type":"function","function":{"name":"f","arguments":"1"}},{"id":"1","type":"function","function":{"name":"f","arguments":"1"}}]'), "repeated_id"),
    (_with('[{"id":"1","function":{"name":"f","arguments":"1"}}]'), "bad_type"), (_with('[{"id":"1","type":"function","function":{"name":"g","arguments":"1"}}]'), "unknown_function"), (_with('[{"id":"1","type":"function","function":{"name":"f","arguments":"{"}}]'), "bad_arguments"),
    (f'{_U},{_CALL},{{"role":"tool","content":"r"}},{_A}', "no_result_id"), (f"{_U},{_CALL},{_RESULT},{_RESULT},{_A}", "bad_order,unmatched_id"), (f"{_U},{_CALL},{_A},{_RESULT},{_A}", "bad_order,unmatched_id"), (f"{_U},{_A}{{", "invalid_json"),
]


@query("WITH c AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 20 + 1 AS i FROM conversations) SELECT conv_id, turn, " + str([e for _, e in RECORDS]) + "[i] AS errors FROM c")
def chat_record_codes(spark, sf_dir):
    """A record for each turn with its text as the first question, broken in one of twenty ways."""
    kinds = F.array(*(F.lit(m) for m, _ in RECORDS))
    rows = table(spark, sf_dir, "conversations").withColumn("messages", F.element_at(kinds, ((F.col("conv_id") * 7 + F.col("turn")) % 20 + 1).cast("int")))
    asked = F.replace("messages", F.lit('"content":"q"'), F.concat(F.lit('"content":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)))
    rows = rows.select("conv_id", "turn", F.concat(F.lit('{"messages":['), asked, F.lit("]}")).alias("record"))
    return chat_records.validate_chat(rows, tools=["f"]).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query("""SELECT conv_id, n_turns, md5('{"messages":[' || said || ']}') AS as_messages, md5('{"conversations":[' || talked || ']}') AS as_conversations FROM (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg('{"role":"' || role || '","content":"' || md5(text) || '"}', ',' ORDER BY turn) || ',{"role":"assistant","content":"end"}' AS said, string_agg('{"from":"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || '","value":"' || md5(text) || '"}', ',' ORDER BY turn) || ',{"from":"gpt","value":"end"}' AS talked
  FROM conversations WHERE role <> 'system' GROUP BY conv_id)""")
def chat_formats(spark, sf_dir):
    """Whole conversations without their system turns as records of two formats, texts as digests."""
    turn = F.struct("turn", "role", F.md5("text").alias("text"))
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"), F.lit("end").alias("target"))
    both = chat_records.export_chat(chat_records.export_chat(rows).withColumnRenamed("record", "first"), "conversations")
    return both.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.md5("first").alias("as_messages"), F.md5("record").alias("as_conversations"))


TOOLS = {"look": {"required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "mode": {"type": "string", "enum": ["a", "b"]}, "list": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}}}}
#: Arguments and the errors that they have to get, as field and code.
GIVEN = [
    ('{"q":"x","n":%d}', ""), ('{"n":%d}', "q missing_required"), ('{"q":%d}', "q type_mismatch"), ('{"q":"%d","n":1.5}', "n type_mismatch"), ('{"q":"x","mode":"%d"}', "mode invalid_enum"), ('{"q":"%d","list":["x",1]}', "list invalid_item_type,list invalid_item_enum"),
    ('{"q":"%d","list":["z"]}', "list invalid_item_enum"), ('{"q":"%d","zz":1}', "zz unknown_field"), ("[%d]", " invalid_json"), ('{"q":"%d","n":null}', ""), ('{"q":"%d","n":true}', "n type_mismatch"),
]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 12 THEN ' unknown_tool' ELSE " + str([e for _, e in GIVEN]) + "[o_orderkey % 11 + 1] END AS errors FROM orders")
def argument_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    args = F.replace(F.element_at(F.array(*(F.lit(a) for a, _ in GIVEN)), (k % 11 + 1).cast("int")), F.lit("%d"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 13 == 12, "gone").otherwise("look").alias("tool"), args.alias("args"))
    out = chat_records.validate_arguments(rows, "tool", "args", TOOLS)
    return out.select("o_orderkey", F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["code"])), ",").alias("errors"))

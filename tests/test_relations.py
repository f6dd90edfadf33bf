"""Relation rules against a plain version over random sentences, and single cases of every rule."""

import random
import re

import pytest

from wattlore.operators import graph, relations
from wattlore.operators.relations import Rules

LEX = [
    ("电弧放电", "高能放电", "Fault"), ("高能放电", "高能放电", "Fault"), ("放电故障", "放电故障", "Fault"), ("过负荷", "过负荷", "Fault"), ("过负荷", "过负荷", "Condition"), ("受潮", "绝缘受潮", "Condition"), ("渗漏油", "渗漏油", "Fault"),
    ("匝间短路", "匝间短路", "Fault"), ("异响", "异响", "Symptom"), ("乙炔", "乙炔", "Indicator"), ("酸值", "酸值", "Indicator"), ("铁心", "铁心", "Component"), ("油箱", "绝缘油", "Component"), ("更换", "更换", "Action"),
    ("滤油", "滤油", "Action"), ("油色谱", "油色谱分析", "Method"), ("红外", "红外测温", "Method"), ("超声", "超声检测", "Method"), ("导则", "导则", "Standard"), ("DL/T 722", "导则", "Standard"),
]
FILL = ["导致", "产生", "以乙烯等为主", "表明", "应", "建议", "发现", "测量", "、", "，", "；", "的", "内部", "中", "一", "与", "，再，", "甲乙丙丁" * 5, "：", "\n"]


def plain(s, es, r=Rules()):
    out, legal = {}, r.legal

    def put(h, rel, t):
        out[(h["canon"], rel, t["canon"])] = (h["type"], t["type"])

    if len(es) < 2:
        return out
    of = lambda side, rel: [e for e in es if e["type"] in legal[rel][side]]
    gap = lambda a, b: max(a["start"], b["start"]) - min(a["end"], b["end"])
    for rel in ("CAUSES", "PRODUCES", "INDICATES"):
        if not (m := re.search(r.triggers[rel], s)):
            continue
        seps = [i for i, c in enumerate(s) if c in r.separators]
        before = [i for i in seps if m.start() - r.clause_chars <= i < m.start()]
        after = [i for i in seps if m.end() <= i <= m.end() + r.clause_chars]
        lo = before[-r.clauses] + 1 if len(before) >= r.clauses else max(0, m.start() - r.clause_chars)
        hi = after[r.clauses - 1] if len(after) >= r.clauses else min(len(s), m.end() + r.clause_chars + 1)
        hs = [e for e in of(0, rel) if lo <= e["start"] and e["end"] <= m.start()]
        ts = [e for e in of(1, rel) if m.end() <= e["start"] and e["end"] <= hi]
        kinds = [e["type"] for e in hs + ts]
        if not hs or not ts or max(map(kinds.count, kinds)) >= r.same_type:
            continue
        h, t = max(hs, key=lambda e: e["end"]), min(ts, key=lambda e: e["start"])
        two = {(h["canon"], t["canon"]), (t["canon"], h["canon"])}
        if h["canon"] != t["canon"] and not two & set(r.kinds) and t["canon"] in r.tails.get(rel, (t["canon"],)):
            put(h, rel, t)
    if sum(e["type"] == "Fault" for e in es) < r.many_faults and len(es) < r.many_entities:
        for h in of(0, "TREATED_BY"):
            for t in of(1, "TREATED_BY"):
                if 0 <= t["start"] - h["end"] <= r.action_gap and re.search(r.triggers["TREATED_BY"], s[h["end"] : t["start"]]):
                    put(h, "TREATED_BY", t)
        verb, methods = r.triggers["DETECTED_BY"], of(1, "DETECTED_BY")
        for h in of(0, "DETECTED_BY"):
            own = []
            for t in methods:
                middle = s[min(h["end"], t["end"]) : max(h["start"], t["start"])]
                listed = r.listing in middle and not re.search(verb, middle)
                if re.search(verb, s[max(0, t["start"] - r.verb_window) : t["end"] + r.verb_window]) and gap(h, t) <= r.method_gap and not listed:
                    own.append(t)
            for t in sorted(own, key=lambda t: gap(h, t))[: 1 if len(methods) >= r.many_methods else None]:
                put(h, "DETECTED_BY", t)
    for t in of(1, "LOCATED_IN"):
        for h in of(0, "LOCATED_IN"):
            if (h["canon"], t["canon"]) not in r.blocked and 0 <= h["start"] - t["end"] <= r.part_gap and re.fullmatch(r.particles, s[t["end"] : h["start"]]):
                put(h, "LOCATED_IN", t)
    standards = of(1, "SPECIFIED_IN")
    numbered = [t for t in standards if any(c.isdigit() for c in s[t["start"] : t["end"]])]
    for t in numbered or standards:
        for h in of(0, "SPECIFIED_IN"):
            if gap(h, t) <= r.standard_gap:
                put(h, "SPECIFIED_IN", t)
    return out


def test_rules_against_a_plain_version(spark):
    rng = random.Random(6)
    words = [s for s, _, _ in LEX]
    texts = ["".join(rng.choice(words if rng.random() < 0.4 else FILL) for _ in range(rng.randrange(2, 26))) for _ in range(1500)] + ["", None]
    rows = graph.match_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, sentence string"), LEX)
    seen = set()
    for r in relations.extract_relations(rows).collect():
        got = {(t["head"], t["relation"], t["tail"]): (t["head_type"], t["tail_type"]) for t in r.triples}
        assert len(got) == len(r.triples)
        want = plain(r.sentence or "", [e.asDict() for e in r.entities])
        assert got == want, r.sentence
        seen |= {k[1] for k in got}
    assert seen == set(relations.LEGAL)


CASES = [
    ("受潮导致电弧放电。", "绝缘受潮 CAUSES 高能放电"), ("受潮，甲，乙，丙，导致电弧放电。", ""), ("受潮" + "一" * 79 + "导致异响", ""), ("电弧放电产生乙炔", "高能放电 PRODUCES 乙炔"), ("电弧放电产生酸值", ""), ("电弧放电导致放电故障", ""),
    ("匝间短路应更换", "匝间短路 TREATED_BY 更换"), ("匝间短路更换", ""), ("用红外发现匝间短路", "匝间短路 DETECTED_BY 红外测温"), ("发现匝间短路、红外", ""), ("油色谱、超声、红外测量匝间短路", "匝间短路 DETECTED_BY 红外测温"), ("铁心的电弧放电", "高能放电 LOCATED_IN 铁心"),
    ("油箱渗漏油", ""), ("铁心有电弧放电", ""), ("导则与DL/T 722规定乙炔", "乙炔 SPECIFIED_IN 导则"),
]


@pytest.mark.parametrize("swap", [False, True])
def test_single_cases(spark, swap):
    rows = graph.match_entities(spark.createDataFrame([(t,) for t, _ in CASES], "sentence string"), LEX[::-1] if swap else LEX)
    got = {r.sentence: "; ".join(f"{t['head']} {t['relation']} {t['tail']}" for t in r.triples) for r in relations.extract_relations(rows).collect()}
    assert got == dict(CASES)

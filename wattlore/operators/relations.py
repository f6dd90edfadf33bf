"""Relations between the entities of a sentence, as column expressions over the array of entity spans: no Python per row.

Sentences are short (a few hundred characters) and so are their entity arrays, so rules are filters over them in one projection:
no shuffle, and whole-stage code. An entity is a struct of canon, type, start and end (graph.match_entities).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TRIPLE = "array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>>"

#: The words that trigger each relation.
TRIGGERS = {
    "CAUSES": "(导致|引起|引发|造成|使得|会使|致使|从而产生|进而引起)",
    "PRODUCES": "(产生|析出|生成|分解出|以.{1,6}为主|主要成分是|特征气体为|特征气体是)",
    "INDICATES": "(表明|说明|反映|意味着|征兆|判断为|诊断为|可判断|可以判断|提示|预示)",
    "TREATED_BY": "(应|需|须|必须|建议|宜|要|采取|进行)",
    "DETECTED_BY": "(检测|判断|诊断|发现|测量|测得|识别|监测|判别|确定)",
}
#: Legal types of heads and tails.
LEGAL = {
    "CAUSES": (("Condition", "Fault"), ("Fault", "Symptom")), "PRODUCES": (("Fault",), ("Indicator",)), "INDICATES": (("Symptom", "Indicator"), ("Fault",)), "TREATED_BY": (("Fault",), ("Action",)),
    "DETECTED_BY": (("Fault", "Symptom"), ("Method",)), "LOCATED_IN": (("Fault",), ("Component",)), "SPECIFIED_IN": (("Indicator", "Method"), ("Standard",)),
}
#: Indicators that are gases; pairs of a fault and its kind, which say nothing of each other; pairs of fault and
#: component that only look adjacent; particles between component and fault; characters that end a clause.
GASES = ("氢气", "甲烷", "乙炔", "乙烯", "乙烷", "一氧化碳", "二氧化碳", "总烃")
KINDS = (
    ("局部放电", "放电故障"), ("低能放电", "放电故障"), ("高能放电", "放电故障"), ("悬浮放电", "放电故障"), ("低温过热", "过热故障"), ("中温过热", "过热故障"),
    ("高温过热", "过热故障"), ("铁心过热", "过热故障"), ("匝间短路", "相间短路"), ("绝缘受潮", "绝缘老化"),
)
BLOCKED = (("渗漏油", "绝缘油"), ("油位异常", "绝缘油"))
PARTICLES = "(的|内部|中|上|处)?"
SEPARATORS = "，；,;。：:"


@dataclass(frozen=True)
class Rules:
    """What the rules go by; every value can be replaced for another field or language."""

    triggers: dict[str, str] = None
    legal: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = None
    tails: dict[str, tuple[str, ...]] = None
    kinds: Sequence[tuple[str, str]] = KINDS
    blocked: Sequence[tuple[str, str]] = BLOCKED
    particles: str = PARTICLES
    separators: str = SEPARATORS
    listing: str = "、"
    clauses: int = 3
    clause_chars: int = 80
    same_type: int = 4
    many_faults: int = 4
    many_entities: int = 7
    many_methods: int = 3
    fault: str = "Fault"
    action_gap: int = 40
    verb_window: int = 15
    method_gap: int = 40
    part_gap: int = 3
    standard_gap: int = 80

    def __post_init__(self) -> None:
        for name, value in (("triggers", TRIGGERS), ("legal", LEGAL), ("tails", {"PRODUCES": GASES})):
            if getattr(self, name) is None:
                object.__setattr__(self, name, value)


def _triple(head: Column, relation: str, tail: Column) -> Column:
    return F.struct(head["canon"].alias("head"), head["type"].alias("head_type"), F.lit(relation).alias("relation"), tail["canon"].alias("tail"), tail["type"].alias("tail_type"))


def _among(pairs: Sequence[tuple[str, str]], a: Column, b: Column) -> Column:
    return reduce(lambda x, p: x | ((a == p[0]) & (b == p[1])), pairs, F.lit(False))


def _best(entities: Column, better) -> Column:
    """The first entity that no other is better than; null of none."""
    return F.aggregate(entities, F.get(entities, F.lit(0)), lambda acc, e: F.when(better(e, acc), e).otherwise(acc))


def _between(text: Column, a: Column, z: Column) -> Column:
    return text.substr(a + 1, F.greatest(z - a, F.lit(0)))


def _distance(a: Column, b: Column) -> Column:
    """Characters between two spans; negative where they overlap."""
    return F.greatest(a["start"], b["start"]) - F.least(a["end"], b["end"])


def directional(rows: DataFrame, relation: str, rules: Rules, text: str, entities: str, out: str) -> DataFrame:
    """Add out: array of at most one triple, the nearest legal head before and tail behind the first trigger.

    Both have to lie within rules.clauses clauses and rules.clause_chars characters of it. None where one type has
    rules.same_type entities there (an enumeration), the two are one or a kind of each other, or the tail isn't among rules.tails.
    Places and candidates are columns of their own, so that no pattern is matched again for each entity.
    """
    trigger, (heads, tails) = rules.triggers[relation], rules.legal[relation]
    col = lambda name: F.col(f"{out}_{name}")
    add = lambda rows, **cols: rows.withColumns({f"{out}_{k}": v for k, v in cols.items()})
    s, es = F.col(text), F.col(entities)
    rows = add(rows, at=F.length(F.get(F.split(s, trigger, 2), F.lit(0))), said=F.regexp_extract(s, trigger, 0))
    sep, clause, few = "[" + rules.separators + "]", f"[^{rules.separators}]*", rules.clauses - 1
    behind = col("at") + F.length(col("said"))
    before = F.regexp_extract(_between(s, F.greatest(col("at") - rules.clause_chars, F.lit(0)), col("at")), rf"(?s){clause}(?:{sep}{clause}){{0,{few}}}\z", 0)
    after = F.regexp_extract(s.substr(behind + 1, F.lit(rules.clause_chars + 1)), f"(?s)^{clause}(?:{sep}{clause}){{0,{few}}}", 0)
    rows = add(rows, lo=col("at") - F.length(before), behind=behind, hi=behind + F.length(after))
    left = F.filter(es, lambda e: e["type"].isin(*heads) & (e["start"] >= col("lo")) & (e["end"] <= col("at")))
    right = F.filter(es, lambda e: e["type"].isin(*tails) & (e["start"] >= col("behind")) & (e["end"] <= col("hi")))
    rows = add(rows, left=F.when(col("said") != "", left), right=F.when(col("said") != "", right))
    head, tail = _best(col("left"), lambda e, acc: e["end"] > acc["end"]), _best(col("right"), lambda e, acc: e["start"] < acc["start"])
    types = F.transform(F.concat(col("left"), col("right")), lambda e: e["type"])
    most = F.array_max(F.array(*(F.size(F.filter(types, lambda k: k == F.lit(t))) for t in dict.fromkeys((*heads, *tails)))))
    rows = add(rows, head=head, tail=tail, most=most)
    h, t = col("head"), col("tail")
    fine = h.isNotNull() & t.isNotNull() & (col("most") < rules.same_type) & (h["canon"] != t["canon"])
    fine &= ~(_among(rules.kinds, h["canon"], t["canon"]) | _among(rules.kinds, t["canon"], h["canon"]))
    if relation in rules.tails:
        fine &= t["canon"].isin(*rules.tails[relation])
    found = F.when(F.coalesce(fine, F.lit(False)), F.array(_triple(h, relation, t))).otherwise(F.array().cast(TRIPLE))
    return rows.withColumn(out, found).drop(*(f"{out}_{k}" for k in ("at", "said", "lo", "behind", "hi", "left", "right", "head", "tail", "most")))


def _pairs(heads: Column, tails: Column, relation: str, fits) -> Column:
    return F.flatten(F.transform(heads, lambda h: F.transform(F.filter(tails, lambda t: fits(h, t)), lambda t: _triple(h, relation, t))))


def _of(entities: Column, types: Sequence[str]) -> Column:
    return F.filter(entities, lambda e: e["type"].isin(*types))


def treated_by(rules: Rules, text: Column, entities: Column) -> Column:
    """Triples of faults and the actions behind them with a word of obligation in between, within rules.action_gap characters."""
    heads, tails = rules.legal["TREATED_BY"]
    fits = lambda h, t: (h["end"] <= t["start"]) & (t["start"] - h["end"] <= rules.action_gap) & _between(text, h["end"], t["start"]).rlike(rules.triggers["TREATED_BY"])
    return _pairs(_of(entities, heads), _of(entities, tails), "TREATED_BY", fits)


def detected_by(rules: Rules, text: Column, entities: Column) -> Column:
    """Triples of faults or symptoms and methods within rules.method_gap characters that have a verb of detection within rules.verb_window.

    A method that only a list's comma parts from the fault is no method for it, unless a verb stands between them. With
    rules.many_methods methods a fault takes its nearest one alone.
    """
    heads, tails = rules.legal["DETECTED_BY"]
    verb, methods = rules.triggers["DETECTED_BY"], _of(entities, tails)

    def fits(h: Column, t: Column) -> Column:
        near = _between(text, F.greatest(t["start"] - rules.verb_window, F.lit(0)), t["end"] + rules.verb_window).rlike(verb)
        middle = _between(text, F.least(h["end"], t["end"]), F.greatest(h["start"], t["start"]))
        return near & (_distance(h, t) <= rules.method_gap) & ~(middle.contains(rules.listing) & ~middle.rlike(verb))

    def found(h: Column) -> Column:
        own = F.filter(methods, lambda t: fits(h, t))
        nearest = _best(own, lambda e, acc: _distance(h, e) < _distance(h, acc))
        taken = F.when((F.size(methods) >= rules.many_methods) & (F.size(own) > 0), F.array(nearest)).otherwise(own)
        return F.transform(taken, lambda t: _triple(h, "DETECTED_BY", t))

    return F.flatten(F.transform(_of(entities, heads), found))


def located_in(rules: Rules, text: Column, entities: Column) -> Column:
    """Triples of faults and the component right before them, with a particle between them at most; blocked pairs are none."""
    heads, tails = rules.legal["LOCATED_IN"]

    def fits(h: Column, t: Column) -> Column:
        gap = h["start"] - t["end"]
        return gap.between(0, rules.part_gap) & _between(text, t["end"], h["start"]).rlike(rf"^(?:{rules.particles})\z") & ~_among(rules.blocked, h["canon"], t["canon"])

    return _pairs(_of(entities, heads), _of(entities, tails), "LOCATED_IN", fits)


def specified_in(rules: Rules, text: Column, entities: Column) -> Column:
    """Triples of indicators or methods and standards within rules.standard_gap; where a standard is named by number, only such ones count."""
    heads, tails = rules.legal["SPECIFIED_IN"]
    standards = _of(entities, tails)
    coded = F.filter(standards, lambda s: _between(text, s["start"], s["end"]).rlike(r"\p{Nd}"))
    return _pairs(_of(entities, heads), F.when(F.size(coded) > 0, coded).otherwise(standards), "SPECIFIED_IN", lambda h, t: _distance(h, t) <= rules.standard_gap)


def extract_relations(sentences: DataFrame, rules: Rules = Rules(), text: str = "sentence") -> DataFrame:
    """Add triples: an array of head, head_type, relation, tail, tail_type from the sentence and its entities.

    Sentences with fewer than two entities have none. Treatments and detections are not told from enumerations (rules.many_faults
    faults or rules.many_entities entities). Of triples with the same head, relation and tail the last stays.
    """
    none = F.array().cast(TRIPLE)
    rows = sentences.withColumns({"_s": F.coalesce(F.col(text), F.lit("")), "_es": F.coalesce(F.col("entities"), F.array().cast("array<struct<canon:string,type:string,start:int,end:int>>"))})
    s, es = F.col("_s"), F.col("_es")
    for i, relation in enumerate(("CAUSES", "PRODUCES", "INDICATES")):
        rows = directional(rows, relation, rules, "_s", "_es", f"_d{i}")
    listed = (F.size(_of(es, [rules.fault])) >= rules.many_faults) | (F.size(es) >= rules.many_entities)
    alone = lambda c: F.when(~listed, c).otherwise(none)
    parts = [*map(F.col, ("_d0", "_d1", "_d2")), alone(treated_by(rules, s, es)), alone(detected_by(rules, s, es)), located_in(rules, s, es), specified_in(rules, s, es)]
    rows = rows.withColumn("_all", F.when(F.size(es) >= 2, F.concat(*parts)).otherwise(none))
    same = lambda a, b: (a["head"] == b["head"]) & (a["relation"] == b["relation"]) & (a["tail"] == b["tail"])
    last = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", i + 2, F.size("_all")), lambda y: same(x, y)))
    return rows.withColumn("triples", last.cast(TRIPLE)).drop("_all", "_s", "_es", "_d0", "_d1", "_d2")

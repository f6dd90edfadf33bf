"""Scoring call logs: predicted against gold calls, required calls, faithfulness, success, duplicates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import call_matching
from .call_matching import CALLS  # noqa: F401


def score_calls(df: DataFrame, gold: str = "gold", pred: str = "pred", gold_ask: str = "gold_ask", pred_ask: str = "pred_ask") -> DataFrame:
    """Add format, tool, params, complete, unnecessary, ask; null where one doesn't apply. gold, pred: arrays of (name,
    arguments); pred null is a format failure; gold_ask, pred_ask: booleans."""
    has, ok = F.size(gold) > 0, F.col(pred).isNotNull()
    names = lambda c: F.array_sort(F.transform(c, lambda x: x["name"]))
    tool = F.when(has, F.coalesce(names(gold) == names(pred), F.lit(False)))
    rows = df.withColumn("_s", call_matching.shares(F.col(gold), F.col(pred)))
    params = F.when(has, F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.size("_s"))
    rows = rows.withColumns({"format": ok, "tool": tool, "params": params, "unnecessary": F.when(~has, F.coalesce(F.size(pred) > 0, F.lit(False))), "ask": F.when(F.col(gold_ask), F.coalesce(gold_ask, F.lit(False)) & F.coalesce(pred_ask, F.lit(False)))})
    return rows.withColumn("complete", F.when(has, F.col("tool") & (F.col("params") >= 1 - 1e-9))).drop("_s")


def summarize(df: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    """Means of boolean or numeric metrics without their nulls, how many rows each applies to, for each class and ALL."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.avg(F.col(m).cast("double")).alias(m), F.count(m).alias(f"n_{m}")]
    return df.rollup(by).agg(*aggs).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("ALL")))


def mean_over_seeds(df: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """Mean over runs named <config>_seedN of each run's mean: config, runs, metrics."""
    per = df.groupBy(run).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return per.groupBy(F.regexp_replace(run, r"_seed\d+$", "").alias("config")).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(m).alias(m) for m in metrics])


def match_required_calls(required: DataFrame, calls: DataFrame, by: str = "item_id") -> DataFrame:
    """by, pos, tool, matched share: each required call (pos, tool, arguments) against the item's calls (call_index, tool,
    arguments), greedily. An item's calls are one group."""
    def side(df: DataFrame, order: str, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("tool").alias("name"), "arguments"))), lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments"))).alias(name))

    both = side(required, "pos", "g").join(side(calls, "call_index", "p"), by, "left").withColumn("s", call_matching.shares(F.col("g"), F.col("p")))
    return both.select(by, F.posexplode(F.arrays_zip("g", "s")).alias("pos", "x")).select(by, "pos", F.col("x.g.name").alias("tool"), F.col("x.s").alias("share"))


def anchor_faithfulness(df: DataFrame, anchors: str = "anchors", evidence: str = "evidence") -> DataFrame:
    """Add faithfulness: share of an answer's anchors that some evidence text contains; null without anchors."""
    hit = F.size(F.filter(anchors, lambda a: F.exists(evidence, lambda e: F.contains(e, a))))
    return df.withColumn("faithfulness", F.when(F.size(anchors) > 0, hit / F.size(anchors)))


#: Words that speak of a trend, and words that say that nothing was found.
TREND = ("上升", "下降", "平稳", "趋势", "预测", "℃", "°C")
CALM = ("未发现", "无异常", "正常")


def evidence_faithfulness(df: DataFrame, trend: Sequence[str] = TREND, calm: Sequence[str] = CALM) -> DataFrame:
    """Add faithfulness, 0 to 1, judged by the type of evidence that an answer should rest on; null where it can't be judged.

    Columns: type, answer, anchors (array: titles and headings, or names), retrieved (a search succeeded), hit (it brought the
    gold passage), fault (the result's main fault), forecast (the mean forecast of a successful call), places (array: where anomalies
    are; null if there was no such call).

    kb_chunk: the share of anchors that the answer tells (half of an anchor's words, or containment either way); with the gold passage 1, or 0.5 if the
    answer tells no anchor; 0 without a successful search. kg_entities, kg_path: the share of names in the answer. dga_label: whether the
    fault is named. ett_dataset: 1 for the forecast's number, 0.6 for words of a trend, 0 without forecast. multi: as
    dga_label, else as ett_dataset. signal_inline: 1 for a place of an anomaly, or for words of calm where there is none, else 0.5; 0 without a call.
    """
    text, names = F.coalesce("answer", F.lit("")), F.coalesce("anchors", F.array().cast("array<string>"))
    said = lambda ws: reduce(lambda a, w: a | F.contains(text, F.lit(w)), ws, F.lit(False))
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    told = lambda a: (F.size(words(a)) > 0) & (F.size(words(text)) > 0) & ((2 * F.size(F.array_intersect(words(a), words(text))) >= F.size(words(a))) | F.contains(text, a) | F.contains(a, text))
    share = lambda found: F.size(F.filter(names, found)) / F.size(names)
    base = F.when(F.size(names) > 0, share(told)).otherwise(0.0)
    chunk = F.when(~F.coalesce("retrieved", F.lit(False)), 0.0).when(F.coalesce("hit", F.lit(False)), F.when(base > 0, 1.0).otherwise(0.5)).otherwise(base)
    fault = F.when(F.col("fault").isNotNull(), F.contains(text, F.col("fault")).cast("double"))
    forms = [F.format_string("%.1f", F.col("forecast")), F.format_string("%.0f", F.col("forecast")), F.col("forecast").cast("string")]
    number = reduce(lambda a, f: a | F.contains(text, f), forms, F.lit(False))
    forecast = F.when(F.col("forecast").isNull(), 0.0).when(number, 1.0).when(said(trend), 0.6).otherwise(0.0)
    at = F.exists("places", lambda p: F.contains(text, p.cast("string")))
    signal = F.when(F.col("places").isNull(), 0.0).when(((F.size("places") == 0) & said(calm)) | at, 1.0).otherwise(0.5)
    kind = F.col("type")
    judged = F.when(kind == "kb_chunk", chunk).when(kind.isin("kg_entities", "kg_path"), F.when(F.size(names) > 0, share(lambda a: F.contains(text, a)))).when(kind == "dga_label", F.coalesce(fault, F.lit(0.0)))
    judged = judged.when(kind == "ett_dataset", forecast).when(kind == "multi", F.coalesce(fault, forecast)).when(kind == "signal_inline", signal)
    return df.withColumn("faithfulness", judged)


def task_success(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Add success: actions, parameters and results all right and faithfulness, where judged, at least ``least``. A part that
    doesn't apply (null) doesn't fail it."""
    fine = reduce(lambda a, c: a & F.coalesce(F.col(c), F.lit(True)), ["action_ok", "params_ok", "results_ok"], F.lit(True))
    return df.withColumn("success", fine & F.coalesce(F.col("faithfulness") >= least, F.lit(True)))


def mode_summary(df: DataFrame, by: str = "mode", rates: Sequence[str] = ("success",), means: Sequence[str] = ("latency_ms",), ratio: tuple[str, str] | None = None, status: str | None = None, statuses: Sequence[str] = ()) -> DataFrame:
    """Rates, means, a ratio of sums and counts by status for each mode."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in rates], *[F.avg(c).alias(f"mean_{c}") for c in means]]
    if ratio:
        aggs.append((F.sum(ratio[0]) / F.sum(ratio[1])).alias(f"{ratio[0]}_per_{ratio[1]}"))
    aggs += [F.count_if(F.col(status) == s).alias(f"status_{s}") for s in statuses]
    return df.groupBy(by).agg(*aggs)


def call_signature(tool: Column, args: Column, defaults: Mapping[str, Mapping[str, str]] = {}, ignore: Sequence[str] = ("query",)) -> Column:
    """Canonical text of a call: defaults filled in, nulls dropped, keys sorted, free-text arguments left out."""
    given = F.coalesce(F.from_json(args, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(given, lambda k, v: v.isNotNull() & ~k.isin(*ignore) if ignore else v.isNotNull())
    base = F.from_json(F.lit("{}"), "map<string,string>")
    for name, values in defaults.items():
        base = F.when(tool == name, F.from_json(F.lit(json.dumps(dict(values))), "map<string,string>")).otherwise(base)
    entries = F.map_entries(F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept))
    return F.concat(tool, F.lit(":"), F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&"))


def duplicate_calls(existing: DataFrame, planned: DataFrame, by: str, order: str, signature: str = "signature") -> tuple[DataFrame, DataFrame]:
    """(calls to run, skipped calls with reason made or repeated)."""
    made = existing.select(by, signature).distinct().withColumn("_m", F.lit(True))
    w = Window.partitionBy(by, signature).orderBy(order)
    rows = planned.join(made, [by, signature], "left").withColumn("_r", F.row_number().over(w))
    reason = F.when(F.col("_m"), "made").when(F.col("_r") > 1, "repeated")
    rows = rows.withColumn("reason", reason).drop("_m", "_r")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")

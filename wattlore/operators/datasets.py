"""Building training and evaluation sets: seeds, argument checks, splits, leaks, trajectories, chat exports, preference pairs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.determinism import hash_key, hash_number, largest_remainder, quota_sample  # noqa: F401
from ..functions.steps import written
from .chat_records import export_chat, validate_arguments, validate_chat  # noqa: F401
from .claims import NO_ACTION
from .graph import bigrams
from .sealed import check_sealed, sealed_hash  # noqa: F401


def template_seeds(source: DataFrame, templates: DataFrame, slots: Sequence[str], category: str, id_cols: Sequence[str], seed: str | int = 0) -> DataFrame:
    """One seed for each source row: a template of its sub_type chosen by hash, {slot} replaced. templates: sub_type, k, n, template."""
    keyed = source.withColumn("_h", hash_number(seed, *id_cols))
    sizes = templates.select("sub_type", "n").distinct()
    rows = keyed.join(sizes, "sub_type").withColumn("k", F.pmod("_h", "n").cast("int")).join(templates.drop("n"), ["sub_type", "k"])
    query = reduce(lambda q, s: F.replace(q, F.lit("{" + s + "}"), F.col(s).cast("string")), slots, F.col("template"))
    out = rows.withColumns({"query": query, "category": F.lit(category)})
    return out.withColumn("seed_id", F.substring(F.md5(F.concat_ws("|", "category", "sub_type", "query")), 1, 10)).drop("_h", "n", "k", "template")


def dedup_seeds(seeds: DataFrame, order: Sequence[str]) -> DataFrame:
    """First seed of each seed_id by ``order``."""
    return seeds.groupBy("seed_id").agg(F.min_by(F.struct(*seeds.columns), F.struct(*order)).alias("s")).select("s.*")


def business_success(status: Column, result: Column) -> Column:
    """False for failure statuses, null results and empty lists; null only where the call was never made."""
    return F.when(F.lower(status).isin("error", "no_data", "failed", "no_match", "no_relation"), False).when(result.isNull() | F.trim(result).isin("", "null", "[]"), False).otherwise(True)


def drop_failed(seeds: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds whose every action succeeds, rejected seed_ids with the number of failures).

    seeds: seed_id, actions array<struct<tool, arguments>>; results: tool, arguments, status, result, one row for each distinct call.
    """
    calls = seeds.select("seed_id", F.explode("actions").alias("a")).select("seed_id", "a.tool", "a.arguments")
    ok = results.select("tool", "arguments", business_success(F.col("status"), F.col("result")).alias("ok"))
    bad = calls.join(ok, ["tool", "arguments"], "left").filter(~F.coalesce("ok", F.lit(False))).groupBy("seed_id").agg(F.count(F.lit(1)).alias("failures"))
    return seeds.join(bad, "seed_id", "left_anti"), bad


def group_split(df: DataFrame, group: str, fixed: DataFrame | None, fractions: Sequence[tuple[str, float]], seed: str | int = 0) -> DataFrame:
    """Add split: a group's fixed split where it has one; the others are cut in hash order at the shares."""
    from ..functions.determinism import split_by_group

    if fixed is None:
        return split_by_group(df, group, fractions, seed)
    known = df.join(fixed.select(group, "split"), group)
    rest = df.join(fixed.select(group), group, "left_anti")
    return known.unionByName(split_by_group(rest, group, fractions, seed))


def grams(text: Column) -> Column:
    """Distinct character pairs of a text without white space; its characters below eight."""
    t = F.regexp_replace(F.lower(text), r"\s", "")
    return F.when(F.length(t) < 8, F.array_distinct(F.split(t, ""))).otherwise(bigrams(text))


#: Size classes are so many to a factor thr; elements of a block; elements that a text counts for at least, which
#: bounds a block's texts; how many times a column of a matrix product is cheaper than its pairs one by one.
STEPS, BLOCK, LEAST, DENSE = 4, 400_000, 200, 256


def _shared(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Shared elements of each set of a block with each of another's. Sets lie one after another in a and b, na and nb are their sizes.

    Elements that many sets of both have are columns of a matrix product; the pairs of the others are counted one by one.
    """
    (va, ia), (vb, ib) = (np.unique(x, return_inverse=True) for x in (a, b))
    both, pa_, pb_ = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    out = np.zeros((len(na), len(nb)), np.float32)
    if not len(both):
        return out
    sides = []
    for i, n, place, size in ((ia, na, pa_, len(va)), (ib, nb, pb_, len(vb))):
        column = np.full(size, -1)
        column[place] = np.arange(len(both))
        c, row = column[i], np.repeat(np.arange(len(n)), n)
        c, row = c[c >= 0], row[c >= 0]
        order = np.argsort(c, kind="stable")
        sides.append((c[order], row[order], np.bincount(c, minlength=len(both))))
    (ca, ra, fa), (cb, rb, fb) = sides
    dense = fa * fb * DENSE > len(na) * len(nb)
    at = np.cumsum(dense) - 1
    for x in range(0, int(dense.sum()), 1024):
        m = []
        for c, r, rows in ((ca, ra, len(na)), (cb, rb, len(nb))):
            own = dense[c] & (at[c] >= x) & (at[c] < x + 1024)
            one = np.zeros((rows, min(1024, int(dense.sum()) - x)), np.float32)
            one[r[own], at[c[own]] - x] = 1
            m.append(one)
        out += m[0] @ m[1].T
    keep_a, keep_b = ~dense[ca], ~dense[cb]
    ca, ra, rb, fb, first = ca[keep_a], ra[keep_a], rb[keep_b], np.where(dense, 0, fb), np.cumsum(np.where(dense, 0, fb)) - np.where(dense, 0, fb)
    for x in range(0, len(ca), 10_000):
        c, n = ca[x : x + 10_000], fb[ca[x : x + 10_000]]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(ra[x : x + 10_000], n), rb[np.repeat(first[c], n) + within]), 1)
    return out


def near_duplicate_leaks(train: DataFrame, test: DataFrame, text: str = "text", train_id: str = "train_id", test_id: str = "test_id", thr: float = 0.9) -> DataFrame:
    """train_id, test_id, jaccard above thr, exact.

    Texts of ordinary language share most of their character pairs, so no part of them tells unlike texts apart. Equal texts are
    taken once and packed into blocks of one size class; blocks meet those of the classes that thr allows, and the shared
    elements of all their pairs are counted at once. Work grows with the product of both sides' distinct texts of like sizes,
    memory is a pair of blocks, and only pairs above thr leave a task.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(text).alias("t")).distinct().select(F.md5("t").alias("k"), F.filter(grams(F.col("t")), lambda g: g != "").alias("g"))
        rows = rows.filter(F.size("g") > 0).select("k", F.transform("g", lambda g: F.xxhash64(g)).alias("h"), F.size("g").alias("n"))
        rows = written(rows.withColumn("c", F.floor(F.log("n") / -math.log(thr) * STEPS + 1e-9).cast("int")))
        blocks = rows.groupBy("c").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / BLOCK).alias("blocks"))  # a row for each size class
        rows = rows.join(F.broadcast(blocks), "c").withColumn("b", F.pmod(F.xxhash64("k"), "blocks"))

        def pack(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            h = pc.list_flatten(t.column("h")).to_numpy()
            return pa.table({f"c{name}": t.column("c")[:1], f"k{name}": pa.array([t.column("k").to_pylist()]), f"n{name}": pa.array([t.column("n").to_numpy().astype(np.int32).tobytes()]), f"h{name}": pa.array([h.tobytes()])})

        return written(rows.groupBy("c", "b").applyInArrow(pack, f"c{name} int, k{name} array<string>, n{name} binary, h{name} binary"))

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for i in range(f.num_rows):
                at = lambda c, f=f, i=i: f.column(c)[i]
                (na, nb), (ha, hb) = (([np.frombuffer(at(c + s).as_py(), kind) for s in "ab"]) for c, kind in (("n", np.int32), ("h", np.int64)))
                shared = _shared(ha, na, hb, nb)
                x, y = np.nonzero(shared * (1 + thr) > thr * (na[:, None] + nb[None]).astype(np.float32) - 0.5)
                both = shared[x, y].astype(np.float64)
                jaccard = both / (na[x] + nb[y] - both)
                x, y, jaccard = (v[jaccard > thr] for v in (x, y, jaccard))
                yield pa.RecordBatch.from_arrays([at("ka").values.take(pa.array(x)), at("kb").values.take(pa.array(y)), pa.array(jaccard)], ["a", "b", "jaccard"])

    near = F.abs(F.col("ca") - F.col("cb")) <= STEPS
    alike = written(side(train, "a").join(side(test, "b"), near).mapInArrow(meet, "a string, b string, jaccard double"))
    return alike.join(train.select(F.col(train_id), F.md5(text).alias("a")), "a").join(test.select(F.col(test_id), F.md5(text).alias("b")), "b").select(train_id, test_id, "jaccard")


def distribution_report(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts over every subset of the dimensions (ALL where one is summed over), with the share of all rows."""
    out = df.cube(*dims).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    out = out.withColumns({d: F.when(F.col(f"_g_{d}") == 1, "ALL").otherwise(F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dims}).drop(*[f"_g_{d}" for d in dims])
    return out.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))


NUMBERS = r"\d+(?:\.\d+)?"


def rewrite_guard(df: DataFrame, seed: str, rewrite: str, banned: Sequence[str], terms: Sequence[str] = (), lo: float = 0.5, hi: float = 2.0, least: float = 0.6) -> DataFrame:
    """Add reason: the first that fails of length, duplicate, lost_number, added_number, banned, entity; null if none does.

    Numbers are compared as sets; of the stated terms in the seed at least ``least`` have to stay.
    """
    s, r = F.col(seed), F.col(rewrite)
    ns, nr = (F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBERS), F.lit(0))) for c in (s, r))
    words = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    had = F.filter(words, lambda t: F.contains(s, t))
    stay = F.size(F.filter(had, lambda t: F.contains(r, t)))
    bad = F.exists(F.array(*[F.lit(b) for b in banned]), lambda b: F.contains(r, b) & ~F.contains(s, b)) if banned else F.lit(False)
    reason = (
        F.when(r.isNull() | (F.length(r) < lo * F.length(s)) | (F.length(r) > hi * F.length(s)), "length").when(F.trim(r) == F.trim(s), "duplicate")
        .when(F.size(F.array_except(ns, nr)) > 0, "lost_number").when(F.size(F.array_except(nr, ns)) > 0, "added_number").when(bad, "banned")
        .when((F.size(had) > 0) & (stay < least * F.size(had)), "entity")
    )
    return df.withColumn("reason", reason)


def lexicon_terms(groups: Sequence[DataFrame], least: int = 2) -> DataFrame:
    """term: the union of term tables, trimmed, at least ``least`` characters, longest first, with its place."""
    rows = reduce(DataFrame.unionByName, [g.select(F.trim("term").alias("term")) for g in groups]).filter(F.length("term") >= least).distinct()
    rows = rows.withColumns({"n": F.length("term"), "head": F.substring("term", 1, 2)})  # terms of a length and a beginning are ranked together
    sizes = rows.groupBy("n", "head").agg(F.count(F.lit(1)).alias("c"))
    base = sizes.select("n", "head", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, ["n", "head"]).select("term", (F.col("base") + F.row_number().over(Window.partitionBy("n", "head").orderBy("term"))).alias("place"))


def compose_trajectories(seeds: DataFrame, first: DataFrame, second: DataFrame, retry: DataFrame) -> DataFrame:
    """seed_id, pos, role, tool, arguments, content: two-step trajectories. The first call's entity parametrises the second;
    no_relation retries relaxed, anything else gives up.

    seeds: seed_id, query, tool, arguments; first: tool, arguments, status, entity, content; second, retry: entity, tool, arguments, status, content.
    """
    a = seeds.join(first.select("tool", "arguments", F.col("status").alias("s1"), "entity", F.col("content").alias("c1")), ["tool", "arguments"], "left")
    b = second.select("entity", F.col("tool").alias("t2"), F.col("arguments").alias("a2"), F.col("status").alias("s2"), F.col("content").alias("c2"))
    r = retry.select("entity", F.col("tool").alias("t3"), F.col("arguments").alias("a3"), F.col("status").alias("s3"), F.col("content").alias("c3"))
    rows = a.join(b, "entity", "left").join(r, "entity", "left")
    none = F.lit(None).cast("string")
    turn = lambda role, tool, args, content: F.struct(F.lit(role).alias("role"), tool.alias("tool"), args.alias("arguments"), content.alias("content"))
    call = lambda t, a_, c: F.array(turn("assistant", F.col(t), F.col(a_), none), turn("tool", F.col(t), none, F.col(c)))
    ok, go_on = F.col("s1") == "ok", F.col("s2") == "no_relation"
    end = F.array(turn("assistant", none, none, F.when(ok & ((F.col("s2") == "ok") | (go_on & (F.col("s3") == "ok"))), "finish").otherwise("give_up")))
    empty = F.slice(end, 1, 0)
    turns = F.concat(F.array(turn("user", none, none, F.col("query"))), call("tool", "arguments", "c1"), F.when(ok & F.col("t2").isNotNull(), call("t2", "a2", "c2")).otherwise(empty), F.when(ok & go_on & F.col("t3").isNotNull(), call("t3", "a3", "c3")).otherwise(empty), end)
    return rows.select("seed_id", F.posexplode(turns).alias("pos", "t")).select("seed_id", "pos", "t.*")


def error_recovery_rows(seeds: DataFrame, wrong: DataFrame, right: DataFrame) -> DataFrame:
    """seed_id, pos, role, arguments, content: a wrong first call, its real error, the corrected call and its result."""
    rows = seeds.select("seed_id", "query").join(wrong.select("seed_id", F.col("arguments").alias("wa"), F.col("error").alias("we")), "seed_id").join(right.select("seed_id", F.col("arguments").alias("ra"), F.col("content").alias("rc")), "seed_id")
    turn = lambda role, a, c: F.struct(F.lit(role).alias("role"), a.alias("arguments"), c.alias("content"))
    none = F.lit(None).cast("string")
    turns = F.array(turn("user", none, F.col("query")), turn("assistant", F.col("wa"), none), turn("tool", none, F.col("we")), turn("assistant", F.col("ra"), none), turn("tool", none, F.col("rc")))
    return rows.select("seed_id", F.posexplode(turns).alias("pos", "t")).select("seed_id", "pos", "t.*")


def decision_prefixes(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", skip_first: Column | None = None) -> DataFrame:
    """One row for each assistant turn: the messages before it, its text as target, decision_index. skip_first: rows whose
    conversation's first decision is no target (recovery from an error)."""
    w = Window.partitionBy(id_col).orderBy(order)
    part = F.struct("role", "text")
    rows = turns.withColumns({"messages": F.collect_list(part).over(w.rowsBetween(Window.unboundedPreceding, -1)), "decision_index": F.count_if(F.col("role") == "assistant").over(w) - 1})
    rows = rows.filter(F.col("role") == "assistant")
    if skip_first is not None:
        rows = rows.filter(~(skip_first & (F.col("decision_index") == 0)))
    return rows.select(id_col, order, "decision_index", "messages", F.col("text").alias("target"))


def required_actions(actions: DataFrame, key_params: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add key_params: of each call's JSON arguments (tool, arguments) the stated keys of its tool."""
    args = F.from_json("arguments", "map<string,string>")
    keys = reduce(lambda a, kv: F.when(F.col("tool") == kv[0], F.array(*[F.lit(k) for k in kv[1]])).otherwise(a), key_params.items(), F.array().cast("array<string>"))
    return actions.withColumn("_k", keys).withColumn("key_params", F.map_filter(args, lambda k, v: F.array_contains("_k", k))).drop("_k")


def repaired_actions(calls: DataFrame, by: str, order: str) -> DataFrame:
    """Failed calls paired with the next call that succeeds: by, tool, failed, arguments, fixed_arguments."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("ok"), F.struct("tool", "arguments")), True).over(w)
    return calls.withColumn("_n", nxt).filter("not ok").select(by, order, "tool", "arguments", F.col("_n.arguments").alias("fixed_arguments"))


def stratified_min(df: DataFrame, by: str, n: int, min_n: int, seed: str | int, id_col: str) -> DataFrame:
    """n rows in proportion to the classes, each with at least min_n of its rows."""
    quota = largest_remainder(df.groupBy(by).count(), by, n, min_n).select(by, "n")
    return quota_sample(df, by, quota, seed, id_col)[0]


def stratified_one_each(df: DataFrame, by: str, n: int, seed: str | int, id_col: str) -> DataFrame:
    """n rows in hash order with at least one of every class: each class's first row, then the best of the rest."""
    first = Window.partitionBy(by).orderBy(hash_key(seed, id_col), id_col)
    rows = df.withColumn("_rest", F.when(F.row_number().over(first) == 1, 0).otherwise(1))
    return rows.orderBy("_rest", hash_key(seed, id_col), id_col).limit(n).drop("_rest")


FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
TAGGED = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S)


def parse_calls(content: str | None) -> list[dict] | None:
    """Calls (name, arguments JSON) of a fenced or bare JSON plan or of tagged calls; null if nothing legal is there."""
    text = content or ""
    found = []
    try:
        if tags := TAGGED.findall(text):
            found = [json.loads(t) for t in tags]
        else:
            m = FENCE.search(text)
            plan = json.loads(m[1] if m else text)
            found = plan.get("steps", plan.get("tool_calls", [plan] if "name" in plan or "tool" in plan else [])) if isinstance(plan, dict) else plan
        return [{"name": c.get("name") or c["tool"], "arguments": json.dumps(c.get("arguments", {}), sort_keys=True, ensure_ascii=False)} for c in found]
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def parse_candidate(col: Column) -> Column:
    @F.pandas_udf("array<struct<name:string,arguments:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse_calls)

    return run(col)


parse_prediction = parse_candidate


def score_candidates(df: DataFrame, penalty: float = 0.1) -> DataFrame:
    """Add tool, schema, ask parts, extra_calls, score_exec and score_full (four places, at least 0).

    df: format_ok, tools, gold_tools (arrays), schema_ok, business_ok (booleans), faith (0..1), asks (array), gold_ask (array).
    """
    n, g = F.size("tools"), F.size("gold_tools")
    fine = F.col("format_ok")
    b = lambda c: F.when(fine & c, 1.0).otherwise(0.0)
    need = g > 0
    made = lambda c: F.when(n == 0, F.when(need, 0.0).otherwise(1.0)).otherwise(c)
    hit = F.exists("asks", lambda c: F.exists("gold_ask", lambda q: F.contains(c, q) | F.contains(q, c)))
    ask = F.when(F.size("gold_ask") > 0, F.when(hit, 1.0).otherwise(0.0)).otherwise(F.when(F.size("asks") > 0, 0.0).otherwise(1.0))
    parts = {
        "part_format": b(F.lit(True)), "part_tool": b(F.array_sort("tools") == F.array_sort("gold_tools")), "part_schema": F.when(fine, made(F.col("schema_ok").cast("double"))).otherwise(0.0),
        "part_business": F.when(fine, made(F.col("business_ok").cast("double"))).otherwise(0.0), "part_faith": F.when(fine, made(F.col("faith"))).otherwise(0.0), "part_ask": F.when(fine, ask).otherwise(0.0),
    }
    rows = df.withColumns(parts).withColumn("extra_calls", F.when(fine, F.greatest(n - g, F.lit(0))).otherwise(0))
    mean = lambda names: reduce(lambda x, y: x + y, [F.col(f"part_{x}") for x in names]) / len(names)
    return rows.withColumns({"score_exec": F.round(mean(("format", "tool", "schema", "business")), 4), "score_full": F.round(F.greatest(F.lit(0.0), mean(("format", "tool", "schema", "business", "faith", "ask")) - penalty * F.col("extra_calls")), 4)})


def preference_pairs(scored: DataFrame, key: str, score: str = "score_full", id_col: str = "candidate_id", min_gap: float = 0.3) -> DataFrame:
    """key, chosen, rejected, gap: best against worst candidate by (score, id), with at least min_gap between them."""
    pick = F.struct(score, id_col)
    rows = scored.groupBy(key).agg(F.max(pick).alias("c"), F.min(pick).alias("r")).withColumn("gap", F.round(F.col(f"c.{score}") - F.col(f"r.{score}"), 6))
    return rows.filter(F.col("gap") >= min_gap).select(key, F.col(f"c.{id_col}").alias("chosen"), F.col(f"r.{id_col}").alias("rejected"), "gap")


def export_preference(pairs: DataFrame, prompts: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, record: JSON with messages, chosen and rejected; pairs with equal texts go. prompts: key, messages; candidates: candidate_id, text."""
    of = lambda c: candidates.select(F.col("candidate_id").alias(c), F.col("text").alias(f"_{c}"))
    rows = pairs.join(prompts, key).join(of("chosen"), "chosen").join(of("rejected"), "rejected").filter(F.col("_chosen") != F.col("_rejected"))
    said = lambda c: F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content"))
    return rows.select(key, F.to_json(F.struct(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"), said("_chosen").alias("chosen"), said("_rejected").alias("rejected"))).alias("record"))


def leakage_by_key(pairs: DataFrame, seeds: DataFrame, holdout: DataFrame, key: str = "seed_id", groups: Sequence[str] = ("seed_source", "group_key")) -> DataFrame:
    """key, hits: which rules a pair's prompt breaks: not_train, or one of the groups shared with test or holdout rows."""
    rows = pairs.select(key).join(seeds.select(key, "split", *groups), key, "left")
    rows = rows.withColumn("not_train", F.when(~F.coalesce(F.col("split") == "train", F.lit(False)), "not_train"))
    barred = seeds.filter("split = 'test'").select(*groups).unionByName(holdout.select(*groups))
    for g in groups:
        rows = rows.join(barred.select(g).filter(F.col(g).isNotNull()).distinct().withColumn(f"_{g}", F.lit(g)), g, "left")
    return rows.select(key, F.array_compact(F.array("not_train", *[f"_{g}" for g in groups])).alias("hits")).filter(F.size("hits") > 0)


def perturb_candidates(seeds: DataFrame, other_tools: Sequence[str], seed: str | int = 0) -> DataFrame:
    """seed_id, candidate_id, source, tools: the gold call list and labelled variants. seeds: seed_id, gold_tools."""
    other = F.element_at(F.array(*[F.lit(t) for t in other_tools]), (F.pmod(hash_number(seed, "seed_id"), F.lit(len(other_tools))) + 1).cast("int"))
    gold = F.col("gold_tools")
    variants = {"gold": gold, "wrong_tool": F.transform(gold, lambda t, i: F.when(i == 0, other).otherwise(t)), "extra": F.concat(gold, F.array(other)), "missing": F.slice(gold, 2, F.greatest(F.size(gold), F.lit(1))), "spurious": F.concat(gold, gold)}
    rows = seeds.select("seed_id", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("tools")) for k, v in variants.items()])).alias("v"))
    return rows.select("seed_id", F.concat_ws("-", F.col("seed_id").cast("string"), "v.source").alias("candidate_id"), "v.source", "v.tools")


def inject_errors(claims: DataFrame, id_cols: Sequence[str] = ("item_id", "id"), scopes: Mapping[str, str] | None = None, seed: str | int = 0, contradiction: str = NO_ACTION[0]) -> DataFrame:
    """Labelled single-fault variants of claims (text, ref, span), a row for each injector that applies: number changed by
    0.7 or 1.3, reference that isn't there, span replaced, scope word swapped, a phrase added that says nothing needs doing."""
    number = F.regexp_extract("text", NUMBERS, 0)
    factor = F.when(F.pmod(hash_number(seed, *id_cols), F.lit(2)) == 0, 0.7).otherwise(1.3)
    changed = F.regexp_replace("text", "^(.*?)" + NUMBERS, F.concat(F.lit("$1"), F.format_string("%.2f", number.try_cast("double") * factor)))
    text, ref, span = F.col("text"), F.col("ref"), F.col("span")
    scope = reduce(lambda a, kv: F.when(F.contains(text, F.lit(kv[0])), F.replace(text, F.lit(kv[0]), F.lit(kv[1]))).otherwise(a), (scopes or {}).items(), F.lit(None).cast("string"))
    v = lambda name, expects, t, r, s, on: F.when(on, F.struct(F.lit(name).alias("subtype"), F.lit(expects).alias("expected"), t.alias("text"), r.alias("ref"), s.alias("span")))
    made = F.array_compact(F.array(
        v("number", "DATA", changed, ref, span, number != ""), v("fake_ref", "EVIDENCE", text, F.concat(ref, F.lit("-none")), span, ref.isNotNull()), v("span", "EVIDENCE", text, ref, F.lit("no such passage"), span.isNotNull()),
        v("scope", "SCOPE", scope, ref, span, scope.isNotNull()), v("contradiction", "SAFETY", F.concat(text, F.lit(f" {contradiction}。")), ref, span, F.lit(True)),
    ))
    return claims.select(*id_cols, F.explode(made).alias("x")).select(*id_cols, "x.*")


def balanced_pick(candidates: DataFrame, n: int, seed: str | int = 0, subtype: str = "subtype", base: str = "item_id") -> DataFrame:
    """n rows by round robin over subtypes, bases used less first: order is (place within subtype, subtype)."""
    w = Window.partitionBy(subtype, base).orderBy(hash_key(seed, subtype, base))
    rows = candidates.withColumn("_b", F.row_number().over(w))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(subtype).orderBy("_b", hash_key(seed, subtype, base), base)))
    return rows.orderBy("_r", subtype, base).limit(n).drop("_b", "_r")

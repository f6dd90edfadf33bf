import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlore.functions import determinism as D
from wattlore.operators import bayes, claims, datasets, fusion, graph, logs, policy, records, series


def test_ratio_codes(spark):
    rows = [(h2, ch4, c2h2, c2h4, c2h6) for h2, ch4, c2h2, c2h4, c2h6 in [(1.0, 0.05, 0.05, 1.0, 1.2), (1.0, 0.5, 0.1, 1.0, 1.0), (1.0, 1.0, 2.9, 1.0, 0.25), (0.0, 1.0, 3.0, 1.0, 0.0), (None, 1.0, 1.0, 0.0, 1.0)]]
    df = records.ratio_codes(spark.createDataFrame(rows, "H2 double, CH4 double, C2H2 double, C2H4 double, C2H6 double"))
    assert [(r.code1, r.code2, r.code3) for r in df.collect()] == [(0, 1, 0), (1, 0, 1), (1, 2, 2), (2, 1, 1), (1, None, 0)]
    out = records.match_rules(df, ["partial_discharge"]).collect()
    assert out[0].boost_partial_discharge == 0.84 and out[4].boost_partial_discharge == 0


def test_evidence(spark):
    df = spark.createDataFrame([(150.0, 1.0, 1.0, 1.0, 1.0), (150.1, 1.0, 60.0, 1.0, 100.0), (None, None, 1.0, 1.0, 1.0)], "H2 double, CH4 double, C2H2 double, C2H4 double, C2H6 double")
    a, b, c = records.derive_evidence(df).collect()
    assert (a.H2_elevated, b.H2_elevated, c.H2_elevated, c.TDCG_elevated, b.TDCG_elevated, b.gas_rate_rapid) == (False, True, None, None, True, True)
    assert records.derive_evidence(df, negative=False).first().H2_elevated is None
    assert "C2H2 above 5" in records.interpret(df).collect()[1].interpretation


def test_posterior_fusion_temperature(spark):
    df = spark.createDataFrame([(True, 0.0, 0.0), (False, 0.0, 0.0), (None, 0.0, 0.5)], "s boolean, boost_a double, boost_b double")
    prior, cpt = {"a": 0.5, "b": 0.5}, {"a": {"s": 0.9}, "b": {"s": 0.1}}
    p = bayes.naive_bayes_posterior(df, prior, cpt, ["s"])
    assert [round(r.p_a, 6) for r in p.collect()] == [0.9, 0.1, 0.5]
    assert [round(r.p_a, 6) for r in bayes.fuse_rules(p, ["a", "b"], {"b": 1.7}).collect()] == [0.9, 0.1, 0.5]
    third = bayes.fuse_rules(p, ["a", "b"], {"b": 0.2}).collect()[2]
    assert third.p_a == pytest.approx(0.5 / (0.5 + 0.2 * 0.5 + 0.8 * 0.5))
    hot, same = bayes.temperature_scale(p, ["a", "b"], 2.0), bayes.temperature_scale(p, ["a", "b"], 1.0)
    assert [r.p_a for r in same.collect()] == pytest.approx([0.9, 0.1, 0.5]) and hot.first().p_a == pytest.approx(3 / 4)
    u = bayes.uncertainty(p, ["a", "b"]).collect()
    assert u[2].entropy == pytest.approx(1) and u[2].top1 == "a" and u[0].gap == pytest.approx(0.8)
    assert [(r["class"], r["rank"], r.band) for r in bayes.rank_classes(p.limit(1).withColumn("id", F.lit(1)), ["a", "b"], "id").collect()] == [("a", 1, "high"), ("b", 2, "low")]


def test_learn(spark):
    rows = [("f", True)] * 3 + [("f", False)] + [("g", None)] * 6
    learned = bayes.learn_params(spark.createDataFrame(rows, "y string, s boolean").withColumn("never", F.lit(None).cast("boolean")), "y", ["f", "g"], ["s", "never"], expert={"f": {"never": 0.9}})
    assert learned["cpt"]["f"]["s"] == 0.66667 and learned["cpt"]["f"]["never"] == 0.7 and learned["prior"]["f"] == round(5 / 12, 5)


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1.0, 0.0, "a"), (0.4, 0.6, "a")], "p_a double, p_b double, y string")
    summary, bins = bayes.calibration_metrics(df, ["a", "b"], "y")
    assert {r.bin for r in bins.collect()} == {14, 9}
    s = summary.first()
    assert s.top1 == 0.5 and s.top3 == 1 and s.ece == pytest.approx(0.3)


def test_information_gain(spark):
    classes, symptoms = ["a", "b", "c"], ["s", "t", "u"]
    prior, cpt = dict(zip(classes, (0.2, 0.3, 0.5))), {c: {s: 0.1 + 0.25 * ((i + j) % 3) for j, s in enumerate(symptoms)} for i, c in enumerate(classes)}
    rows = [(i, *x) for i, x in enumerate(itertools.product([True, False, None], repeat=3))]
    df = spark.createDataFrame(rows, "id int, s boolean, t boolean, u boolean")
    got = bayes.information_gain(df, "id", classes, symptoms, prior, cpt, basis="bayes").collect()
    assert len(got) == 27 and all(-1e-9 <= r.eig <= r.entropy + 1e-9 for r in got)
    costs = spark.createDataFrame([("s", 1.0), ("t", 0.0), ("u", 0.5)], "symptom string, cost double")
    free = bayes.recommend(spark.createDataFrame(got), "id", costs, lam=0.0, tau=0.0, eps=-1.0).collect()
    assert all(r.voi == pytest.approx(r.eig, abs=1e-5) for r in free)
    stop = bayes.recommend(spark.createDataFrame(got), "id", costs, tau=99.0).collect()
    assert {r.stop for r in stop} == {"entropy"} and {r.action for r in stop} == {"conclude"}


def test_cross_validation_against_plain_fits(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    classes, symptoms = ["a", "b", "c"], ["s", "t"]
    n = 400
    maybe = lambda: [None if x < 0.2 else bool(x < 0.6) for x in rng.random(n)]
    rows = pd.DataFrame({"s": maybe(), "t": maybe(), "boost_a": rng.choice([0, 0.8], n), "boost_b": rng.choice([0, 0.0, 0.3], n), "fault": rng.choice(["a", "b", "c", "other", None], n, p=[0.4, 0.2, 0.2, 0.1, 0.1]), "fold": rng.integers(0, 3, n), "half": rng.integers(0, 2, n)})
    df = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in rows.astype(object).itertuples(index=False)], "s boolean, t boolean, boost_a double, boost_b double, fault string, fold long, half int")
    got = {r.fold: r for r in bayes.cross_validate(df, "fault", classes, symptoms).collect()}
    table = bayes.patterns(df, "fault", symptoms, classes, ["fold", "half"]).toPandas()
    for k in range(3):
        train, val = table[table["fold"] != k], table[table["fold"] == k]
        counts = pd.DataFrame({"label": train["label"], "n": train["n"], **{f"pos_{s}": train["n"] * (train[s] == True).astype(int) for s in symptoms}})  # noqa: E712
        counts["label"] = counts["label"].fillna("none")
        learned = bayes.params_from_counts(counts, classes, symptoms)
        fit, test = (bayes.PatternModel(val[val["half"] == h], classes, symptoms, learned["prior"], learned["cpt"]) for h in (0, 1))
        w = np.full(3, 0.7)
        best = fit.nll(w)
        for _ in range(2):
            for i in range(3):
                for g in fusion.GRID:
                    trial = np.where(np.arange(3) == i, g, w)
                    if (v := fit.nll(trial)) < best - 1e-9:
                        w, best = trial, v
        t = min(fusion.TEMPERATURES, key=lambda t: (round(fit.nll(w, t), 12), t))
        assert (got[k].nll_default, got[k].nll_weights, got[k].nll_both, got[k].t) == pytest.approx((test.nll(np.full(3, 0.7)), test.nll(w), test.nll(w, t), t), abs=1e-9)
        assert fit.nll(w, t) <= fit.nll(w) + 1e-12 <= fit.nll(np.full(3, 0.7)) + 1e-9


def test_masking_and_quotas(spark):
    rows = spark.createDataFrame([(i, *[float(i + 1)] * 5, "x" if i < 7 else "y") for i in range(10)], "id int, H2 double, CH4 double, C2H2 double, C2H4 double, C2H6 double, fault string")
    got = records.mask_measures(rows, "id").collect()
    assert len(got) == 30
    for r in got:
        k = {"light": 1, "medium": 2, "heavy": 3}[r.level]
        assert len(r.masked) == k and sum(r[f"visible_{g}"] is None for g in records.GASES) == k
        assert all(r[f"initial_{g}_elevated"] is None or r[f"hidden_{g}_elevated"] is None for g in records.GASES)
    assert {r["fault"]: r["count"] for r in D.proportional_sample(rows, "fault", 5, 1, "id").groupBy("fault").count().collect()} == {"x": 4, "y": 1}
    assert D.content_hash(rows, "id").first() == D.content_hash(rows.repartition(3), "id").first()


def test_holdout_and_strata(spark):
    rng = random.Random(0)
    rows = [(i, y, rng.random() < (0.9 if y == "a" else 0.1)) for i, y in enumerate(rng.choices("ab", k=300))]
    df = spark.createDataFrame(rows, "id int, y string, s boolean")
    got = {r.params: r for r in bayes.holdout_eval(df, "y", ["a", "b"], ["s"], {"a": 0.5, "b": 0.5}, {"a": {"s": 0.5}, "b": {"s": 0.5}}, "id").collect()}
    assert got["expert"].n == got["learned"].n and 50 < got["expert"].n < 130 and got["learned"].top1 > 0.8 and got["learned"].nll < got["expert"].nll
    few = datasets.stratified_one_each(df, "y", 3, 1, "id").collect()
    assert len(few) == 3 and {r.y for r in few} == {"a", "b"}


def test_assign_ids(spark):
    got = records.assign_ids(spark.range(57).withColumnRenamed("id", "k"), ["k"], 50).orderBy("k").collect()
    assert [r.record_id for r in got] == [f"R{i:06d}" for i in range(57)] and got[51].device_id == "D01"


def test_policy(spark):
    b, c = 20, 5
    assert 0.003 < policy.binomial_two_sided(b, c) < 0.005 and policy.binomial_two_sided(0, 0) == 1
    snaps = spark.createDataFrame([("t", 0, 1.0, 5, 0.5, 0, "a", 0.0), ("t", 1, 0.9, 5, 0.01, 1, "b", 0.5), ("t", 2, 0.1, 5, 0.5, 2, "c", 1.0)], "traj_id string, q int, entropy double, n_cands int, best_voi double, n_queries int, top1 string, cost double")
    stops = policy.stop_index(snaps)
    assert tuple(stops.first()) == ("t", 1, "voi")
    labels = spark.createDataFrame([("t", "light", "b")], "traj_id string, level string, label string")
    assert policy.adaptive_report(snaps, stops, labels).filter("level = 'ALL'").first().accuracy == 1
    assert {r.budget: r.accuracy for r in policy.budget_curve(snaps, labels, [0, 1, 9]).collect()} == {0: 0, 1: 1, 9: 0}
    d = spark.createDataFrame([(float(x), 0.0) for x in range(1, 11)], "a double, b double")
    row = policy.paired_permutation(d, "a", "b", 2000).first()
    assert policy.paired_permutation(d.repartition(7), "a", "b", 2000, run=1).first() == row  # whatever the layout
    seen = spark.createDataFrame([("t", 0, {"a": 0.5, "b": 0.3, "c": 0.2}, "a"), ("u", 0, {"a": 0.1, "b": 0.2, "c": 0.7}, "c"), ("v", 0, {"a": 0.4, "b": 0.6}, "b")], "traj_id string, q int, posterior map<string,double>, top1 string").withColumns({"n_queries": F.lit(0), "cost": F.lit(0.0)})
    ends = seen.select("traj_id", "q", F.lit("voi").alias("reason"))
    marks = spark.createDataFrame([("t", "x", "b"), ("u", "x", "c"), ("v", "y", "c")], "traj_id string, level string, label string")
    all_ = policy.adaptive_report(seen, ends, marks).filter("level = 'ALL'").first()
    assert all_.nll == pytest.approx(-(math.log(0.3) + math.log(0.7) + math.log(1e-12)) / 3) and all_.hit_2 == pytest.approx(2 / 3)
    assert all_.ece == pytest.approx((0.5 + 0.3 + 0.6) / 3)
    assert row.n == 10 and row.p < 0.02
    assert policy.paired_permutation(spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0)] * 5, "a double, b double"), "a", "b", 500).first().p == 1


def test_series(spark):
    ts = [("s", f"2024-01-01 00:{m:02d}:00", float(m), float(m) * 2 + 1) for m in (0, 15, 45)]
    df = spark.createDataFrame(ts, "series_id string, t string, x double, y double").withColumn("ts", F.to_timestamp("t"))
    grid = series.regularize(df, "15 minutes").orderBy("ts").collect()
    assert [r.is_missing for r in grid] == [False, False, True, False]
    arr = spark.createDataFrame([([1.0, 2.0],), ([5.0] * 10,), ([0.0] * 29 + [100.0],)], "v array<double>").select(series.array_anomalies(F.col("v")).alias("a")).collect()
    assert arr[0].a.error and arr[1].a.indices == [] and arr[2].a.indices == [29]
    fit = series.fit_linear(df, ["x"], "y", min_rows=2).first()
    assert fit.coef["x"] == pytest.approx(2, abs=1e-3) and fit.r2 == pytest.approx(1, abs=1e-4)
    f = series.forecast_hold_last(df.withColumn("y", F.when(F.col("x") == 45, 100.0).otherwise(F.col("y"))), spark.createDataFrame([("s", 1.0, {"x": 2.0})], "series_id string, bias double, coef map<string,double>"), ["x"], "y", 2).orderBy("step").collect()
    assert [r.forecast for r in f] == pytest.approx([91 + 0.9, 91 + 0.09])
    wins = series.sample_windows(df, 2, 2, value="x").collect()
    assert all(len(w.signal) == 2 for w in wins)


LEX = [("arc", "arc", "fault"), ("core", "core", "component"), ("core fault", "core fault", "fault"), ("gas", "gas", "sign")]


def test_extraction(spark):
    df = spark.createDataFrame([("u1", "d1", 0, "The core fault produces gas in scores."), ("u2", "d2", 0, "The core fault produces gas again.")], "unit_id string, doc_id string, pos int, sentence string")
    ents = graph.match_entities(df, LEX)
    assert [e.canon for e in ents.first().entities] == ["core fault", "gas"]
    from wattlore.operators.relations import LEGAL, TRIGGERS, Rules

    rules = Rules(triggers=TRIGGERS | {"PRODUCES": "produces"}, legal=LEGAL | {"PRODUCES": (("fault",), ("sign",))}, tails={})
    t = graph.aggregate_triples(graph.extract_relations(ents, rules)).collect()
    assert [(r["head"], r.relation, r["tail"], r.support_count, len(r.evidence)) for r in t] == [("core fault", "PRODUCES", "gas", 2, 2)]


def test_paths(spark):
    e = spark.createDataFrame([("a", "R", "b", 3, 0.6), ("b", "R", "c", 2, 0.75), ("d", "R", "b", 9, 0.9)], "source string, relation string, target string, support_count long, confidence double")
    got = {"|".join(r.path): (r.support, r.confidence) for r in graph.expand_paths(spark.createDataFrame([(1, "a")], "qid int, entity string"), e, hops=2).collect()}
    assert got == {"a|R|b": (3, 0.6), "a|R|b|R|c": (2, 0.6)}
    q = spark.createDataFrame([(1, "what of arc"), (2, "acr"), (3, "zzz")], "qid int, query string")
    found = {r.qid: r.how for r in graph.locate_entities(q, LEX).collect()}
    assert found == {1: "surface"} or found[1] == "surface" and 3 not in found


def test_merge_triples(spark):
    schema = "head string, head_type string, relation string, tail string, tail_type string, doc_ids array<string>, evidence array<struct<sentence:string,unit_id:string,doc_id:string>>"
    one = spark.createDataFrame([("a", "x", "R", "b", "y", ["d1"], [("s", "u1", "d1")]), ("q", "x", "R", "b", "y", ["d1"], [])], schema)
    two = spark.createDataFrame([("a", "x", "R", "b", "y", ["d2", "d1"], [("s2", "u1", "d1"), ("s3", "u2", "d2")])], schema)
    bad = spark.createDataFrame([("q", "R", "b")], "head string, relation string, tail string")
    (r,) = graph.merge_triples({"rule": one, "llm": two}, rejected=bad).collect()
    assert (r.extractors, r.confidence, r.doc_ids, [e.unit_id for e in r.evidence]) == (["llm", "rule"], 0.75, ["d1", "d2"], ["u1", "u2"])


SCHEMA = {"t": {"required": ["q"], "properties": {"q": {"type": "string"}, "m": {"type": "string", "enum": ["a"]}, "n": {"type": "number"}, "l": {"type": "array", "items": {"type": "string"}}}}}


@pytest.mark.parametrize("args,code", [('{"q": "x", "m": "z"}', "invalid_enum"), ('{"q": "x", "zz": 1}', "unknown_field"), ('{"q": "x", "n": true}', "type_mismatch"), ("{}", "missing_required"), ('{"q": "x", "l": [1]}', "invalid_item_type"), ("nope", "invalid_json"), ('{"q": "x", "n": null}', None)])
def test_argument_errors(spark, args, code):
    rows = datasets.validate_arguments(spark.createDataFrame([("t", args), ("other", args)], "tool string, args string"), "tool", "args", SCHEMA).collect()
    got = {r.tool: [e.code for e in r.errors] for r in rows}
    assert got == {"t": [code] if code else [], "other": ["unknown_tool"]}


def test_leaks_equal_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdef ", k=rng.randint(3, 40))) for _ in range(30)]
    texts = base + [t[:-1] + "z" for t in base] + [t + "q" for t in base] + base[:3]
    def grams(t):
        t = "".join(t.lower().split())
        return set(t) if len(t) < 8 else {t[i : i + 2] for i in range(len(t) - 1)}
    a, b = list(enumerate(texts[::2])), list(enumerate(texts[1::2]))
    for thr in (0.9, 0.6):
        want = {(i, j) for i, x in a for j, y in b if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) > thr}
        got = datasets.near_duplicate_leaks(spark.createDataFrame(a, "train_id int, text string"), spark.createDataFrame(b, "test_id int, text string"), thr=thr).collect()
        assert {(r.train_id, r.test_id) for r in got} == want and len(got) == len(want)


def test_rewrite_guard(spark):
    rows = [("at 5 kV now", "now at 5 kV", None), ("at 5 kV now", "at 6 kV now", "lost_number"), ("a 5 b", "a 5 b", "duplicate"), ("a 5 b", "x" * 50, "length"), ("aa 5 bb", "aa 5 5 b", None), ("abc def", "abc 7 de", "added_number"), ("the arc is", "it is bad", "banned"), ("the arc is", "it was ok", "entity")]
    df = spark.createDataFrame(rows, "s string, r string, want string")
    assert all(r.reason == r.want for r in datasets.rewrite_guard(df, "s", "r", ["bad"], ["arc"]).collect())


def test_candidates_and_pairs(spark):
    schema = "seed_id string, candidate_id string, format_ok boolean, tools array<string>, gold_tools array<string>, schema_ok boolean, business_ok boolean, faith double, asks array<string>, gold_ask array<string>"
    rows = [("s", "gold", True, ["a", "b"], ["b", "a"], True, True, 1.0, [], []), ("s", "extra", True, ["a", "b", "c", "c"], ["b", "a"], True, True, 1.0, [], []), ("s", "bad", False, [], ["b", "a"], None, None, None, [], []), ("r", "x", True, [], [], None, None, None, ["which gas"], ["gas"]), ("r", "y", True, [], [], None, None, None, [], ["gas"])]
    scored = datasets.score_candidates(spark.createDataFrame(rows, schema))
    got = {r.candidate_id: (r.score_exec, r.score_full) for r in scored.collect()}
    assert got["gold"] == (1, 1) and got["bad"] == (0, 0) and got["extra"] == (0.75, round(5 / 6 - 0.2, 4)) and got["x"] == (1, 1)
    pairs = datasets.preference_pairs(scored, "seed_id").collect()
    assert [(p.seed_id, p.chosen, p.rejected) for p in pairs] == [("s", "gold", "bad")]


def test_parsing():
    assert datasets.parse_calls('```json\n{"steps": [{"tool": "t", "arguments": {"b": 1, "a": 2}}]}\n```') == [{"name": "t", "arguments": '{"a": 2, "b": 1}'}]
    assert datasets.parse_calls("<tool_call>{\"name\": \"f\", \"arguments\": {}}</tool_call>")[0]["name"] == "f" and datasets.parse_calls("free text") is None


def test_trajectories(spark):
    seeds = spark.createDataFrame([("s1", "q", "kg", "{}"), ("s2", "q2", "kg", "{2}")], "seed_id string, query string, tool string, arguments string")
    first = spark.createDataFrame([("kg", "{}", "ok", "e1", "c1"), ("kg", "{2}", "error", None, "boom")], "tool string, arguments string, status string, entity string, content string")
    step = "entity string, tool string, arguments string, status string, content string"
    got = datasets.compose_trajectories(seeds, first, spark.createDataFrame([("e1", "rag", "{r}", "no_relation", "none")], step), spark.createDataFrame([("e1", "rag", "{relaxed}", "ok", "found")], step))
    by = {s: [(r.role, r.content) for r in got.filter(F.col("seed_id") == s).orderBy("pos").collect()] for s in ("s1", "s2")}
    assert [r for r, _ in by["s1"]] == ["user", "assistant", "tool", "assistant", "tool", "assistant", "tool", "assistant"] and by["s1"][-1][1] == "finish"
    assert by["s2"][-1][1] == "give_up" and len(by["s2"]) == 4


def test_gold_as_prediction_is_perfect(spark):
    calls = [("f", '{"q": "gas in oil", "n": 3}'), ("g", '{"l": ["a", "b"]}')]
    schema = f"id int, gold {logs.CALLS}, pred {logs.CALLS}, gold_ask boolean, pred_ask boolean"
    rows = [(1, calls, calls, None, None), (2, [], [], True, True), (3, calls, calls[:1], None, None), (4, [], calls, None, None), (5, calls, None, None, None)]
    got = {r.id: r for r in logs.score_calls(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].complete and got[1].params == 1 and got[2].ask and got[2].complete is None and got[2].unnecessary is False
    assert not got[3].tool and got[3].params == 0.5 and got[4].unnecessary and got[5].format is False
    required = spark.createDataFrame([(1, 0, "f", '{"n": 3}')], "item_id int, pos int, tool string, arguments string")
    made = spark.createDataFrame([(1, 0, "f", '{"n": 4}'), (1, 1, "f", '{"n": 3}')], "item_id int, call_index int, tool string, arguments string")
    assert logs.match_required_calls(required, made).first().share == 1


def test_call_signatures(spark):
    df = spark.createDataFrame([("f", '{"b": "2", "a": "1", "query": "x", "z": null}'), ("f", '{"a": "1", "b": "2"}'), ("f", None)], "tool string, args string")
    got = [r.s for r in df.select(logs.call_signature(F.col("tool"), F.col("args"), {"f": {"c": "9"}}).alias("s")).collect()]
    assert got[0] == got[1] == "f:a=1&b=2&c=9" and got[2] == "f:c=9"


def test_claims(spark):
    catalog = spark.createDataFrame([("i", "call:0", "tool", '{"r": {"H2": 152.0}}'), ("i", "kb:1", "kb", "arc produces acetylene gas")], "item_id string, ref string, source string, content string")
    ev = "item_id string, id string, type string, evidence array<struct<source:string,ref:string,span:string>>"
    rows = [("i", "1", "observation", [("tool", "call:0", "x")]), ("i", "2", "nonsense", []), ("i", "3", "mechanism", [("kb", "call:0", ""), ("web", "x", "y")]), ("i", "4", "mechanism", [("kb", "kb:9", "y")])]
    got = {r.id: (r.errors, r.warnings) for r in claims.validate_claims(spark.createDataFrame(rows, ev), catalog).collect()}
    assert got == {"1": ([], []), "2": (["bad_type", "no_evidence"], []), "3": (["bad_ref", "bad_source", "empty_span"], ["x"]), "4": ([], ["kb:9"])}
    text = spark.createDataFrame([("i", "1", "H2=152"), ("i", "2", "H2=300"), ("i", "4", "看 ETTh1 与 ETTm2，建议停电"), ("i", "5", "无需处理")], "item_id string, id string, text string")
    scope = {r.id: r.outside for r in claims.check_scope(text, spark.createDataFrame([("i", "etth1")], "item_id string, scope string"), claims.DATASET).collect()}
    assert scope["4"] == ["ettm2"] and scope["1"] == []
    safe = {r.id: r.reason for r in claims.check_safety(text, spark.createDataFrame([("i", False, True)], "item_id string, measured boolean, high_risk boolean")).collect()}
    assert safe["4"] == "unsupported_action" and safe["5"] == "dismisses_risk" and safe["1"] is None
    checks = spark.createDataFrame([("p", "1", "mechanism", [], True), ("q", "1", "mechanism", ["DATA"], True), ("a", "1", "observation", ["EVIDENCE"], True)], "item_id string, id string, type string, violated array<string>, supported boolean")
    items = spark.createDataFrame([("p", 1), ("q", 1), ("a", 3), ("none", 1)], "item_id string, iteration int")
    assert {r.item_id: r.verdict for r in claims.claim_verdict(checks, items).collect()} == {"p": "PASS", "q": "REVISION", "a": "ABSTAIN", "none": "REVISION"}
    hint = claims.missing_evidence_tool(spark.createDataFrame([("乙炔 5 ppm", "observation"), ("油温预测", "forecast"), ("do it", "safety"), ("x", "diagnosis")], "text string, type string")).collect()
    assert [r.suggested_tool for r in hint] == ["fault_attribution", "ett_forecast", "rag_search", None]


def test_injection_and_pick(spark):
    df = spark.createDataFrame([("i", "1", "H2 is 100 on A", "call:0", "s")], "item_id string, id string, text string, ref string, span string")
    got = {r.subtype: r for r in datasets.inject_errors(df, scopes={"A": "B"}).collect()}
    assert set(got) == {"number", "fake_ref", "span", "scope", "contradiction"} and got["scope"].text.endswith("B")
    many = spark.createDataFrame([(f"i{k}", s) for k in range(6) for s in ("x", "y")], "item_id string, subtype string")
    assert {r["subtype"]: r["count"] for r in datasets.balanced_pick(many, 6).groupBy("subtype").count().collect()} == {"x": 3, "y": 3}


def test_stream(spark, tmp_path):
    from wattlore.streaming import anomalies

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 10.0), (2, None)], "k int, H2 double").write.parquet(src)
    stream = spark.readStream.schema("k int, H2 double").parquet(src)
    q = anomalies.score_stream(stream, lambda d: records.derive_evidence(d, {"H2": 5.0}, None, None), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.k: r.H2_elevated for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: None}
    assert math.isfinite(1.0)


def test_permutation_query_makes_all_permutations(spark, tmp_path):
    from wattlore.plans import queries

    spark.createDataFrame([(i, 51.0 + i) for i in range(40)], "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    row = queries.QUERIES["permutation_test"](spark, str(tmp_path)).first()
    assert row.n == 40 and row.mean_diff == pytest.approx(20.5) and row.p == pytest.approx(1 / 20001)


def test_leaking_texts_equal_all_pairs_of_whole_turns(spark, tmp_path):
    from wattlore.functions import determinism
    from wattlore.plans import queries

    rng = random.Random(9)
    fresh = lambda n: "".join(rng.choices("abcdefghijklmno ", k=n))
    same, opening = fresh(300), fresh(60)
    rows = [(c, 0, "user", same if c % 3 == 0 else opening + fresh(240)) for c in range(24)]
    rows += [(c, 1, "assistant", fresh(5) + same[5:] if c % 4 == 0 else fresh(80)) for c in range(24)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    side = {r.conv_id: r.split for r in determinism.split_by_group(df, "conv_id", [("train", 0.8), ("test", 0.2)], "leaks").collect()}

    def grams(t):
        t = "".join(t.lower().split())
        return {t[i : i + 2] for i in range(len(t) - 1)}

    want = {}
    for a in rows:
        for b in rows:
            x, y = grams(a[3]), grams(b[3])
            if side[a[0]] == "train" and side[b[0]] == "test" and len(x & y) / len(x | y) > 0.9:
                want[a[0], a[1], b[0], b[1]] = len(x & y) / len(x | y)
    got = {(r.train_conv_id, r.train_turn, r.test_conv_id, r.test_turn): r.jaccard for r in queries.QUERIES["leaking_texts"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert any((a - c) % 2 == 0 for a, _, c, _ in want) and any(t == 1 for _, t, _, _ in want)

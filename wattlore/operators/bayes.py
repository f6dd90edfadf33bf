"""Rule-fused naive Bayes over three-valued evidence: score, calibrate, learn, validate, recommend the next question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.determinism import hash_number
from . import fusion

Params = Mapping[str, Mapping]  # prior {class: p}, cpt {class: {symptom: p_true}}, weights {class: w}


def _norm(df: DataFrame, classes: Sequence[str], prefix: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"{prefix}{c}") for c in classes])
    return df.withColumn("_z", total).withColumns({f"{prefix}{c}": F.when(F.col("_z") > 0, F.col(f"{prefix}{c}") / F.col("_z")).otherwise(1.0 / len(classes)) for c in classes}).drop("_z")


def naive_bayes_posterior(df: DataFrame, prior: Mapping[str, float], cpt: Mapping[str, Mapping[str, float]], symptoms: Sequence[str], use_negative: bool = True, missing: float = 0.05) -> DataFrame:
    """Add p_<class>: prior times p for true and 1 - p for false symptoms; null ones are skipped. Constants of the stated
    parameter tables become one expression for each class, so scoring is one narrow pass."""
    out = {}
    for c, p0 in prior.items():
        log = F.lit(float(np.log(max(p0, 1e-300))))
        for s in symptoms:
            p = min(max(cpt.get(c, {}).get(s, missing), 1e-6), 1 - 1e-6)
            log = log + F.when(F.col(s), float(np.log(p))).when(~F.col(s), float(np.log(1 - p)) if use_negative else 0.0).otherwise(0.0)
        out[f"_l_{c}"] = log
    rows = df.withColumns(out).withColumn("_m", F.greatest(*out) if len(out) > 1 else F.col(next(iter(out))))
    rows = rows.withColumns({f"p_{c}": F.exp(F.col(f"_l_{c}") - F.col("_m")) for c in prior}).drop(*out, "_m")
    return _norm(rows, list(prior), "p_")


def fuse_rules(df: DataFrame, classes: Sequence[str], weights: Mapping[str, float] = {}, default: float = 0.7) -> DataFrame:
    """Where a class has a boost above 0: w * p + (1 - w) * boost; then all classes again sum to 1. Weights are cut to [0, 1]."""
    w = {c: min(max(weights.get(c, default), 0.0), 1.0) for c in classes}
    rows = df.withColumns({f"p_{c}": F.when(F.col(f"boost_{c}") > 0, w[c] * F.col(f"p_{c}") + (1 - w[c]) * F.col(f"boost_{c}")).otherwise(F.col(f"p_{c}")) for c in classes if f"boost_{c}" in df.columns})
    return _norm(rows, classes, "p_")


def temperature_scale(df: DataFrame, classes: Sequence[str], t: float) -> DataFrame:
    return _norm(df.withColumns({f"p_{c}": F.pow(F.greatest(F.col(f"p_{c}"), F.lit(1e-12)), F.lit(1.0 / t)) for c in classes}), classes, "p_")


def uncertainty(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add entropy (bits), top1, top1_prob, gap to the second; ties in order of the classes."""
    ps = F.array(*[F.struct((-F.col(f"p_{c}")).alias("np"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    bits = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{c}") > 0, -F.col(f"p_{c}") * F.log2(f"p_{c}")).otherwise(0.0) for c in classes])
    rows = df.withColumns({"_s": F.array_sort(ps), "entropy": bits})
    second = -F.col("_s")[1]["np"] if len(classes) > 1 else F.lit(0.0)
    return rows.withColumns({"top1": F.col("_s")[0]["c"], "top1_prob": -F.col("_s")[0]["np"], "gap": -F.col("_s")[0]["np"] - second}).drop("_s")


def rank_classes(df: DataFrame, classes: Sequence[str], id_col: str, bands: tuple[float, float] = (0.5, 0.2)) -> DataFrame:
    """id, class, p, rank, band (high, medium, low)."""
    ps = F.array_sort(F.array(*[F.struct((-F.col(f"p_{c}")).alias("np"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))
    rows = df.select(id_col, F.posexplode(ps).alias("k", "x"))
    p = -F.col("x.np")
    return rows.select(id_col, F.col("x.c").alias("class"), p.alias("p"), (F.col("k") + 1).alias("rank"), F.when(p >= bands[0], "high").when(p >= bands[1], "medium").otherwise("low").alias("band"))


def evidence_counts(df: DataFrame, label: str, symptoms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, label, n, pos_<symptom>: one aggregation that learning and cross-validation subtract from."""
    return df.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(s), F.lit(False))).alias(f"pos_{s}") for s in symptoms])


def params_from_counts(counts: pd.DataFrame, classes: Sequence[str], symptoms: Sequence[str], alpha: float = 1.0, shrink: float = 0.5, expert: Mapping[str, Mapping[str, float]] | None = None) -> dict:
    """prior, cpt (p_true), p_false. Priors divide by all rows, those of other labels too. A symptom that is never seen keeps
    0.5 + shrink * (expert - 0.5) where there is an expert value, else 0.5."""
    table = counts.groupby("label").sum(numeric_only=True)
    total = table.sum()
    n = float(total["n"])
    prior, cpt, p_false = {}, {}, {}
    for c in classes:
        row = table.loc[c] if c in table.index else total * 0
        prior[c] = round((row["n"] + alpha) / (n + alpha * len(classes)), 5)
        cpt[c], p_false[c] = {}, {}
        for s in symptoms:
            if total[f"pos_{s}"] == 0:
                e = (expert or {}).get(c, {}).get(s)
                cpt[c][s] = round(0.5 + shrink * (e - 0.5), 5) if e is not None else 0.5
                p_false[c][s] = 0.5
            else:
                cpt[c][s] = round((row[f"pos_{s}"] + alpha) / (row["n"] + 2 * alpha), 5)
                p_false[c][s] = round((total[f"pos_{s}"] - row[f"pos_{s}"] + alpha) / (n - row["n"] + 2 * alpha), 5)
    return {"prior": prior, "cpt": cpt, "p_false": p_false}


def learn_params(df: DataFrame, label: str, classes: Sequence[str], symptoms: Sequence[str], alpha: float = 1.0, shrink: float = 0.5, expert=None) -> dict:
    """Learned parameters from one aggregation (a row for each label)."""
    return params_from_counts(evidence_counts(df, label, symptoms).toPandas(), classes, symptoms, alpha, shrink, expert)


def learned_table(df: DataFrame, label: str, symptoms: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """class, symptom, n, pos, p_true, p_false as a table, in Spark alone (any number of classes)."""
    counts = evidence_counts(df, label, symptoms)
    long = counts.select(F.col("label").alias("class"), "n", F.explode(F.array(*[F.struct(F.lit(s).alias("symptom"), F.col(f"pos_{s}").alias("pos")) for s in symptoms])).alias("x")).select("class", "n", "x.symptom", "x.pos")
    every = Window.partitionBy("symptom")
    return long.withColumns({"_n": F.sum("n").over(every), "_p": F.sum("pos").over(every)}).select(
        "class", "symptom", "n", "pos", F.when(F.col("_p") == 0, 0.5).otherwise(F.round((F.col("pos") + alpha) / (F.col("n") + 2 * alpha), 5)).alias("p_true"),
        F.when(F.col("_p") == 0, 0.5).otherwise(F.round((F.col("_p") - F.col("pos") + alpha) / (F.col("_n") - F.col("n") + 2 * alpha), 5)).alias("p_false"),
    )


def patterns(df: DataFrame, label: str, symptoms: Sequence[str], classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of distinct (evidence, boost, label): all that fitting and metrics need of the rows."""
    boosts = [f"boost_{c}" for c in classes if f"boost_{c}" in df.columns]
    return df.groupBy(*by, *symptoms, *boosts, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


class PatternModel:
    """numpy posterior over a pattern table."""

    def __init__(self, table: pd.DataFrame, classes: Sequence[str], symptoms: Sequence[str], prior, cpt, use_negative: bool = True):
        self.classes = list(classes)
        e = np.stack([np.where(pd.isna(table[s]), np.nan, table[s].astype("float64")) for s in symptoms], 1) if len(table) else np.zeros((0, len(symptoms)))
        p = np.clip(np.array([[cpt.get(c, {}).get(s, 0.05) for s in symptoms] for c in classes]), 1e-6, 1 - 1e-6)
        log = np.log(np.array([prior[c] for c in classes]))[None] + (np.nan_to_num(e) @ np.log(p).T)
        if use_negative:
            log = log + np.nan_to_num(1 - e) @ np.log(1 - p).T
        self.bayes = np.exp(log - log.max(1, keepdims=True)) if len(table) else np.zeros((0, len(classes)))
        self.bayes /= np.maximum(self.bayes.sum(1, keepdims=True), 1e-300)
        self.boost = np.stack([table[f"boost_{c}"].to_numpy("float64") if f"boost_{c}" in table else np.zeros(len(table)) for c in classes], 1)
        self.n = table["n"].to_numpy("float64")
        self.y = np.array([self.classes.index(x) if x in self.classes else -1 for x in table["label"]])

    def probs(self, w: np.ndarray, t: float = 1.0) -> np.ndarray:
        p = np.where(self.boost > 0, w * self.bayes + (1 - w) * self.boost, self.bayes)
        p = np.maximum(p / p.sum(1, keepdims=True), 1e-12) ** (1 / t)
        return p / p.sum(1, keepdims=True)

    def nll(self, w: np.ndarray, t: float = 1.0, part: np.ndarray | None = None) -> float:
        some = (self.y >= 0) & (True if part is None else part)
        p = self.probs(w, t)[some, self.y[some]]
        return float(-(self.n[some] * np.log(np.maximum(p, 1e-12))).sum() / max(self.n[some].sum(), 1e-12))


def cross_validate(df: DataFrame, label: str, classes: Sequence[str], symptoms: Sequence[str], fold: str = "fold", half: str = "half", alpha: float = 1.0) -> DataFrame:
    """fusion.cross_validate of rows: one aggregation of patterns by fold and half holds all that learning, fitting and evaluating need."""
    return fusion.cross_validate(patterns(df, label, symptoms, classes, [fold, half]), classes, symptoms, fold, half, alpha)


def calibration_metrics(df: DataFrame, classes: Sequence[str], label: str, bins: int = 15) -> tuple[DataFrame, DataFrame]:
    """(n, top1, top3, nll, brier, ece; bin, n, confidence, accuracy). Bins are min(int(confidence * bins), bins - 1)."""
    y = lambda c: (F.col(label) == c).cast("double")
    own = reduce(lambda a, c: F.when(F.col(label) == c, F.col(f"p_{c}")).otherwise(a), classes, F.lit(0.0))
    better = reduce(lambda a, b: a + b, [F.when((F.col(f"p_{c}") > own) | ((F.col(f"p_{c}") == own) & (F.lit(i) < reduce(lambda a, jc: F.when(F.col(label) == jc[1], jc[0]).otherwise(a), enumerate(classes), F.lit(0)))), 1).otherwise(0) for i, c in enumerate(classes)])
    brier = reduce(lambda a, b: a + b, [F.pow(F.col(f"p_{c}") - y(c), F.lit(2)) for c in classes])
    rows = df.select((better < 1).cast("double").alias("t1"), (better < 3).cast("double").alias("t3"), (-F.log(F.greatest(own, F.lit(1e-12)))).alias("nll"), brier.alias("brier"), F.greatest(*[f"p_{c}" for c in classes]).alias("conf"))
    rel = rows.groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence"), F.avg("t1").alias("accuracy"), F.sum("t3").alias("_t3"), F.sum("nll").alias("_nll"), F.sum("brier").alias("_b"))
    total = F.sum("n")
    summary = rel.agg(total.alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / total).alias("top1"), (F.sum("_t3") / total).alias("top3"), (F.sum("_nll") / total).alias("nll"), (F.sum("_b") / total).alias("brier"), (F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / total).alias("ece"))
    return summary, rel.drop("_t3", "_nll", "_b")


def holdout_eval(df: DataFrame, label: str, classes: Sequence[str], symptoms: Sequence[str], expert_prior: Mapping[str, float], expert_cpt: Mapping[str, Mapping[str, float]], id_col: str, ratio: float = 0.3, seed: str | int = 0) -> DataFrame:
    """params (expert or learned) and calibration metrics on the held-out share; parameters are learned from the rest.

    The share is held out by a hash threshold, which needs no global sort and keeps a row's side when rows are added.
    """
    out = hash_number(seed, id_col) < int(ratio * (1 << 32))
    learned = learn_params(df.filter(~out), label, classes, symptoms, expert=expert_cpt)
    rows = []
    for name, prior, cpt in (("expert", expert_prior, expert_cpt), ("learned", learned["prior"], learned["cpt"])):
        scored = naive_bayes_posterior(df.filter(out), prior, cpt, symptoms)
        rows.append(calibration_metrics(scored, classes, label)[0].withColumn("params", F.lit(name)))
    return rows[0].unionByName(rows[1])


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """class, support, tp, precision, recall, f1 for each class, MACRO and WEIGHTED rows."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.select(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    rows = rows.unionByName(pairs.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")))
    by = rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    by = by.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    by = by.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    names = ("precision", "recall", "f1")
    sums = [F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    macro = by.filter("support > 0").agg(F.lit("MACRO").alias("class"), *sums, *[F.avg(c).alias(c) for c in names])
    weighted = by.agg(F.lit("WEIGHTED").alias("class"), *sums, *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names])
    return by.unionByName(macro).unionByName(weighted)


def recall_by(df: DataFrame, label: str, pred: str, group: str, confidence: str) -> DataFrame:
    """group, n, recall, mean confidence where right and where wrong."""
    right = F.col(label) == F.col(pred)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("recall"), F.avg(F.when(right, F.col(confidence))).alias("conf_right"), F.avg(F.when(~right, F.col(confidence))).alias("conf_wrong"))


def entropy_bits(p: np.ndarray) -> np.ndarray:
    return -(np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0)).sum(-1)


def information_gain(df: DataFrame, id_col: str, classes: Sequence[str], symptoms: Sequence[str], prior, cpt, weights: Mapping[str, float] = {}, basis: str = "fused") -> DataFrame:
    """id, symptom, p_true, entropy, eig of every unobserved symptom. Evaluated once for each distinct pattern in Spark
    tasks, then joined back to the rows."""
    boosts = [f"boost_{c}" for c in classes if f"boost_{c}" in df.columns]
    key = F.xxhash64(*symptoms, *boosts).alias("_pattern")
    rows = df.select(id_col, key, *symptoms, *boosts)
    distinct = rows.drop(id_col).dropDuplicates(["_pattern"])
    w = np.array([weights.get(c, 0.7) for c in classes])

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            base = pdf.assign(n=1, label="")
            out = []
            value = lambda t: (m := PatternModel(t, classes, symptoms, prior, cpt)).probs(w) if basis == "fused" else m.bayes

            def dist(t):
                m = PatternModel(t, classes, symptoms, prior, cpt)
                return m.probs(w) if basis == "fused" else m.bayes

            now = dist(base)
            h = entropy_bits(now)
            for s in symptoms:
                open_ = pd.isna(pdf[s]).to_numpy()
                if not open_.any():
                    continue
                part = base[open_]
                p = np.clip(now[open_] @ np.array([cpt.get(c, {}).get(s, 0.05) for c in classes]), 1e-9, 1 - 1e-9)
                after = [entropy_bits(dist(part.assign(**{s: v}))) for v in (True, False)]
                gain = h[open_] - (p * after[0] + (1 - p) * after[1])
                out.append(pd.DataFrame({"_pattern": part["_pattern"], "symptom": s, "p_true": p, "entropy": h[open_], "eig": gain if basis == "bayes" else np.maximum(gain, 0)}))
            if out:
                yield pd.concat(out)

    gains = distinct.mapInPandas(run, "_pattern long, symptom string, p_true double, entropy double, eig double")
    return rows.select(id_col, "_pattern").join(gains, "_pattern").drop("_pattern")


def recommend(eig: DataFrame, id_col: str, costs: DataFrame, lam: float = 0.05, tau: float = 0.8, eps: float = 0.02, max_rounds: int = 3, top_k: int = 5, asked: str | None = None) -> DataFrame:
    """id, rank, symptom, voi, eig, cost, action of the best next questions.

    voi = eig - lam * cost, five places; order -voi, cost, name. Stop rules in order: entropy below tau, voi below eps, rounds
    used up: the action is then conclude; otherwise call_tool for a cost of 0, else ask. costs: symptom, cost.
    """
    rows = eig.join(costs, "symptom", "left").withColumn("cost", F.coalesce("cost", F.lit(1.0)))
    rows = rows.withColumn("voi", F.round(F.col("eig") - lam * F.col("cost"), 5))
    w = Window.partitionBy(id_col).orderBy(F.desc("voi"), "cost", "symptom")
    best = F.max("voi").over(Window.partitionBy(id_col))
    stop = F.when(F.col("entropy") < tau, "entropy").when(best < eps, "voi").when((F.col(asked) if asked else F.lit(0)) >= max_rounds, "rounds")
    rows = rows.withColumns({"rank": F.row_number().over(w), "stop": stop}).filter(F.col("rank") <= top_k)
    return rows.withColumn("action", F.when(F.col("stop").isNotNull(), "conclude").when(F.col("cost") == 0, "call_tool").otherwise("ask"))


def recommendation_hit_rate(recs: DataFrame, expected: DataFrame, id_col: str) -> DataFrame:
    """n, top1, top3: share of records whose first, or first three, recommendations meet the expected set."""
    top = recs.groupBy(id_col).agg(F.collect_list(F.when(F.col("rank") == 1, F.col("symptom"))).alias("one"), F.collect_list(F.when(F.col("rank") <= 3, F.col("symptom"))).alias("three"))
    hit = lambda c: F.avg(F.coalesce(F.arrays_overlap(c, "expected"), F.lit(False)).cast("double"))
    return expected.join(top, id_col, "left").agg(F.count(F.lit(1)).alias("n"), hit("one").alias("top1"), hit("three").alias("top3"))

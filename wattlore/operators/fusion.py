"""Fitting of fusion weights and temperatures as jobs: patterns of evidence meet a grid of values, likelihoods are one aggregation a round.

A pattern is a distinct combination of evidence, boosts and label with its count (bayes.patterns). Parameters, weights and results are
small tables with a row for each group (a fold, say), and several groups are fitted in the same jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.steps import dropped, written

GRID = tuple(i / 10 for i in range(11))
TEMPERATURES = tuple(0.5 + i / 20 for i in range(41))


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _log_tables(prior: Sequence[Column], p_true: Sequence[Sequence[Column]]) -> list[Column]:
    cut = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return [
        F.array(*map(F.log, prior)).alias("log_prior"), F.array(*(F.array(*(F.log(cut(p)) for p in row)) for row in p_true)).alias("log_true"),
        F.array(*(F.array(*(F.log(1 - cut(p)) for p in row)) for row in p_true)).alias("log_false"),
    ]


def stated_params(prior: Mapping[str, float], cpt: Mapping[str, Mapping[str, float]], classes: Sequence[str], symptoms: Sequence[str], missing: float = 0.05) -> list[Column]:
    """log_prior, log_true, log_false of a stated parameter set, as constants."""
    return _log_tables([F.lit(float(prior[c])) for c in classes], [[F.lit(float(cpt.get(c, {}).get(s, missing))) for s in symptoms] for c in classes])


def held_out_params(table: DataFrame, fold: str, classes: Sequence[str], symptoms: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """fold, log_prior, log_true, log_false: for each fold the parameters learned from the patterns of all others.

    Priors divide by all rows, those of other labels too; a symptom that is never seen has 0.5.
    """
    folds = table.agg(F.array_sort(F.collect_set(fold)).alias("_folds"))  # one row, an element for each fold
    rows = table.crossJoin(F.broadcast(folds)).withColumn("_out", F.explode(F.filter("_folds", lambda f: f != F.col(fold))))
    count = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0)).cast("double")
    seen = lambda s: F.coalesce(F.col(s), F.lit(False))
    sums = [F.sum("n").cast("double").alias("_n"), *(count(F.col("label") == c).alias(f"_n_{i}") for i, c in enumerate(classes)), *(count(seen(s)).alias(f"_s_{j}") for j, s in enumerate(symptoms))]
    sums += [count((F.col("label") == c) & seen(s)).alias(f"_c_{i}_{j}") for i, c in enumerate(classes) for j, s in enumerate(symptoms)]
    got = rows.groupBy(F.col("_out").alias(fold)).agg(*sums)
    prior = [F.round((F.col(f"_n_{i}") + alpha) / (F.col("_n") + alpha * len(classes)), 5) for i in range(len(classes))]
    p_true = [[F.when(F.col(f"_s_{j}") == 0, 0.5).otherwise(F.round((F.col(f"_c_{i}_{j}") + alpha) / (F.col(f"_n_{i}") + 2 * alpha), 5)) for j in range(len(symptoms))] for i in range(len(classes))]
    return got.select(fold, *_log_tables(prior, p_true))


def score_patterns(table: DataFrame, classes: Sequence[str], symptoms: Sequence[str], use_negative: bool = True) -> DataFrame:
    """Add bayes and boost (arrays in the order of classes) and y (the label's place, null for other labels) to patterns that have log_prior, log_true and log_false."""
    def log(i: int) -> Column:
        parts = [F.when(F.col(s), F.col("log_true")[i][j]).when(~F.col(s), F.col("log_false")[i][j] if use_negative else 0.0).otherwise(0.0) for j, s in enumerate(symptoms)]
        return F.col("log_prior")[i] + _total(parts)

    rows = table.withColumn("_log", F.array(*(log(i) for i in range(len(classes)))))
    rows = rows.withColumn("_p", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    bayes = F.transform("_p", lambda x: x / F.greatest(F.aggregate("_p", F.lit(0.0), lambda a, b: a + b), F.lit(1e-300)))
    boost = F.array(*(F.coalesce(F.col(f"boost_{c}").cast("double"), F.lit(0.0)) if f"boost_{c}" in table.columns else F.lit(0.0) for c in classes))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("label"))
    return rows.withColumns({"bayes": bayes, "boost": boost, "y": F.when(place > 0, place.cast("int") - 1)}).drop("_log", "_p", "log_prior", "log_true", "log_false")


def loss(weights: Column, temperature: Column) -> Column:
    """Mean negative log likelihood of scored patterns, as an aggregate; rows of other labels don't count."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    mixed = F.transform(F.col("bayes"), lambda p, i: F.when(F.col("boost")[i] > 0, weights[i] * p + (1 - weights[i]) * F.col("boost")[i]).otherwise(p))
    warm = lambda ps: F.transform(ps, lambda p: F.pow(F.greatest(p / add(ps), F.lit(1e-12)), 1 / temperature))
    own = warm(mixed)[F.col("y")] / add(warm(mixed))
    known = F.col("y").isNotNull()
    total = F.sum(F.when(known, -F.col("n") * F.log(F.greatest(own, F.lit(1e-12)))).otherwise(0.0))
    return total / F.greatest(F.sum(F.when(known, F.col("n")).otherwise(0)).cast("double"), F.lit(1e-12))


def sweep(scored: DataFrame, by: Sequence[str], weights: Column, place: int, grid: Sequence[float] = GRID) -> DataFrame:
    """by, value, nll: the loss for every value of one class's weight, the others as they are. One aggregation."""
    trial = scored.withColumn("value", F.explode(F.array(*map(F.lit, grid))))
    changed = F.transform(weights, lambda w, i: F.when(i == place, F.col("value")).otherwise(w))
    return trial.withColumn("_w", changed).groupBy(*by, "value").agg(loss(F.col("_w"), F.lit(1.0)).alias("nll"))


def fit_fusion_weights(scored: DataFrame, by: Sequence[str], n_classes: int, grid: Sequence[float] = GRID, passes: int = 2, start: float = 0.7) -> DataFrame:
    """by, weights, best: coordinate descent over the classes' weights, for every group at once.

    A value is taken if it is better than the best so far by more than 1e-9, in the order of the grid. Each coordinate is
    one job over the patterns; what goes on is a row for each group.
    """
    first = F.array(*[F.lit(float(start))] * n_classes)
    state = written(scored.groupBy(*by).agg(loss(first, F.lit(1.0)).alias("best")).withColumn("weights", first))
    for _ in range(passes):
        for i in range(n_classes):
            tried = sweep(scored.join(state, list(by)), by, F.col("weights"), i, grid)
            listed = tried.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("value", "nll"))).alias("tried"))
            found = state.join(listed, list(by))
            begin = F.struct(F.col("weights")[i].alias("value"), F.col("best").alias("nll"))
            taken = F.aggregate("tried", begin, lambda acc, x: F.when(x["nll"] < acc["nll"] - 1e-9, F.struct(x["value"].alias("value"), x["nll"].alias("nll"))).otherwise(acc))
            found = found.withColumn("_t", taken)
            new = written(found.select(*by, F.col("_t.nll").alias("best"), F.expr(f"transform(weights, (w, j) -> if(j = {i}, _t.value, w))").alias("weights")))
            dropped(state)
            state = new
    return state


def fit_temperature(scored: DataFrame, by: Sequence[str], grid: Sequence[float] = TEMPERATURES) -> DataFrame:
    """by, t: the temperature with the least loss (ties: the lowest) of scored patterns with weights. One aggregation."""
    tried = scored.withColumn("t", F.explode(F.array(*map(F.lit, grid)))).groupBy(*by, "t").agg(loss(F.col("weights"), F.col("t")).alias("nll"))
    return tried.groupBy(*by).agg(F.min_by("t", F.struct(F.round("nll", 12).alias("nll"), "t")).alias("t"))


def cross_validate(table: DataFrame, classes: Sequence[str], symptoms: Sequence[str], fold: str = "fold", half: str = "half", alpha: float = 1.0) -> DataFrame:
    """fold, nll_default, nll_weights, nll_both, t: losses on half 1 of each fold, of the weight 0.7, of weights fitted on half 0, of these with a fitted temperature.

    table: bayes.patterns by fold and half. Parameters of a fold are learned from all others. All folds go through the same jobs. A
    fold without rows in one of its halves has no row.
    """
    table = written(table)
    scored = score_patterns(table.join(held_out_params(table, fold, classes, symptoms, alpha), fold), classes, symptoms)
    scored = written(scored.select(fold, half, "n", "bayes", "boost", "y"))
    fit, test = scored.filter(F.col(half) == 0), scored.filter(F.col(half) == 1)
    weights = fit_fusion_weights(fit, [fold], len(classes)).select(fold, "weights")
    heat = fit_temperature(fit.join(weights, fold), [fold])
    plain = F.array(*[F.lit(0.7)] * len(classes))
    both = test.join(weights, fold).join(heat, fold)
    return both.groupBy(fold).agg(
        loss(plain, F.lit(1.0)).alias("nll_default"), loss(F.col("weights"), F.lit(1.0)).alias("nll_weights"), loss(F.col("weights"), F.col("t")).alias("nll_both"), F.first("t").alias("t"),
    )

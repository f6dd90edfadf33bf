"""Measurement records: normalise, merge, deduplicate, label, derive evidence, ratio codes and rules, masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.determinism import hash_key, proportional_sample
from ..functions.steps import written

GASES = ("H2", "CH4", "C2H2", "C2H4", "C2H6")
#: Attention limits of single gases, of total hydrocarbons, and of a rapid rise.
ATTENTION = {"H2": 150.0, "CH4": 120.0, "C2H2": 5.0, "C2H4": 50.0, "C2H6": 65.0}
TOTAL_ATTENTION, RAPID_C2H2 = 150.0, 50.0
HYDROCARBONS = ("CH4", "C2H2", "C2H4", "C2H6")
#: Codes (C2H2/C2H4, CH4/H2, C2H4/C2H6) of each rule, the faults it speaks for, its weight.
RATIO_RULES = (
    ("thermal below 150", (0,), (0,), (1,), ("insulation_degradation",), 0.72),
    ("thermal 150 to 300", (0,), (2,), (0,), ("core_grounding", "insulation_degradation"), 0.76),
    ("thermal 300 to 700", (0,), (2,), (1,), ("core_grounding", "winding_deformation"), 0.82),
    ("thermal above 700", (0,), (0, 1, 2), (2,), ("overload_overheating", "core_grounding"), 0.86),
    ("partial discharge", (0,), (1,), (0,), ("partial_discharge",), 0.84),
    ("low energy discharge", (1,), (0, 1), (0, 1, 2), ("partial_discharge", "bushing_fault"), 0.9),
    ("low energy discharge, thermal", (1,), (2,), (0, 1, 2), ("partial_discharge", "overload_overheating"), 0.88),
    ("arc discharge", (2,), (0, 1), (0, 1, 2), ("winding_short_circuit", "bushing_fault", "olc_fault"), 0.93),
    ("arc discharge, thermal", (2,), (2,), (0, 1, 2), ("winding_short_circuit", "olc_fault", "overload_overheating"), 0.92),
)


def normalize_source(df: DataFrame, rename: Mapping[str, str], measures: Sequence[str], label: str) -> DataFrame:
    """Rename, trim and upper-case the label, numbers from text (else null), rows with a null measure go."""
    for old, new in rename.items():
        df = df.withColumnRenamed(old, new)
    return df.withColumns({m: F.col(m).cast("string").try_cast("double") for m in measures} | {label: F.upper(F.trim(F.col(label)))}).dropna(subset=list(measures))


def merge_sources(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of the sources that are there, with their name and priority (their order)."""
    rows = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)}) for i, (name, df) in enumerate(sources.items()) if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def dedup_rounded(df: DataFrame, cols: Sequence[str], label: str, order: Sequence[str], digits: int = 3) -> DataFrame:
    """One row for each label and set of rounded measures: the first by ``order``. A hot key keeps one struct while it aggregates."""
    keys = [F.round(F.col(c), digits).alias(f"_k{i}") for i, c in enumerate(cols)]
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.select("*", *keys).groupBy(F.col(label).alias("_label"), *[f"_k{i}" for i in range(len(cols))]).agg(first.alias("r")).select("r.*")


def map_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with ``fault``, skipped labels with counts). mapping: label, fault — a small stated table."""
    m = mapping.select(F.col("label").alias(label), "fault")
    return df.join(m, label), df.join(m, label, "left_anti").groupBy(label).count()


def derive_totals(df: DataFrame, totals: Mapping[str, Sequence[str]] = {"total_hydrocarbon": HYDROCARBONS, "tdcg": ("H2", *HYDROCARBONS)}, digits: int = 3) -> DataFrame:
    """Sums of columns, null where any part is."""
    return df.withColumns({n: F.round(reduce(lambda a, b: a + b, [F.col(c) for c in cols]), digits) for n, cols in totals.items()})


def derive_evidence(df: DataFrame, limits: Mapping[str, float] = ATTENTION, total: tuple[Sequence[str], float] | None = (HYDROCARBONS, TOTAL_ATTENTION), rapid: tuple[str, float] | None = ("C2H2", RAPID_C2H2), negative: bool = True) -> DataFrame:
    """Three-valued symptoms: true above the limit; otherwise false, or null unless ``negative``; null measures give null."""
    flag = lambda c, t: F.when(c > t, True).when(c.isNotNull(), F.lit(False) if negative else F.lit(None).cast("boolean"))
    out = {f"{g}_elevated": flag(F.col(g), t) for g, t in limits.items()}
    if total:
        out["TDCG_elevated"] = flag(reduce(lambda a, b: a + b, [F.col(c) for c in total[0]]), total[1])
    if rapid:
        out["gas_rate_rapid"] = flag(F.col(rapid[0]), rapid[1])
    return df.withColumns(out)


def severity(df: DataFrame, label: str = "fault") -> DataFrame:
    th = reduce(lambda a, b: a + b, [F.col(c) for c in HYDROCARBONS])
    value = F.when(F.col(label) == "normal", "normal").when(F.col(label) == "winding_short_circuit", F.when(F.col("C2H2") > 50, "critical").otherwise("serious")).when((F.col("C2H2") > 50) | (th > 1500), "serious").otherwise("attention")
    return df.withColumn("severity", value)


def assign_ids(df: DataFrame, order: Sequence[str], n_devices: int = 50, prefix: str = "R") -> DataFrame:
    """record_id and device_id from the place in a total order. Rows are dealt by ranges of it and written once, then numbered
    range by range, so no task sorts all rows and a lost executor changes no number."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = rows.join(F.broadcast(base), "_p").withColumn("_i", F.col("_base") + nth - 1)  # one row for each partition
    return out.withColumns({"record_id": F.format_string(prefix + "%06d", "_i"), "device_id": F.format_string("D%02d", F.pmod("_i", F.lit(n_devices)))}).drop("_p", "_base", "_i")


def ratio_codes(df: DataFrame, gases: Sequence[str] = GASES, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Add r1..r3 and code1..code3 of the three ratios (C2H2/C2H4, CH4/H2, C2H4/C2H6). A zero denominator codes 1; a ratio
    given in an override column is taken as it is."""
    h2, ch4, c2h2, c2h4, c2h6 = (F.col(g) for g in gases)
    ratio = lambda a, b, k: F.coalesce(F.col(overrides[k]), F.try_divide(a, b)) if overrides and k in overrides else F.try_divide(a, b)
    r = [ratio(c2h2, c2h4, "r1"), ratio(ch4, h2, "r2"), ratio(c2h4, c2h6, "r3")]
    out = df.withColumns({f"r{i + 1}": x for i, x in enumerate(r)})
    zero = [c2h4, h2, c2h6]
    code = lambda k, low, mid, high, cuts: F.when(F.col(f"r{k}").isNull(), F.when(zero[k - 1] == 0, 1)).when(F.col(f"r{k}") < cuts[0], low).when(F.col(f"r{k}") < cuts[1], mid).otherwise(high)
    return out.withColumns({"code1": code(1, 0, 1, 2, (0.1, 3)), "code2": code(2, 1, 0, 2, (0.1, 1)), "code3": code(3, 0, 1, 2, (1, 3))})


def rule_table(spark, rules=RATIO_RULES) -> DataFrame:
    """rule, code1, code2, code3, fault, weight: rules by code triple, at most 27 triples."""
    rows = [(name, x, y, z, f, float(w)) for name, a, b, c, faults, w in rules for x in a for y in b for z in c for f in faults]
    return spark.createDataFrame(rows, "rule string, code1 int, code2 int, code3 int, fault string, weight double")


def match_rules(df: DataFrame, faults: Sequence[str], rules=RATIO_RULES, measures: Sequence[str] = GASES) -> DataFrame:
    """Add boost_<fault>: the largest weight of a rule that fits the codes, 0 where none does or a measure is missing."""
    triples = rule_table(df.sparkSession, rules).groupBy("code1", "code2", "code3").agg(*[F.max(F.when(F.col("fault") == f, F.col("weight")).otherwise(0.0)).alias(f"boost_{f}") for f in faults])
    out = df.join(F.broadcast(triples), ["code1", "code2", "code3"], "left")  # at most 27 rows
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in measures])
    return out.withColumns({f"boost_{f}": F.when(whole, F.coalesce(f"boost_{f}", F.lit(0.0))).otherwise(0.0) for f in faults})


def interpret(df: DataFrame) -> DataFrame:
    """Text flags from the gases' limits, joined by "; "."""
    v = {g: F.coalesce(F.col(g), F.lit(0.0)) for g in GASES}
    total = reduce(lambda a, b: a + b, v.values())
    share = v["C2H2"] / F.when(total == 0, 1).otherwise(total)
    flags = [
        F.when(v["H2"] > 150, "H2 above 150"), F.when(v["C2H2"] > 5, "C2H2 above 5"), F.when(share > 0.5, "C2H2 over half").when((v["C2H2"] > 0) & (share < 0.1), "C2H2 under a tenth"),
        F.when(v["C2H4"] / F.when(v["C2H6"] == 0, 1).otherwise(v["C2H6"]) >= 3, "C2H4/C2H6 at least 3"),
    ]
    found = F.array_compact(F.array(*flags))
    return df.withColumn("interpretation", F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("within limits"))


def mask_measures(df: DataFrame, id_col: str, measures: Sequence[str] = GASES, levels: Mapping[str, int] = {"light": 1, "medium": 2, "heavy": 3}, n: int | None = None, by: str = "fault", seed: str | int = 0) -> DataFrame:
    """Partial observations: each record at each level with k measures hidden, by hash; visible_*, masked, level; evidence of
    what is visible as initial_*, of the rest as hidden_*."""
    rows = proportional_sample(df, by, n, seed, id_col) if n else df
    order = F.array_sort(F.array(*[F.struct(hash_key(seed, F.col(id_col), F.lit(m)).alias("k"), F.lit(m).alias("m")) for m in measures]))
    out = rows.withColumn("_order", F.transform(order, lambda x: x["m"])).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    k = reduce(lambda a, kv: F.when(F.col("level") == kv[0], kv[1]).otherwise(a), levels.items(), F.lit(0))
    out = out.withColumn("masked", F.array_sort(F.slice("_order", 1, k))).withColumns({f"visible_{m}": F.when(~F.array_contains("masked", m), F.col(m)) for m in measures})
    seen = derive_evidence(out.select("*", *[F.col(m).alias(f"full_{m}") for m in measures]).drop(*measures).withColumnsRenamed({f"visible_{m}": m for m in measures}))
    symptoms = [c for c in seen.columns if c not in out.columns and not c.startswith("full_")]
    seen = seen.withColumnsRenamed({m: f"visible_{m}" for m in measures} | {s: f"initial_{s}" for s in symptoms}).withColumnsRenamed({f"full_{m}": m for m in measures})
    full = derive_evidence(seen)
    return full.withColumns({f"hidden_{s}": F.when(F.col(f"initial_{s}").isNull(), F.col(s)) for s in symptoms}).drop(*symptoms, "_order").withColumn("sim_id", F.concat_ws("-", F.col(id_col).cast("string"), "level"))

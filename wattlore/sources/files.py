"""Readers and writers: declared schemas at the edges, DataFrames within."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PAGES = "array<array<struct<type:string,content:string>>>"


def decimal_comma(col: Column) -> Column:
    """A number written with a decimal comma; anything else is null."""
    return F.regexp_replace(F.trim(col), ",", ".").try_cast("double")


def read_semicolon_csv(spark: SparkSession, path: str, measures: Sequence[str], label: str, source: str) -> DataFrame:
    """CSV with ``;`` and decimal commas: measures as double, label, source; column names are trimmed."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(*[decimal_comma(F.col(m)).alias(m) for m in measures], F.upper(F.trim(F.col(label))).alias("label"), F.lit(source).alias("source"))


def read_pages(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """One JSON file (pages of blocks) for each document folder: doc_dir, pages. Block content stays JSON text.

    bundled: files of write_page_bundles, where a line is a document. A file for each document costs a task's overhead each.
    """
    if bundled:
        return spark.read.schema(f"doc_dir string, pages {PAGES}").json(path)
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    folder = F.element_at(F.split("file", "/"), -2)
    return raw.select(F.url_decode(folder).alias("doc_dir"), F.from_json("value", PAGES).alias("pages"))


def write_page_bundles(docs: DataFrame, path: str) -> None:
    """doc_dir, pages (array of pages of blocks) as JSON lines, many documents in a file."""
    docs.select(F.col("doc_dir").cast("string").alias("doc_dir"), "pages").write.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_series(spark: SparkSession, path: str, ts: str = "date", fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV series: series_id from the file's name, ts, every other column as double."""
    raw = spark.read.option("header", True).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return raw.select(name.alias("series_id"), F.try_to_timestamp(F.col(ts), F.lit(fmt)).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c != ts])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON {type: {canonical: [alias]}} -> surface, canon, type; a canonical name is a surface too."""
    raw = spark.read.option("wholetext", True).text(path)
    kinds = raw.select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("type", "entries"))
    names = kinds.select("type", F.explode("entries").alias("canon", "aliases"))
    aliases = names.select(F.explode("aliases").alias("surface"), "canon", "type")
    return aliases.unionByName(names.select(F.col("canon").alias("surface"), "canon", "type")).filter(F.trim("surface") != "").distinct()


def read_params(spark: SparkSession, path: str, defaults: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Learned parameters over defaults: prior(class, p), cpt(class, symptom, p_true, p_false, source), weights(class, w), t(t).

    A learned probability replaces the default of its class and symptom only; weights are clipped to [0, 1]; t must be positive.
    """
    schema = "prior map<string,double>, cpt map<string,map<string,struct<p_true:double,p_false:double>>>, fusion_weights map<string,double>, calibration struct<T:double>"
    raw = spark.read.option("wholetext", True).schema("value string").text(path).select(F.from_json("value", schema).alias("j")).select("j.*")
    over = {
        "prior": raw.select(F.explode("prior").alias("class", "p")),
        "cpt": raw.select(F.explode("cpt").alias("class", "s")).select("class", F.explode("s").alias("symptom", "p")).select("class", "symptom", "p.p_true", "p.p_false", F.lit("learned").alias("source")),
        "weights": raw.select(F.explode("fusion_weights").alias("class", "w")),
    }
    keys = {"prior": ["class"], "cpt": ["class", "symptom"], "weights": ["class"]}
    out = {}
    for name, key in keys.items():
        base, new = defaults[name], over[name]
        rest = [c for c in base.columns if c not in key]
        joined = base.join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest]), key, "full")
        out[name] = joined.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])
    out["weights"] = out["weights"].withColumn("w", F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)))
    out["t"] = raw.select(F.when(F.col("calibration.T") > 0, F.col("calibration.T")).otherwise(1.0).alias("t"))
    return out


def write_params(params: Mapping[str, DataFrame], path: str) -> None:
    """The long tables as one nested JSON row (as many entries as classes and symptoms)."""
    entries = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    prior = params["prior"].agg(entries("class", "p").alias("prior"))
    by_class = params["cpt"].groupBy("class").agg(entries(F.col("symptom"), F.struct("p_true", "p_false")).alias("s"))
    cpt = by_class.agg(F.map_from_entries(F.collect_list(F.struct("class", "s"))).alias("cpt"))  # maps have no order to sort by
    weights = params["weights"].agg(entries("class", "w").alias("fusion_weights"))
    prior.crossJoin(cpt).crossJoin(weights).crossJoin(params["t"].select(F.struct(F.col("t").alias("T")).alias("calibration"))).write.mode("overwrite").json(path)


def write_records(df: DataFrame, csv_path: str, jsonl_path: str, nested: Mapping[str, Sequence[str]]) -> None:
    """The same rows as flat CSV and as JSON lines with groups of columns nested under a name."""
    df.write.mode("overwrite").option("header", True).csv(csv_path)
    inner = {c for group in nested.values() for c in group}
    df.select(*[c for c in df.columns if c not in inner], *[F.struct(*group).alias(name) for name, group in nested.items()]).write.mode("overwrite").json(jsonl_path)


def read_embeddings(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<float>").alias("embedding"))


def forbidden_roles(sources: DataFrame, roles: DataFrame, purpose: str) -> DataFrame:
    """Sources (path) that a purpose must not use: registered with a role not allowed for it, or a ``synthetic`` path segment.

    roles: path, role, allowed (array of purposes); a source that isn't registered is judged by its path alone.
    """
    joined = sources.join(roles, "path", "left")
    synthetic = F.array_contains(F.split(F.lower("path"), "/"), "synthetic") & (F.lit(purpose) != "synthetic")
    wrong = F.col("role").isNotNull() & ~F.coalesce(F.array_contains("allowed", purpose), F.lit(False))
    return joined.filter(wrong | synthetic).select("path", "role")


def assert_role(sources: DataFrame, roles: DataFrame, purpose: str) -> None:
    """Raise if any source has a role forbidden for the purpose."""
    bad = forbidden_roles(sources, roles, purpose).take(5)
    if bad:
        raise ValueError(f"not allowed for {purpose}: {[r.path for r in bad]}")

"""Knowledge graph: rule extraction from sentences, triples to nodes and edges, search by bounded self-joins, evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.determinism import hash_key
from .relations import TRIPLE, extract_relations  # noqa: F401


def explode_sentences(units: DataFrame, triggers: Sequence[str], lo: int = 10, hi: int = 200, types: Sequence[str] = ("paragraph", "list")) -> DataFrame:
    """unit_id, doc_id, pos, sentence of lo..hi characters with under four dollar signs and a trigger."""
    parts = F.regexp_extract_all("text", F.lit(r"[^。！？；.!?;\n]+[。！？；.!?;]?"), F.lit(0))
    rows = units.filter(F.col("type").isin(*types)).select("unit_id", "doc_id", F.posexplode(parts).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    fine = F.length("sentence").between(lo, hi) & (F.length(F.regexp_replace("sentence", r"[^$]", "")) < 4)
    return rows.filter(fine & F.col("sentence").rlike("|".join(map(re.escape, triggers))))


def surface_pattern(surfaces: Sequence[str]) -> re.Pattern:
    """Longest first; Latin surfaces need other characters than letters and digits around them; single CJK characters go."""
    kept = sorted({s for s in surfaces if len(s) > 1 or s.isascii()}, key=lambda s: (-len(s), s))
    one = lambda s: rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])" if s.isascii() else re.escape(s)
    return re.compile("|".join(map(one, kept)) or r"(?!)")


def surface_finder(surfaces: Sequence[str], small: int = 64) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    """What surface_pattern finds in a text, as (surface, start, end).

    A pattern tries every surface at every place; beyond ``small`` surfaces the places are looked up instead, by the lengths
    that surfaces with the same first character have.
    """
    if len(surfaces) <= small or "" in surfaces:
        find = surface_pattern(surfaces)
        return lambda t: ((m[0], m.start(), m.end()) for m in find.finditer(t))
    known = {s for s in surfaces if len(s) > 1 or s.isascii()}
    lengths: dict[str, set[int]] = {}
    for s in known:
        lengths.setdefault(s[0], set()).add(len(s))
    tries = {c: sorted(n, reverse=True) for c, n in lengths.items()}
    inner = lambda c: c.isascii() and c.isalnum()

    def found(t: str) -> Iterator[tuple[str, int, int]]:
        i = 0
        while i < len(t):
            for n in tries.get(t[i], ()):
                s = t[i : i + n]
                if len(s) == n and s in known and not (s.isascii() and (inner(t[i - 1 : i]) or inner(t[i + n : i + n + 1]))):
                    yield s, i, i + n
                    i += n
                    break
            else:
                i += 1

    return found


def match_entities(sentences: DataFrame, lexicon: list[tuple[str, str, str]], text: str = "sentence") -> DataFrame:
    """Add entities: array of canon, type, start, end of longest, non-overlapping surfaces (surface, canon, type: the stated
    lexicon). A surface with several types gives one entity for each."""
    by: dict[str, list[tuple[str, str]]] = {}
    for surface, canon, kind in lexicon:
        by.setdefault(surface, []).append((canon, kind))
    find = surface_finder(list(by))
    kinds = {s: sorted(set(x)) for s, x in by.items()}

    @F.pandas_udf("array<struct<canon:string,type:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"canon": c, "type": k, "start": a, "end": z} for s, a, z in find(t or "") for c, k in kinds[s]])

    return sentences.withColumn("entities", run(F.col(text)))


def aggregate_triples(sentences: DataFrame, max_evidence: int = 3) -> DataFrame:
    """Distinct triples of sentences: support_count is the number of documents; the first sentences are evidence."""
    rows = sentences.select("doc_id", "unit_id", "pos", "sentence", F.explode("triples").alias("t")).select("doc_id", "unit_id", "pos", "sentence", "t.*").distinct()
    key = ["head", "head_type", "relation", "tail", "tail_type"]
    support = rows.select(*key, "doc_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("support_count"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "unit_id", "pos"))
    first = rows.withColumn("_r", nth).filter(F.col("_r") <= max_evidence).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "sentence", "unit_id", "doc_id"))), lambda x: F.struct(x["sentence"].alias("sentence"), x["unit_id"].alias("unit_id"), x["doc_id"].alias("doc_id"))).alias("evidence"))
    return support.join(first, key)


def unmatched_candidates(sentences: DataFrame) -> DataFrame:
    """Sentences with entities and no triple."""
    return sentences.filter((F.size("triples") == 0) & (F.size("entities") > 0))


def check_triples(triples: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal triples, counts by reason). allowed: relation, head_type, tail_type — a stated table."""
    known = allowed.select("relation").distinct().withColumn("_k", F.lit(True))
    heads = allowed.select("relation", "head_type").distinct().withColumn("_h", F.lit(True))
    both = allowed.select("relation", "head_type", "tail_type").distinct().withColumn("_b", F.lit(True))
    rows = triples.join(known, "relation", "left").join(heads, ["relation", "head_type"], "left").join(both, ["relation", "head_type", "tail_type"], "left")
    reason = F.when(F.col("_k").isNull(), "unknown_relation").when(F.col("_h").isNull(), "bad_head_type").when(F.col("_b").isNull(), "bad_tail_type").when(F.col("head") == F.col("tail"), "self_loop")
    rows = rows.withColumn("reason", reason).drop("_k", "_h", "_b")
    return rows.filter("reason is null").drop("reason").select(triples.columns), rows.filter("reason is not null").groupBy("reason").count()


def merge_triples(sources: Mapping[str, DataFrame], confidence: Mapping[str, float] = {"rule": 0.6, "llm": 0.75, "human": 1.0}, rejected: DataFrame | None = None, max_evidence: int = 5) -> DataFrame:
    """Union of sources: documents united, extractors, best confidence (the source's default where null), evidence by unit.
    rejected (head, relation, tail) removes keys. sources' rows: head, head_type, relation, tail, tail_type, doc_ids, evidence[, confidence]."""
    rows = []
    for name, df in sources.items():
        own = F.col("confidence") if "confidence" in df.columns else F.lit(None).cast("double")
        rows.append(df.select("head", "head_type", "relation", "tail", "tail_type", "doc_ids", "evidence", F.lit(name).alias("extractor"), F.coalesce(own, F.lit(confidence.get(name, 0.5))).alias("confidence")))
    every = reduce(DataFrame.unionByName, rows)
    if rejected is not None:
        every = every.join(rejected.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_anti")
    key = ["head", "head_type", "relation", "tail", "tail_type"]
    docs = every.select(*key, F.explode_outer("doc_ids").alias("d")).groupBy(*key).agg(F.array_sort(F.collect_set("d")).alias("doc_ids"))
    ev = every.select(*key, F.explode_outer("evidence").alias("e")).filter("e is not null")
    one = ev.withColumn("_u", F.row_number().over(Window.partitionBy(*key, "e.unit_id").orderBy("e.sentence"))).filter("_u = 1")
    few = one.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("e.unit_id"))).filter(F.col("_r") <= max_evidence).groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    agg = every.groupBy(*key).agg(F.array_sort(F.collect_set("extractor")).alias("extractors"), F.max("confidence").alias("confidence"))
    return agg.join(docs, key).join(few, key, "left").withColumn("support_count", F.size("doc_ids").cast("long"))


def build_nodes_edges(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, type, degree, n_docs; edges source, target, relation, ...). Degree counts both ends; n_docs unites documents."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("type")))).alias("e"), "doc_ids")
    degree = ends.groupBy("e.name", "e.type").agg(F.count(F.lit(1)).alias("degree"))
    docs = ends.select("e.name", "e.type", F.explode_outer("doc_ids").alias("d")).distinct().groupBy("name", "type").agg(F.count("d").alias("n_docs"))
    edges = triples.withColumnsRenamed({"head": "source", "tail": "target"})
    return degree.join(docs, ["name", "type"]), edges


def bigrams(text) -> F.Column:
    t = F.regexp_replace(F.lower(text), r"\s", "")
    # the outer transform holds the characters, so they are not worked out again for each place
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.concat(F.get(c, i - 1), F.get(c, i)))
    found = F.transform(F.array(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))), pairs)
    return F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(F.get(found, F.lit(0))))


def locate_entities(queries: DataFrame, lexicon: list[tuple[str, str, str]], max_entities: int = 4, threshold: float = 0.34) -> DataFrame:
    """qid, entity, score, how: surfaces in the query (1 + length / 20), else names whose bigrams are alike (Jaccard).

    lexicon: the stated surface list (surface, canon, type); the fallback meets it on bigrams.
    """
    spark = queries.sparkSession
    hits = match_entities(queries, lexicon, "query").select("qid", F.explode("entities").alias("e")).groupBy("qid", F.col("e.canon").alias("entity")).agg(F.max(1 + (F.col("e.end") - F.col("e.start")) / 20).alias("score"))
    rest = queries.join(hits.select("qid").distinct(), "qid", "left_anti")
    names = spark.createDataFrame(sorted({(s, c) for s, c, _ in lexicon}), "surface string, entity string").withColumn("b", bigrams(F.col("surface")))
    asked = rest.withColumn("a", bigrams(F.col("query")))
    met = asked.select("qid", F.size("a").alias("na"), F.explode("a").alias("g")).join(names.select("surface", "entity", F.size("b").alias("nb"), F.explode("b").alias("g")), "g").groupBy("qid", "surface", "entity").agg(F.count(F.lit(1)).alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    alike = met.withColumn("score", F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).filter(F.col("score") >= threshold).groupBy("qid", "entity").agg(F.max("score").alias("score"))
    every = hits.withColumn("how", F.lit("surface")).unionByName(alike.withColumn("how", F.lit("bigram")))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "entity")
    return every.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_entities).drop("_r")


def expand_paths(starts: DataFrame, edges: DataFrame, relations: Sequence[str] | None = None, hops: int = 1, direction: str = "both", max_paths: int = 20) -> DataFrame:
    """qid, path, support, confidence, n_hops: simple paths from (qid, entity); the first hop fixes the direction.

    One equi-join for each hop. After each hop only the best max_paths of each query go on, which loses nothing: a longer
    path never has more support or confidence, so it sorts after its prefix.
    """
    e = edges if relations is None else edges.filter(F.col("relation").isin(*relations))
    e = e.select("source", "relation", "target", "support_count", "confidence")
    out_, in_ = e.select(F.col("source").alias("at"), "relation", F.col("target").alias("to"), "support_count", "confidence", F.lit(True).alias("fwd")), e.select(F.col("target").alias("at"), "relation", F.col("source").alias("to"), "support_count", "confidence", F.lit(False).alias("fwd"))
    steps = out_ if direction == "out" else in_ if direction == "in" else out_.unionByName(in_)
    now = starts.select("qid", F.col("entity").alias("at"), F.array("entity").alias("path"), F.array("entity").alias("nodes"), F.lit(1 << 60).cast("long").alias("support"), F.lit(1.0).alias("conf"), F.lit(None).cast("boolean").alias("way"), F.lit(0).alias("n_hops"))
    order = Window.partitionBy("qid").orderBy(F.desc("support"), F.desc("conf"), "n_hops", F.array_join("path", "|"))
    every = None
    for _ in range(hops):
        met = now.join(steps, "at").filter((F.col("way").isNull() | (F.col("way") == F.col("fwd"))) & ~F.array_contains("nodes", F.col("to")))
        now = met.select("qid", F.col("to").alias("at"), F.concat("path", F.array("relation", "to")).alias("path"), F.concat("nodes", F.array("to")).alias("nodes"), F.least("support", "support_count").alias("support"), F.least("conf", "confidence").alias("conf"), F.col("fwd").alias("way"), (F.col("n_hops") + 1).alias("n_hops"))
        now = now.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_paths).drop("_r")
        every = now if every is None else every.unionByName(now)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_paths).select("qid", "path", "support", F.col("conf").alias("confidence"), F.col("way").alias("forward"), "n_hops", "rank")


def graph_search(queries: DataFrame, edges: DataFrame, lexicon: list[tuple[str, str, str]], **how) -> DataFrame:
    """qid, status (ok, no_relation, no_match), paths."""
    found = locate_entities(queries, lexicon)
    paths = expand_paths(found.select("qid", "entity"), edges, **how).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "support", "confidence"))).alias("paths"))
    rows = queries.select("qid").join(found.groupBy("qid").agg(F.array_sort(F.collect_set("entity")).alias("entities")), "qid", "left").join(paths, "qid", "left")
    return rows.withColumn("status", F.when(F.col("entities").isNull(), "no_match").when(F.col("paths").isNull(), "no_relation").otherwise("ok"))


def relation_qa_seeds(edges: DataFrame, aliases: DataFrame | None = None, min_support: int = 1) -> DataFrame:
    """anchor, relation, direction, expected, max_support, surface, surface_kind: questions from edges grouped at either end."""
    rows = edges.filter(F.col("support_count") >= min_support)
    def side(anchor: str, other: str, direction: str) -> DataFrame:
        return rows.groupBy(F.col(anchor).alias("anchor"), "relation").agg(F.array_sort(F.collect_set(other)).alias("expected"), F.max("support_count").alias("max_support")).withColumn("direction", F.lit(direction))

    both = side("source", "target", "out").unionByName(side("target", "source", "in"))
    named = both.withColumns({"surface": F.col("anchor"), "surface_kind": F.lit("canonical")})
    if aliases is None:
        return named
    other = both.join(aliases.filter("surface <> canon").select(F.col("canon").alias("anchor"), "surface"), "anchor").withColumn("surface_kind", F.lit("alias"))
    return named.unionByName(other.select(named.columns))


def stratified_edge_sample(edges: DataFrame, n: int, seed: str | int = 0, columns: Sequence[str] = ("source", "relation", "target")) -> DataFrame:
    """Per relation n edges, half of them with support of 2 or more, in hash order; what one half lacks the other fills."""
    high = F.col("support_count") >= 2
    w = Window.partitionBy("relation", high).orderBy(hash_key(seed, *columns), *columns)
    rows = edges.withColumns({"_r": F.row_number().over(w), "_first": F.when(F.row_number().over(w) <= -(-n // 2), 0).otherwise(1)})
    pick = Window.partitionBy("relation").orderBy("_first", "_r", F.when(high, 0).otherwise(1))
    return rows.withColumn("_p", F.row_number().over(pick)).filter(F.col("_p") <= n).drop("_r", "_first", "_p")


def graph_hit_rates(qa: DataFrame, found: DataFrame, dims: Sequence[str] = ("relation", "split", "surface_kind")) -> DataFrame:
    """dim, value, n, located, hit_any, hit_all, by each dimension and over all. found: qa_id, located, answers."""
    rows = qa.join(found, "qa_id", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("located", F.lit(False)).cast("double")).alias("located"), F.avg((F.size(F.array_intersect("expected", "answers")) > 0).cast("double")).alias("hit_any"), F.avg((F.size(F.array_except("expected", "answers")) == 0).cast("double")).alias("hit_all")]
    out = rows.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(*aggs, F.grouping_id().alias("_g"))
    k = len(dims)
    name = reduce(lambda a, i: F.when(F.col("_g") == (2**k - 1) ^ (1 << (k - 1 - i)), dims[i]).otherwise(a), range(k), F.lit("ALL"))
    value = reduce(lambda a, i: F.when(F.col("_g") == (2**k - 1) ^ (1 << (k - 1 - i)), F.col(dims[i]).cast("string")).otherwise(a), range(k), F.lit("ALL"))
    return out.select(name.alias("dim"), value.alias("value"), "n", "located", "hit_any", "hit_all")


def label_precision(sample: DataFrame, labels: DataFrame, edges: DataFrame, key: Sequence[str] = ("source", "relation", "target")) -> DataFrame:
    """relation, bucket, n, strict, lenient precision and edges that are gone since. labels: key, verdict (correct, partial, wrong)."""
    rows = sample.join(labels.select(*key, "verdict"), list(key), "left").join(edges.select(*key).distinct().withColumn("_here", F.lit(True)), list(key), "left")
    rows = rows.withColumn("bucket", F.when(F.col("support_count") >= 2, "2+").otherwise("1"))
    judged = F.col("verdict").isNotNull()
    return rows.rollup("relation", "bucket").agg(F.count_if(judged).alias("n"), F.avg(F.when(judged, (F.col("verdict") == "correct").cast("double"))).alias("strict"), F.avg(F.when(judged, F.col("verdict").isin("correct", "partial").cast("double"))).alias("lenient"), F.count_if(F.col("_here").isNull()).alias("dropped"))


def two_hop_pairs(edges: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a, r1, b, r2, c, support: one (best) two-hop path for each start and relation pair, c other than a."""
    left = edges.select(F.col("source").alias("a"), F.col("relation").alias("r1"), F.col("target").alias("b"), F.col("support_count").alias("s1"))
    right = edges.select(F.col("source").alias("b"), F.col("relation").alias("r2"), F.col("target").alias("c"), F.col("support_count").alias("s2"))
    wanted = reduce(lambda x, y: x | y, [(F.col("r1") == p) & (F.col("r2") == q) for p, q in pairs])
    met = left.join(right, "b").filter(wanted & (F.col("a") != F.col("c"))).withColumn("support", F.col("s1") + F.col("s2"))
    best = F.max_by(F.struct("b", "c", "support"), F.struct("support", F.col("b"), F.col("c")))
    return met.groupBy("a", "r1", "r2").agg(best.alias("x")).select("a", "r1", "x.b", "r2", "x.c", "x.support")


def symptom_evidence(mapping: DataFrame, edges: DataFrame, relations: Sequence[str], limit: int = 2) -> DataFrame:
    """symptom, sentence: at most ``limit`` sentences on edges of the symptom's nodes, outgoing before incoming. mapping: symptom, node."""
    rows = edges.filter(F.col("relation").isin(*relations))
    ways = [rows.select(F.col(c).alias("node"), F.lit(i).alias("way"), "support_count", F.explode("evidence").alias("e")) for i, c in enumerate(("source", "target"))]
    met = mapping.join(reduce(DataFrame.unionByName, ways), "node").groupBy("symptom", F.col("e.sentence").alias("sentence")).agg(F.min("way").alias("way"), F.max("support_count").alias("s"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("symptom").orderBy("way", F.desc("s"), "sentence"))).filter(F.col("rank") <= limit).select("symptom", "sentence", "rank")

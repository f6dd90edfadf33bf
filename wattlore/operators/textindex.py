"""Tokens, BM25 tables by layer, sub-chunks, summaries and document and section indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.steps import written
from .chunking import SENTENCE


def tokenize(text: Column, stop: Sequence[str] = (), keep: Sequence[str] = (), pattern: str = r"[\p{L}\p{N}]+") -> Column:
    """Lower-cased words without LaTeX commands, stop words, single characters, pure numbers and ASCII words of up to two
    letters; words of ``keep`` stay. For scripts with spaces; see tokenize_cjk."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[a-zA-Z]+", " ")), F.lit(pattern), F.lit(0))
    fine = lambda t: (F.length(t) > 1) & ~t.rlike(r"^[0-9.]+$") & ~t.rlike(r"^[a-z0-9]{1,2}$")
    return F.filter(found, lambda t: (t.isin(*keep) if keep else F.lit(False)) | (fine(t) & (~t.isin(*stop) if stop else F.lit(True))))


def best_words(run: str, lexicon: dict[str, list[str]]) -> list[tuple[str, bool]]:
    """The best path through the word graph of a run of characters: (piece, whether it is a word).

    lexicon: words by first character, longest first. Best is the path with the fewest characters outside words, then with
    the fewest words, then with the longer word first. Characters outside words in a row are one piece.
    """
    n = len(run)
    cost: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    step = [0] * n  # length of the word that the best path takes here, 0 for none
    for i in range(n - 1, -1, -1):
        cost[i] = (cost[i + 1][0] + 1, cost[i + 1][1])
        for w in lexicon.get(run[i], ()):
            if run.startswith(w, i):
                unknown, words = cost[i + len(w)]
                if (unknown, words + 1) < cost[i] or (not step[i] and (unknown, words + 1) == cost[i]):
                    cost[i], step[i] = (unknown, words + 1), len(w)
    out: list[tuple[str, bool]] = []
    i = 0
    while i < n:
        if step[i]:
            out.append((run[i : i + step[i]], True))
            i += step[i]
        else:
            j = i + 1
            while j < n and not step[j]:
                j += 1
            out.append((run[i:j], False))
            i = j
    return out


def tokenize_cjk(text: Column, lexicon: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """For scripts without spaces: the best path through the lexicon's words in each run of characters (best_words), bigrams of
    what lies outside words. Latin runs of two characters and more are words, unless they are numbers, and lexicon words
    with other characters go before all. Single characters and stop words go."""
    import re

    words = sorted(set(lexicon), key=lambda w: (-len(w), w))
    han = re.compile(r"[一-鿿]+")
    mixed = [w for w in words if not han.fullmatch(w)]
    find = re.compile("|".join([*map(re.escape, mixed), r"[A-Za-z0-9]{2,}", r"[一-鿿]+"]))
    by_first: dict[str, list[str]] = {}
    for w in words:
        if han.fullmatch(w):
            by_first.setdefault(w[0], []).append(w)
    known, gone = set(mixed), set(stop)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            out: list[str] = []
            for w in find.findall((t or "").lower()):
                if w in known:
                    out.append(w)
                elif "一" <= w[0]:
                    for piece, is_word in best_words(w, by_first):
                        out += [piece] if is_word else [piece[i : i + 2] for i in range(len(piece) - 1)]
                elif not w.isdigit():
                    out.append(w)
            return [w for w in out if w not in gone and len(w) > 1]

        return texts.map(one)

    return run(text)


@dataclass
class Index:
    """Okapi BM25 tables. idf = ln(n - df + 0.5) - ln(df + 0.5); negative ones become eps * mean idf over all terms.

    Tokens stay with their items. Terms and stats are counted when first asked for, in one aggregation that is combined before
    its shuffle, and written. A search does without them: its blocks (retrieval.py) carry their own counts.
    """

    items: DataFrame  # layer, item_id, tokens, dl
    k1: float = 1.5
    b: float = 0.75
    eps: float = 0.25
    searched: dict = field(default_factory=dict)  # what searches have written, by layer

    @cached_property
    def _counts(self) -> DataFrame:
        none = F.array(F.lit(None).cast("string"))  # a null term stands for the item itself
        said = self.items.select("layer", "dl", F.explode(F.coalesce(F.concat(F.array_compact(F.array_distinct("tokens")), none), none)).alias("term"))
        own = F.col("term").isNull()
        return written(said.groupBy("layer", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(own, F.col("dl"))).alias("dl"), F.count(F.when(own, F.col("dl"))).alias("with_dl")))

    @cached_property
    def stats(self) -> DataFrame:
        """layer, n, avgdl"""
        return self._counts.filter(F.col("term").isNull()).select("layer", F.col("df").alias("n"), F.try_divide("dl", "with_dl").alias("avgdl"))

    @cached_property
    def terms(self) -> DataFrame:
        """layer, term, df, idf"""
        terms = self._counts.filter(F.col("term").isNotNull()).select("layer", "term", "df").join(F.broadcast(self.stats), "layer")  # a row for each layer
        terms = terms.withColumn("raw", raw_idf(F.col("n"), F.col("df")))
        mean = terms.groupBy("layer").agg(F.avg("raw").alias("mean"))
        return terms.join(F.broadcast(mean), "layer").select("layer", "term", "df", F.when(F.col("raw") < 0, self.eps * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def bm25_index(items: DataFrame, id_col: str, tokens: str, layer: str | Column, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> Index:
    """The index of items with their tokens. Items without tokens count in n and avgdl."""
    layer = F.lit(layer) if isinstance(layer, str) else layer
    return Index(items.select(layer.alias("layer"), F.col(id_col).alias("item_id"), F.col(tokens).alias("tokens")).withColumn("dl", F.size("tokens")), k1, b, eps)


def layered_index(layers: Mapping[str, DataFrame], **options: float) -> Index:
    """One index of several layers (item_id, tokens each)."""
    rows = reduce(DataFrame.unionByName, (df.select(F.col("item_id").cast("string").alias("item_id"), "tokens", F.lit(name).alias("_layer")) for name, df in layers.items()))
    return bm25_index(rows, "item_id", "tokens", F.col("_layer"), **options)


def sub_chunks(text: str | None, lo: int, hi: int) -> list[str]:
    out, now = [], ""
    for s in (x for x in SENTENCE.split(text or "") if x.strip()):
        if now and len(now) + len(s) > hi and len(now) >= lo:
            out.append(now)
            now = ""
        now += s
        while len(now) > 2 * hi:
            out.append(now[:hi])
            now = now[hi:]
    if now and len(now) < lo and out:
        out[-1] += now
    elif now:
        out.append(now)
    return out


def split_subchunks(chunks: DataFrame, id_col: str = "chunk_id", text: str = "body", lo: int = 100, hi: int = 150) -> DataFrame:
    """sub_id, parent_id, body: sentence packs of lo to hi characters; a short tail joins the piece before it."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sub_chunks(t, lo, hi))

    rows = chunks.select(F.col(id_col).alias("parent_id"), F.posexplode(run(F.col(text))).alias("k", "body"))
    return rows.select(F.format_string("%s-s%03d", F.col("parent_id").cast("string"), "k").alias("sub_id"), "parent_id", "body")


def parent_of_subchunk(sub_id: str, kind: str = "string") -> Column:
    """The parent_id in a sub_id of split_subchunks."""
    return F.regexp_extract(sub_id, r"^(.*)-s\d+$", 1).try_cast(kind)


def extractive_summary(chunks: DataFrame, lexicon: Sequence[str], max_terms: int = 6, max_chars: int = 140) -> DataFrame:
    """chunk_id, summary: last two path parts, first sentence of more than 8 characters, first-seen lexicon terms, cut."""
    sentences = F.filter(F.regexp_extract_all("body", F.lit(r"[^。！？.!?]+[。！？.!?]?"), F.lit(0)), lambda s: F.length(F.trim(s)) > 8)
    words = F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    terms = F.slice(F.array_intersect(F.array_distinct(words), F.array(*[F.lit(x) for x in lexicon]) if lexicon else F.array().cast("array<string>")), 1, max_terms)
    path = F.array_join(F.slice("section_path", F.greatest(F.lit(1), F.size("section_path") - 1), 2), " ")
    parts = F.array(path, F.coalesce(F.get(sentences, 0), F.lit("")), F.array_join(terms, " "))
    return chunks.select("chunk_id", F.substring(F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " "), 1, max_chars).alias("summary"))


def extract_abstract(units: DataFrame, marker: str = r"^\s*(摘\s*要|abstract)\s*[:：]?\s*", max_chars: int = 500) -> DataFrame:
    """doc_id, abstract: the first abstract paragraph (the next one added below 40 characters), or the body after an
    abstract title, else the first two paragraphs of more than 40 characters."""
    w = Window.partitionBy("doc_id").orderBy("order")
    rows = units.withColumns({"next": F.lead("text").over(w), "_m": F.lower("text").rlike(marker)})
    body = F.regexp_replace("text", "(?i)" + marker, "")
    own = F.when((F.col("type") == "paragraph") & F.col("_m"), F.when(F.length(body) < 40, F.concat(body, F.coalesce("next", F.lit("")))).otherwise(body))
    titled = F.when((F.col("type") == "title") & F.col("_m"), F.col("next"))
    long = F.when((F.col("type") == "paragraph") & (F.length("text") > 40), F.struct("order", "text"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("order")))
    found = rows.withColumns({"_own": own, "_titled": titled, "_rank": F.when(long.isNotNull(), F.sum(F.when(long.isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))})
    two = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= 2, F.struct("order", "text")))), lambda x: x["text"]), "\n")
    return found.groupBy("doc_id").agg(F.substring(F.coalesce(first(F.col("_own")), first(F.col("_titled")), two), 1, max_chars).alias("abstract"))


def extract_keywords(units: DataFrame, marker: str = r"(?i)^\s*(关键词|关键字|key\s*words)\s*[:：]?\s*", first_units: int = 40, n: int = 10) -> DataFrame:
    """doc_id, keywords: the first keyword line within the first units, cut at separators; null where there is none."""
    line = F.when((F.col("order") < first_units) & F.col("text").rlike(marker), F.regexp_replace("text", marker, ""))
    found = units.groupBy("doc_id").agg(F.min_by(line, F.when(line.isNotNull(), F.col("order"))).alias("line"))
    parts = F.filter(F.transform(F.split("line", r"[;；,，、]"), lambda x: F.trim(x)), lambda x: x != "")
    return found.select("doc_id", F.when(F.col("line").isNotNull(), F.slice(parts, 1, n)).alias("keywords"))


def frequent_keywords(docs: DataFrame, tokens: str = "tokens", n: int = 8) -> DataFrame:
    """doc_id, keywords: each document's n most frequent tokens, ties by token."""
    counts = docs.select("doc_id", F.explode(tokens).alias("t")).groupBy("doc_id", "t").count()
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "t"))).filter(F.col("r") <= n)
    return top.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("keywords"))


def doc_index(docs: DataFrame, units: DataFrame, chunks: DataFrame, max_toc: int = 80) -> DataFrame:
    """Document rows with toc (level, title) and chunk_ids in order."""
    heads = units.filter("type = 'title' and level >= 1").withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))).filter(F.col("_r") <= max_toc)
    toc = heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "level", F.col("text").alias("title")))), lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"))).alias("toc"))
    ids = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return docs.join(toc, "doc_id", "left").join(ids, "doc_id", "left")


def section_index(chunks: DataFrame, preview: int = 300) -> DataFrame:
    """One row for each (doc_id, section_path), wherever its chunks are: chunk_ids in order, n_chars, preview."""
    rows = chunks.groupBy("doc_id", "section_path").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))).alias("c"), F.sum("char_len").alias("n_chars"), F.min_by("body", "seq").alias("first"))
    sid = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.substring(F.md5(F.array_join("section_path", "|")), 1, 8))
    return rows.select("doc_id", "section_path", sid.alias("section_id"), F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), "n_chars", F.substring("first", 1, preview).alias("preview"))


def vocab_stats(index: Index, lexicon: DataFrame | None = None, top: int = 40) -> tuple[DataFrame, DataFrame]:
    """(layer, vocabulary, mean_tokens, lexicon_hits; layer, term, freq of the most frequent terms)."""
    freq = index.items.select("layer", F.explode("tokens").alias("term")).groupBy("layer", "term").agg(F.count(F.lit(1)).alias("freq"))
    stats = freq.groupBy("layer").agg(F.count(F.lit(1)).alias("vocabulary")).join(index.stats, "layer").withColumnRenamed("avgdl", "mean_tokens")
    if lexicon is not None:
        hits = freq.join(lexicon.select(F.lower("surface").alias("term")).distinct(), "term", "left_semi").groupBy("layer").agg(F.count(F.lit(1)).alias("lexicon_hits"))
        stats = stats.join(hits, "layer", "left").fillna(0, ["lexicon_hits"])
    w = Window.partitionBy("layer").orderBy(F.desc("freq"), "term")
    return stats, freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)

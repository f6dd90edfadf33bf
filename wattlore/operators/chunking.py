"""Units to retrieval chunks: section runs, dynamic-programming, title and fixed-window segmentation."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SENTENCE = re.compile(r"(?<=[。！？；.!?;])")
#: Costs of a cut between an anchor and a paragraph that speaks of it, next to any other anchor, before a list
#: item, after a colon, elsewhere; how a paragraph after an anchor begins, and how one before it ends, when it speaks of it.
GLUE = {"anchor_said": 3.0, "anchor": 1.5, "list": 2.0, "colon": 2.5, "else": 0.6}
SAYS_AFTER = r"^(由表|由图|从表|从图|表\s*\d|图\s*\d|如表|如图|上表|上图|式中|其中)"
SAYS_BEFORE = r"(如下表|见表|如表|如下图|见图|如图|列于表|示于图)[^。]*$"
ANCHORS = ("table", "image", "equation")


def pack_sentences(text: str, max_len: int) -> list[str]:
    """Greedy packing of sentences up to max_len; a longer sentence is cut every max_len characters."""
    out, now = [], ""
    for s in (x for x in SENTENCE.split(text or "") if x):
        if now and len(now) + len(s) > max_len:
            out.append(now)
            now = ""
        while len(s) > max_len:
            out.append(s[:max_len])
            s = s[max_len:]
        now += s
    return [*out, now] if now else out


def split_long(col: Column, max_len: int = 700) -> Column:
    """array<string> of pack_sentences."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_sentences(t, max_len))

    return run(col)


def section_runs(units: DataFrame, doc: str = "doc_id", order: str = "order") -> DataFrame:
    """Titles go; add run_id: consecutive units with one section_path. A path that comes again later is a new run."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = units.filter(F.coalesce(F.col("type") != "title", F.lit(True)))
    new = F.when(F.lag("section_path").over(w).eqNullSafe(F.col("section_path")) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w)).drop("_new")


def glue_cost(units: DataFrame, costs: dict[str, float] = GLUE) -> DataFrame:
    """Add glue: what a cut after a unit costs; null for a run's last unit."""
    w = Window.partitionBy("doc_id", "run_id").orderBy("order")
    nxt, here, after = F.lead("type").over(w), F.col("type"), F.lead("text").over(w)
    anchor = lambda c: c.isin(*ANCHORS)
    tail = F.col("text").substr(F.greatest(F.length("text") - 39, F.lit(1)), F.lit(40))
    said = (anchor(here) & (nxt == "paragraph") & after.rlike(SAYS_AFTER)) | (anchor(nxt) & (here == "paragraph") & tail.rlike(SAYS_BEFORE))
    cost = (
        F.when(nxt.isNull(), None).when(said, costs["anchor_said"]).when(anchor(here) | anchor(nxt), costs["anchor"])
        .when(here.isin("list", "paragraph") & (nxt == "list"), costs["list"]).when((here == "paragraph") & F.col("text").rlike("[:：]$"), costs["colon"]).otherwise(costs["else"])
    )
    return units.withColumn("glue", cost)


def best_cuts(lengths: Sequence[int], glue: Sequence[float], target: int, max_len: int, min_len: int, alpha: float) -> list[int]:
    """Ends of the segments of least cost. Ties keep the start that is tried first, from the nearest backwards."""
    def cost(n: int) -> float:
        if n < min_len:
            return (min_len - n) / min_len * 2.0
        return abs(n - target) / target * (0.5 if n <= target else 1.5) + (5.0 if n > max_len else 0.0)

    n = len(lengths)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        size = 0
        for i in range(j - 1, -1, -1):
            size += lengths[i] + (1 if i < j - 1 else 0)
            if size > max_len and i < j - 1:
                break
            cut = glue[j - 1] if j < n else 0.0
            value = best[i] + 2 * (1 - alpha) * cost(size) + 2 * alpha * cut
            if value < best[j]:
                best[j], back[j] = value, i
    ends, j = [], n
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def dp_segment(runs: DataFrame, target: int = 400, max_len: int = 700, min_len: int = 120, alpha: float = 0.5) -> DataFrame:
    """Add seg: the number of each unit's segment within its run (doc_id, run_id, order, text, glue).

    Only lengths and costs of a run's units go through Python, as one row for each run; texts stay in that row and are not
    shuffled again for a join.
    """
    def run(texts: pd.Series, glue: pd.Series) -> pd.Series:
        found = []
        for n, g in zip(texts, glue):
            ends = best_cuts(n.tolist(), g.tolist(), target, max_len, min_len, alpha)
            found.append([k for k, (a, z) in enumerate(zip([0, *ends], ends)) for _ in range(z - a)])
        return pd.Series(found)

    cut = F.pandas_udf(run, "array<int>")
    rest = [c for c in runs.columns if c not in ("doc_id", "run_id", "order")]
    rows = runs.groupBy("doc_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("order", F.struct(*rest).alias("rest")))).alias("u"))
    lengths, glue = F.transform("u", lambda x: F.coalesce(F.length(x["rest"]["text"]), F.lit(0))), F.transform("u", lambda x: F.coalesce(x["rest"]["glue"], F.lit(0.0)))
    rows = rows.withColumn("seg", cut(lengths, glue)).select("doc_id", "run_id", F.explode(F.arrays_zip("u", "seg")).alias("x"))
    return rows.select("doc_id", "run_id", "x.u.order", *[F.col("x.u.rest")[c].alias(c) for c in rest], "x.seg")


def _joined(runs: DataFrame) -> DataFrame:
    rows = runs.groupBy("doc_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("order", "unit_id", "type", "text", "page", "section_path"))).alias("u"))
    return rows.withColumn("body", F.array_join(F.transform("u", lambda x: x["text"]), "\n"))


def title_segment(runs: DataFrame, max_len: int = 700) -> DataFrame:
    """Whole runs, cut by split_long: doc_id, run_id, seg, body and all unit ids of the run in every piece."""
    rows = _joined(runs).select("*", F.posexplode(split_long(F.col("body"), max_len)).alias("seg", "piece"))
    return rows.select("doc_id", "run_id", "seg", F.col("piece").alias("body"), F.transform("u", lambda x: x["unit_id"]).alias("unit_ids"))


def fixed_window_segment(runs: DataFrame, window: int = 512, overlap: int = 128) -> DataFrame:
    """Character windows over the joined run, the last one ends with it; unit ids that a window touches."""
    step = window - overlap
    rows = _joined(runs).withColumn("n", F.length("body")).filter("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - window) / step) * step).cast("int"), F.lit(step))
    none = F.array().cast("array<int>")
    running = F.aggregate("u", F.struct(F.lit(0).alias("at"), none.alias("ends")), lambda a, x: F.struct((a["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(x["text"]) + 1)).alias("ends")))
    ends = running["ends"]
    out = rows.withColumn("ends", ends).select("*", F.posexplode(starts).alias("seg", "at"))
    touches = lambda x, i: ((F.col("ends")[i] - 1) > F.col("at")) & ((F.col("ends")[i] - 1 - F.length(x["text"])) < F.col("at") + window)
    return out.select("doc_id", "run_id", "seg", F.substring("body", F.col("at") + 1, F.lit(window)).alias("body"), F.transform(F.filter("u", touches), lambda x: x["unit_id"]).alias("unit_ids"))


def assemble_chunks(segments: DataFrame) -> DataFrame:
    """Units with run_id and seg -> chunks with header, body, sorted types, has_anchor, page range and doc-c%04d ids."""
    rows = segments.groupBy("doc_id", "run_id", "seg").agg(F.array_sort(F.collect_list(F.struct("order", "unit_id", "type", "text", "page", "section_path", "doc_title"))).alias("u"))
    body = F.array_join(F.transform("u", lambda x: x["text"]), "\n")
    path, title = F.col("u")[0]["section_path"], F.col("u")[0]["doc_title"]
    types = F.array_sort(F.array_distinct(F.transform("u", lambda x: x["type"])))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("run_id", "seg")) - 1
    out = rows.select(
        "doc_id", title.alias("doc_title"), path.alias("section_path"), F.transform("u", lambda x: x["unit_id"]).alias("unit_ids"), types.alias("unit_types"),
        F.exists("u", lambda x: x["type"].isin(*ANCHORS)).alias("has_anchor"), body.alias("body"), F.length(body).alias("char_len"),
        F.array_min(F.transform("u", lambda x: x["page"])).alias("page_start"), F.array_max(F.transform("u", lambda x: x["page"])).alias("page_end"), nth.alias("seq"),
    )
    header = F.concat(F.lit("《"), F.coalesce("doc_title", F.lit("")), F.lit("》"), F.when(F.size("section_path") > 0, F.concat(F.lit(" "), F.array_join("section_path", " > "))).otherwise(""))
    return out.withColumns({"chunk_id": F.format_string("%s-c%04d", F.col("doc_id").cast("string"), "seq"), "text": F.concat(header, F.lit("\n"), "body")})


def chunk_report(chunks: DataFrame, qs: Sequence[float] = (0.1, 0.5, 0.9), short: int = 120) -> tuple[DataFrame, DataFrame]:
    """(length buckets of 100 up to 900, one row of order statistics). The q-quantile is the element at int(n * q), which
    comes from the histogram of lengths, not from sorting all chunks in one task."""
    buckets = chunks.groupBy(F.least(F.floor(F.col("char_len") / 100) * 100, F.lit(900)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    hist = chunks.groupBy("char_len").agg(F.count(F.lit(1)).alias("n"))
    run = hist.withColumns({"upto": F.sum("n").over(Window.orderBy("char_len")), "all": F.sum("n").over(Window.partitionBy())})
    stats = [F.min(F.when(F.col("upto") > F.floor(F.col("all") * q), F.col("char_len"))).alias(f"p{round(q * 100)}") for q in qs]
    return buckets, run.agg(F.sum("n").alias("n"), *stats, F.max("char_len").alias("max"), F.sum(F.when(F.col("char_len") < short, F.col("n")).otherwise(0)).alias("n_short"))

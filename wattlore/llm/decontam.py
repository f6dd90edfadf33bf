"""Benchmark decontamination: which documents hold test items.

The test items make a BM25 index. Every training document is cut into overlapping passages, and every passage queries the
index for all items whose score is at least a share of the item's own score (its score for its whole text). Before the
block-max search a whole batch of passages is bounded at once, item by item, from the terms that few items have; passages
that no item can pass are done; for the rest only blocks of items are visited whose block maxima reach the least score asked
of one of their items. Items found are verified against the passage: enough of the question's and of the answer's word
triples have to be there. Items of fewer than min_words words stand beside the index: a document holds one if its words
hold the item's words, all and in a row.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bmw import BlockMaxIndex, idf, impacts, term_counts
from .common import materialize, open_fs, string_buffers, text_col, work_dir, write_bytes
from .words import segment_sum, shingles, word_hashes

RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def plain(text):
    """Lower-cased letters, marks and digits; everything else is a space."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " "))


def question_answer(items: DataFrame) -> DataFrame:
    """item_id, text, question, answer: own columns where the table has them, else the last sentence is the answer."""
    text = text_col(items)
    cut = r"(?s)^(.*[.!?])\s+(\S.*)$"
    whole = F.regexp_extract(text, cut, 1) == ""
    question = items["question"] if "question" in items.columns else F.when(whole, text).otherwise(F.regexp_extract(text, cut, 1))
    answer = items["answer"] if "answer" in items.columns else F.regexp_extract(text, cut, 2)
    return items.select(items["item_id"].cast("long").alias("item_id"), plain(text).alias("text"), plain(F.coalesce(question, F.lit(""))).alias("question"), plain(F.coalesce(answer, F.lit(""))).alias("answer"))


@dataclass
class Items:
    ids: list
    index: BlockMaxIndex
    idf: np.ndarray  # by index term
    own: np.ndarray  # score of each item for its own text
    rest: np.ndarray  # the part of it that terms common to many items can bring, as a share
    first: np.ndarray  # gate: for each index term its rows in gate_item and gate_share
    gate_item: np.ndarray
    gate_share: np.ndarray
    question: list[tuple[int, np.ndarray]]  # run length, distinct runs
    answer: list[tuple[int, np.ndarray]]
    stride: int


@dataclass
class Short:
    """Items of a few words by the hash of their whole word sequence, in order of (length, hash)."""

    ids: list
    score: np.ndarray
    runs: dict[int, np.ndarray]  # number of words: sorted hashes
    first: dict[int, int]  # number of words: place of the first of them in ids


def build_short(ids: list, texts: list[str], n: int, df: dict[int, int], mean_length: float | None) -> Short:
    """An item's score is its own BM25 score by the statistics of the indexed items; a word that they lack counts as new."""
    h, bounds = word_hashes(*string_buffers(pa.array(texts, pa.string())))
    length = np.diff(bounds)
    text, term, tf = term_counts(h, bounds)
    weight = idf(n, np.array([df.get(t, 0) for t in term.tolist()], np.float64))
    own = np.bincount(text, weight * impacts(tf, length[text], mean_length or float(length.mean()) if len(length) else 1.0), len(ids))
    run = np.array([shingles(h[a:z], np.array([0, z - a]), int(z - a))[0][0] for a, z in zip(bounds[:-1], bounds[1:])], np.uint64)
    order = np.lexsort((run, length))
    sizes = np.unique(length).tolist()
    first = {k: int(np.searchsorted(length[order], k)) for k in sizes}
    return Short([ids[i] for i in order.tolist()], own[order], {k: run[order][length[order] == k] for k in sizes}, first)


def scan_short(short: Short, doc_ids: list, h: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """One match for each document and short item whose words it holds in a row."""
    found, n = [], np.diff(bounds)
    for k, runs in short.runs.items():
        g, b = shingles(h, bounds, k)
        doc = np.repeat(np.arange(len(doc_ids)), np.diff(b))
        lo, hi = np.searchsorted(runs, g), np.searchsorted(runs, g, "right")
        for i in np.flatnonzero((hi > lo) & (n[doc] >= k)).tolist():
            for j in range(short.first[k] + int(lo[i]), short.first[k] + int(hi[i])):
                found.append((doc_ids[int(doc[i])], short.ids[j], float(short.score[j]), 1.0, 1.0))
    return found


def build_items(ids: list, texts: list[str], questions: list[str], answers: list[str], n: int, df: dict[int, int] | None, mean_length: float | None, common: float = 0.1) -> Items:
    hashed = [word_hashes(*string_buffers(pa.array(x, pa.string()))) for x in (texts, questions, answers)]
    h, bounds = hashed[0]
    length = np.diff(bounds)
    text, term, tf = term_counts(h, bounds)
    index = BlockMaxIndex(len(ids), text, term, impacts(tf, length[text], mean_length or float(length.mean()) if len(length) else 1.0), block=8)
    local = index.frequencies()
    seen = np.array([df[t] for t in index.terms.tolist()]) if df is not None else local
    weight = idf(n, seen)
    per_post = np.repeat(weight, local)
    own = np.bincount(index.text, index.impact * per_post, len(ids))
    share = index.impact * per_post / np.maximum(own[index.text], 1e-12)
    rare = np.repeat(local <= max(3, common * len(ids)), local)
    rest = np.bincount(index.text[~rare], share[~rare], len(ids))
    kept = np.bincount(np.repeat(np.arange(len(local)), local)[rare], minlength=len(local))
    sets = []
    for h, b in hashed[1:]:
        runs = [(min(3, int(z - a)), h[a:z]) for a, z in zip(b[:-1], b[1:])]
        sets.append([(k, shingles(x, np.array([0, len(x)]), k)[0] if k else x) for k, x in runs])
    return Items(ids, index, weight, own, rest, np.concatenate([[0], np.cumsum(kept)]), index.text[rare].astype(np.int64), share[rare], *sets, max(64, int(length.max()) if len(length) else 64))


def contained(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """Share of a part's word triples (shorter runs for a part of one or two words) that a passage has; 1 for an empty part."""
    k, runs = part
    return float(np.isin(runs, shingles(words, np.array([0, len(words)]), k)[0]).mean()) if k else 1.0


#: Cells of a table of segments by items that is held at once; more items than a step has room for are summed by sorting.
CELLS = 2_000_000


def _survivors(items: Items, segment: np.ndarray, term: np.ndarray, owner: np.ndarray, share: float) -> np.ndarray:
    """Numbers of the segments whose passage (it and the next of its document) some item may pass.

    segment and term: one for each known word, by rising segment; owner: the document of every segment.
    """
    count, total = len(items.ids), len(owner)
    if (items.rest >= share - 1e-9).any():
        return np.arange(total)
    size = items.first[term + 1] - items.first[term]
    p = np.repeat(items.first[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    s, item, part = np.repeat(segment, size), items.gate_item[p], items.gate_share[p]
    if total * count <= 2 * CELLS:
        bound = np.bincount(s * count + item, part, total * count).reshape(total, count)
        bound[:-1] += np.where((owner[:-1] == owner[1:])[:, None], bound[1:], 0)  # from the top down: each adds the next one's own
        return np.flatnonzero((bound + items.rest >= share - 1e-9).any(1))
    before = np.flatnonzero((s > 0) & (owner[s - 1] == owner[s]))
    key, back = np.unique(np.concatenate([s * count + item, (s[before] - 1) * count + item[before]]), return_inverse=True)
    joined = np.bincount(back, np.concatenate([part, part[before]]), len(key))
    return np.unique(key[joined + items.rest[key % count] >= share - 1e-9] // count)


def scan(items: Items, doc_ids: list, texts: pa.Array, share: float, overlap: float, words: int = 200_000) -> list[tuple]:
    """Matches of a batch of documents, one for each document and item: the passage that covers the question best."""
    return scan_words(items, doc_ids, *word_hashes(*string_buffers(texts)), share, overlap, words)


def scan_words(items: Items, doc_ids: list, h: np.ndarray, bounds: np.ndarray, share: float, overlap: float, words: int = 200_000) -> list[tuple]:
    index, found = items.index, {}
    at = np.searchsorted(index.terms, h)
    at[at == len(index.terms)] = 0
    known = index.terms[at] == h if len(index.terms) else np.zeros(len(h), bool)
    n = np.diff(bounds)
    segments = -(-n // items.stride)
    base = np.concatenate([[0], np.cumsum(segments)])
    doc = np.repeat(np.arange(len(n)), n)
    segment = base[doc] + (np.arange(len(h)) - bounds[doc]) // items.stride
    owner = np.repeat(np.arange(len(n)), segments)
    least = share * items.own
    block_least = index.block_least(least)
    count = max(1, len(items.ids))
    step = max(1, min(words // items.stride, max(64, CELLS // count)))
    for a in range(0, int(base[-1]), step):
        z = min(int(base[-1]), a + step + 1)  # one more: passages are two segments
        lo, hi = np.searchsorted(segment, [a, z])
        w = np.flatnonzero(known[lo:hi]) + lo
        for s in _survivors(items, segment[w] - a, at[w], owner[a:z], share).tolist():
            d = int(owner[a + s])
            begin = int(bounds[d]) + (a + s - int(base[d])) * items.stride
            end = min(begin + 2 * items.stride, int(bounds[d + 1]))
            terms = np.unique(h[begin:end][known[begin:end]])
            i = np.searchsorted(index.terms, terms)
            hits, score = index.search_each(terms, items.idf[i], least, block_least)
            for item, value in zip(hits.tolist(), score.tolist()):
                q, r = contained(items.question[item], h[begin:end]), contained(items.answer[item], h[begin:end])
                if q >= overlap and r >= overlap:
                    key = (d, item)
                    found[key] = max(found.get(key, (0, 0, 0)), (q, r, value))
    return [(doc_ids[d], items.ids[i], v, q, r) for (d, i), (q, r, v) in found.items()]


def write_items(prepared: DataFrame, folder: str, n: int, mean: float | None, min_words: int, shard_chars: int) -> DataFrame:
    """Index files of the items, one for each length class and about shard_chars characters of it; returns path, to be committed.

    A class spans a factor of eight in words, so that a very long item does not widen the passages of short ones.
    """
    size = F.size("words")
    kind = F.when(size < min_words, -1).otherwise(F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(64.0)) / math.log(8)).cast("int")))
    sized = prepared.withColumn("kind", kind)
    chars = {r["kind"]: int(r["chars"]) for r in sized.groupBy("kind").agg(F.sum(F.length("text")).alias("chars")).collect()}  # a few classes
    parts = F.lit(1)
    for k, total in chars.items():
        parts = F.when(F.col("kind") == k, max(1, -(-total // shard_chars))).otherwise(parts)
    shards = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), parts).cast("int"))
    frequency = prepared.filter(size >= min_words).select("item_id", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    needed = shards.select(F.col("kind").alias("of_kind"), F.col("part").alias("of_part"), F.explode("words").alias("w")).distinct().join(frequency, "w")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.select(["item_id", "text", "question", "answer"]).to_pylist(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]))
        h, _ = word_hashes(*string_buffers(right["w"]))
        df = dict(zip(h.tolist(), right["df"].to_pylist()))
        ids, texts, questions, answers = ([r[c] for r in rows] for c in ("item_id", "text", "question", "answer"))
        if not rows:
            return pa.table({"path": pa.array([], pa.string())})
        short = left["kind"][0].as_py() < 0
        held = build_short(ids, texts, n, df, mean) if short else build_items(ids, texts, questions, answers, n, df, mean)
        path = f"{folder}/{uuid.uuid4().hex}.items"
        write_bytes(path, [pickle.dumps(held)])
        return pa.table({"path": [path]})

    kept = shards.select("kind", "part", "item_id", "text", "question", "answer")
    return kept.groupBy("kind", "part").cogroup(needed.groupBy("of_kind", "of_part")).applyInArrow(build, "path string")


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.7, overlap: float = 0.6, min_words: int = 5, shard_chars: int = 32_000_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document (doc_id, text) that holds an item.

    items: item_id, text (and question, answer). Their index lies in files of at most about shard_chars characters of items
    of like length, with idf and mean length counted over all of them; documents are read and cut into words once, whatever
    the number of files, and a task holds one file at a time. Null texts are empty; items of fewer than min_words words
    match documents that hold all their words in a row, and items without a word match nothing; repeated rows match each;
    an empty table gives an empty result; very long texts are cut into passages like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    prepared = question_answer(items).withColumn("words", F.filter(F.split("text", " "), lambda w: w != "")).filter(F.size("words") > 0)
    prepared = materialize(prepared, "items")
    indexed = F.size("words") >= min_words
    total = prepared.agg(F.count_if(indexed).alias("n"), F.avg(F.when(indexed, F.size("words"))).alias("mean")).first()
    written = materialize(write_items(prepared, work_dir(spark, "item-index"), total["n"], total["mean"], min_words, shard_chars), "item-files")
    paths = sorted(r["path"] for r in written.collect())  # one for each 32 MB of items
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), plain(text_col(docs)).alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ("", None)
        for f in frames:
            step = max(1, int(f.num_rows * 4_000_000 // max(1, f.column("text").nbytes)))
            cut = [(part.column("doc_id").to_pylist(), *word_hashes(*string_buffers(part.column("text")))) for part in (f.slice(a, step) for a in range(0, f.num_rows, step))]
            for path in paths:
                if held[0] != path:
                    fs, local = open_fs(path)
                    with fs.open_input_file(local) as file:
                        held = path, pickle.loads(file.read())
                for ids, h, bounds in cut:
                    got = scan_short(held[1], ids, h, bounds) if isinstance(held[1], Short) else scan_words(held[1], ids, h, bounds, share, overlap)
                    columns = list(zip(*got)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(run, RESULT)

"""Language-model scoring by a probabilistic suffix tree over words.

The root predicts words by their smoothed counts over all training documents. The last 1, 2, ... words are a candidate context
if they occur at least ``least`` times in training, a fixed number, so the tree grows with the text. A context c keeps the next
words w seen that often after it; what is left of its places, and ``pseudo`` more, is spread by its longest retained proper
suffix: P(w | c) = (kept n(cw) + (n(c) - all kept + pseudo) * P(w | suffix)) / (n(c) + pseudo), which sums to 1. It is
retained if its next words diverge from its suffix's: the mean of log((n(cw) - 1 + pseudo * P(w | suffix)) /
((n(c) - 1 + pseudo) * P(w | suffix))) over its training places (0 for n(cw) - 1 if w is not kept) must reach
``divergence``. A text's score follows the longest retained suffix at each word. A pair is asked for only where its context
and its suffix's pair are frequent; else it can't be.

No table of the tree is ever in one place. Blocks of documents lie as files in the shared folder, and what is shuffled is
questions and answers: a block asks for its distinct keys, packed by hash bucket, with what it adds to each, and gets back
what all blocks together say. A context whose places fill a third of the text is one key a block, like any other.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, open_fs, remove, shuffle_parts, string_buffers, text_col, work_dir, write_bytes
from .words import END, M1, mix, word_hashes

#: Hash of the place before a text.
START = np.uint64(0x57A_27_0F_7E47)
#: Words of a block, about; a longer text is a block of its own.
BLOCK_WORDS = 2_000_000
ASKS = "bucket int, block long, h binary, c binary, s binary"


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with a start before and an end after every text, bounds)."""
    h, b = word_hashes(*string_buffers(texts))
    h = np.insert(h, b[1:], END)
    return np.insert(h, b[:-1] + np.arange(len(b) - 1), START), b + 2 * np.arange(len(b))


def save(path: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    data = out.getvalue()
    write_bytes(path, [len(data).to_bytes(8, "little"), pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)])


def load(path: str) -> dict[str, np.ndarray]:
    fs, name = open_fs(path)
    with fs.open_input_stream(name) as f:
        data = f.read()
    return dict(np.load(io.BytesIO(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))))


def narrow(a: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all; widen tells the size from the number of counts."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "u1").astype(np.int64)


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys with all their first bytes first, then all second ones, ...: what a shuffle compresses."""
    return keys.view(np.uint8).reshape(-1, 8)[:, ::-1].T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1)[::-1].T).view("<u8").ravel()


def grams(h: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` words that end at each place; no use where they begin before the text."""
    g = h
    for _ in range(depth - 1):
        longer = h.copy()
        longer[1:] = mix((g[:-1] * M1) ^ h[1:])
        g = longer
    return g


def questions(block: int, keys: np.ndarray, count: np.ndarray, total: np.ndarray | None, buckets: int) -> pa.Table:
    """One row for each bucket: sorted keys, what the block has of each, and a sum to go with it."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    rows = []
    for i in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[i], cut[i + 1])
        rows.append((i, block, planes(keys[part]), narrow(count[part]), b"" if total is None else total[part].tobytes()))
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["bucket", "block", "h", "c", "s"])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def answers_of(asks: DataFrame, parts: int, summed: bool = False) -> DataFrame:
    """block, bucket, a (an answer for each key asked), n and v (occurrences and distinct keys with one, in one row a bucket).

    The answer is the key's count over all blocks; with ``summed`` it is that count and one if its sum isn't negative, else 0.
    """

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")  # sums of floats are taken in one order
        h = [from_planes(x) for x in t["h"].to_pylist()]
        keys, back = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(back, np.concatenate([widen(c, len(x)) for c, x in zip(t["c"].to_pylist(), h)]), len(keys)).astype(np.int64)
        told = n
        if summed:
            told = np.where(np.bincount(back, np.frombuffer(b"".join(t["s"].to_pylist()), "<f4"), len(keys)) >= 0, n + 1, 0)
        cut = np.cumsum([len(x) for x in h])[:-1]
        once = np.zeros(t.num_rows, np.int64)
        once[0] = 1
        return pa.table({
            "block": t["block"], "bucket": t["bucket"], "a": pa.array([narrow(x) for x in np.split(told[back], cut)], pa.binary()),
            "n": once * n.sum(), "v": once * np.count_nonzero(n), "k": [len(x) for x in h],
        })

    return asks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(add, "block long, bucket int, a binary, n long, v long, k long")


def told(t: pa.Table) -> np.ndarray:
    """A block's answers in the order of its sorted keys."""
    t = t.sort_by("bucket")
    return np.concatenate([np.zeros(0, np.int64), *(widen(a, k) for a, k in zip(t["a"].to_pylist(), t["k"].to_pylist()))])


class Block:
    """A block's words and, at some level, what is known of each place: its last words' count and its probability."""

    def __init__(self, root: str, block: int, level: int | None = None, total: int = 0):
        self.root, self.block = root, block
        own = load(f"{root}/words/{block}")
        self.b, self.learned_docs, self.doc_id, self.no_id = own["b"], own["learned"], own["doc_id"], own["no_id"]
        self.words, self.tokens = own["words"], own["tokens"]
        self.h = self.words[self.tokens]
        n = np.diff(self.b)
        self.at = np.arange(len(self.h)) - np.repeat(self.b[:-1], n)
        self.learned = np.repeat(self.learned_docs, n)
        if level == 0:  # a word says it all
            self.count = self.read("level-0")["count"][self.tokens]
            self.logp = np.log10((self.count + 1) / total)
        elif level:
            self.count, self.logp = self.read(f"pairs-{level}")["count"], self.read(f"level-{level}")["logp"].astype(np.float64)

    def read(self, name: str) -> dict[str, np.ndarray]:
        return load(f"{self.root}/{name}/{self.block}")

    def save(self, name: str, **arrays: np.ndarray) -> None:
        if "count" in arrays:
            arrays["count"] = arrays["count"].astype(np.min_scalar_type(int(arrays["count"].max(initial=0))))
        save(f"{self.root}/{name}/{self.block}", **arrays)

    def ask_words(self, buckets: int) -> pa.Table:
        said = self.words != START
        n = np.bincount(self.tokens, self.learned, len(self.words)).astype(np.int64)
        return questions(self.block, self.words[said], n[said], None, buckets)

    def candidates(self, depth: int, least: int) -> np.ndarray:
        """Places whose last ``depth`` words, the start included, are frequent enough in training."""
        at = np.flatnonzero(self.at >= depth)
        return at[self.count[at - 1] >= least]

    def pairs(self, depth: int, least: int) -> np.ndarray:
        """Those of the candidates whose word is frequent enough after the context's suffix, too."""
        at = self.candidates(depth, least)
        return at[self.count[at] >= least]

    def ask_pairs(self, depth: int, least: int, buckets: int) -> pa.Table:
        at = self.pairs(depth, least)
        keys, back = np.unique(grams(self.h, depth + 1)[at], return_inverse=True)
        return questions(self.block, keys, np.bincount(back, self.learned[at], len(keys)).astype(np.int64), None, buckets)

    def sums(self) -> pa.Table:
        """A row for each document."""
        base = self.read("base")
        score = np.add.reduceat(np.where(self.at > 0, self.logp, 0), self.b[:-1])
        return pa.table([pa.array(self.doc_id, mask=self.no_id), pa.array(np.diff(self.b) - 1), pa.array(base["count"].astype(np.int64)), pa.array(base["base"]), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def write_blocks(rows: DataFrame, root: str) -> DataFrame:
    """Write the documents (doc_id, text, learned) of each task as block files; the blocks' numbers."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            block = (task << 32) + made
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            words, tokens = np.unique(h, return_inverse=True)
            save(
                f"{root}/words/{block}", words=words, tokens=tokens.astype(np.uint32), b=np.concatenate([[0], np.cumsum(n)]),
                learned=np.concatenate([x[2] for x in held]), doc_id=np.concatenate([x[3] for x in held]), no_id=np.concatenate([x[4] for x in held]),
            )
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([block])], ["block"])

        for f in frames:
            step = max(1, int(f.num_rows * 8_000_000 // max(1, f.column("text").nbytes)))
            for a in range(0, f.num_rows, step):
                part = f.slice(a, step)
                h, b = sequences(part.column("text"))
                ids = part.column("doc_id")
                held.append((h, np.diff(b), part.column("learned").to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
                size += len(h)
                if size >= BLOCK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return materialize(rows.mapInArrow(run, "block long"), "blocks")


def written(df: DataFrame, name: str) -> DataFrame:
    """materialize, with the shuffles' files deleted when the step is written: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before) if before else conf.unset(key)


def is_held_out(doc_id, parts: int = 7, kept: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == kept, F.lit(False))


def score_texts(docs: DataFrame, max_depth: int = 3, least: int = 2, pseudo: float = 5.0, divergence: float = 0.01) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (doc_id, text).

    Held-out documents (crc32 of doc_id's text mod 7 is 2) are scored and not learned from. Null texts are empty and are
    one end token; null ids are learned from; repeated rows count each time; words are kept apart by 64-bit hashes. With
    nothing to learn from, train_tokens is 0 and both scores are 0. Other columns are ignored. Contexts of up to
    ``max_depth`` words are looked at, fewer where none of that length is frequent enough.
    """
    spark = docs.sparkSession
    root = work_dir(spark, "suffix-tree")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"))
    blocks = write_blocks(rows.withColumn("learned", ~is_held_out(F.col("doc_id"))), root)
    number = blocks.count()
    buckets, parts = max(16, 2 * number), max(shuffle_parts(spark), number)

    def each_block(answers: DataFrame, step: Callable[[int, np.ndarray], pa.Table]) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return step(left["block"][0].as_py(), told(right))

        return blocks.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(run, ASKS)

    def of_blocks(rows_of: Callable[[int], pa.Table], schema: str) -> DataFrame:
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                for i in f.column("block").to_pylist():
                    yield from rows_of(i).to_batches()

        return blocks.repartition(parts, "block").mapInArrow(run, schema)

    answers = written(answers_of(of_blocks(lambda i: Block(root, i).ask_words(buckets), ASKS), parts), "words-told")
    totals = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    N, V = int(totals["n"] or 0), int(totals["v"] or 0)
    total = N + V + 1

    def words_told(i: int, count: np.ndarray) -> pa.Table:
        own = Block(root, i)
        c = np.zeros(len(own.words), np.int64)
        c[own.words != START] = count
        c[own.words == START] = c[own.words == END]  # as many starts as ends
        own.save("level-0", count=c)
        own.count, said = c[own.tokens], own.at > 0
        base = np.add.reduceat(np.where(said, np.log10((own.count + 1) / total), 0.0), own.b[:-1])
        own.save("base", count=np.add.reduceat(((own.count > 0) & said).astype(np.int64), own.b[:-1]), base=base)
        return own.ask_pairs(1, least, buckets)

    def pairs_told(depth: int) -> Callable[[int, np.ndarray], pa.Table]:
        def step(i: int, count: np.ndarray) -> pa.Table:
            own = Block(root, i, depth - 1, total)
            asked, g = own.pairs(depth, least), grams(own.h, depth)
            longer = np.concatenate([own.h[:1], mix((g[:-1] * M1) ^ own.h[1:])])
            known = np.zeros(len(own.h), np.int64)
            known[asked] = count[np.unique(longer[asked], return_inverse=True)[1]]
            known[known < least] = 0
            own.save(f"pairs-{depth}", count=known)
            at = own.candidates(depth, least)
            pair, learned, n, below = known[at], own.learned[at], own.count[at - 1], pseudo * 10 ** own.logp[at]
            gain = np.where(learned, np.log((np.maximum(pair - 1, 0) + below) * (pseudo / (n - 1 + pseudo)) / below) - divergence, 0)
            keys, back = np.unique(g[at - 1], return_inverse=True)
            return questions(i, keys, np.bincount(back, learned & (pair > 0), len(keys)).astype(np.int64), np.bincount(back, gain, len(keys)).astype("<f4"), buckets)

        return step

    def contexts_told(depth: int) -> Callable[[int, np.ndarray], pa.Table]:
        def step(i: int, count: np.ndarray) -> pa.Table:
            own = Block(root, i, depth - 1, total)
            at, pair = own.candidates(depth, least), own.read(f"pairs-{depth}")["count"]
            kept = count[np.unique(grams(own.h, depth)[at - 1], return_inverse=True)[1]]
            at, kept = at[kept > 0], kept[kept > 0] - 1
            n = own.count[at - 1]
            own.logp[at] = np.log10((pair[at] + (n - kept + pseudo) * 10 ** own.logp[at]) / (n + pseudo))
            own.count = pair
            own.save(f"level-{depth}", logp=own.logp.astype(np.float32))
            return own.ask_pairs(depth + 1, least, buckets) if depth < max_depth else questions(i, own.h[:0], own.h[:0], None, buckets)

        return step

    def round_of(before: DataFrame, step: Callable[[int, np.ndarray], pa.Table], name: str, summed: bool = False) -> DataFrame:
        after = written(answers_of(each_block(before, step), parts, summed), name)
        discard(before)
        return after

    level = 0
    answers = round_of(answers, words_told, "pairs-told-1")
    while level < max_depth and answers.head(1):
        answers = round_of(answers, pairs_told(level + 1), f"contexts-told-{level + 1}", True)
        level += 1
        answers = round_of(answers, contexts_told(level), f"pairs-told-{level + 1}")
        remove(spark, f"{root}/level-{level - 1}", f"{root}/pairs-{level - 1}")

    found = of_blocks(lambda i: Block(root, i, level, total).sums(), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    value = lambda c: (F.col(c) if N else F.lit(0.0)).alias(c)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), value("base_score"), value("score"))

"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing only looks at lengths, so the exact global packing is found from the histogram of piece lengths (at
most ``capacity`` rows, whatever the corpus): a segment tree over remaining capacities gives the tightest open sequence for
a length in logarithmic time, and pieces of one length that would go the same way go together. The moves it finds are
applied to the distributed pieces by their rank within their length. Ranks come from counts per task and length, so a
length that a third of all pieces share is no hot group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize
from .memo_tokens import MemoTokenizer, batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class Capacities:
    """Segment tree over remaining capacities 0..capacity: which of them have an open sequence."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.has = bytearray(2 * self.leaves)

    def set(self, i: int, on: bool) -> None:
        i += self.leaves
        self.has[i] = on
        while i > 1:
            i >>= 1
            self.has[i] = self.has[2 * i] | self.has[2 * i + 1]

    def tightest(self, least: int) -> int:
        """Smallest remaining capacity of at least ``least`` with an open sequence, or -1."""
        i = least + self.leaves
        if self.has[i]:
            return least
        while i > 1:
            if not i & 1 and self.has[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.has[2 * i])
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_moves(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, pieces in each, offset in each) of best-fit decreasing.

    Pieces of a row's length with ranks from its first rank on fill its sequences one after another. There is no row for
    a single piece: sequences with the same content stay one group until a length runs out within them.
    """
    tree, open_ = Capacities(capacity), {}
    moves, sequences = [], 0

    def put(left: int, group: list[int]) -> None:
        if left:
            at = open_.setdefault(left, [])
            if not at:
                tree.set(left, True)
            if at and at[-1][0] + at[-1][1] == group[0]:
                at[-1][1] += group[1]
            else:
                at.append(group)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            left = tree.tightest(length)
            if left < 0:
                per = capacity // length
                full, rest = divmod(count, per)
                for n, m in ((full, per), (1 if rest else 0, rest)):
                    if n:
                        moves.append((length, rank, sequences, n, m, 0))
                        put(capacity - m * length, [sequences, n])
                        rank, sequences = rank + n * m, sequences + n
                break
            groups, per = open_[left], left // length
            first, n = groups[-1]
            full = min(n, count // per)
            m = per if full else count
            full = full or 1
            if full == n:
                groups.pop()
                if not groups:
                    del open_[left]
                    tree.set(left, False)
            else:
                groups[-1] = [first + full, n - full]
            moves.append((length, rank, first, full, m, capacity - left))
            put(left - m * length, [first, full])
            rank, count = rank + full * m, count - full * m
    return np.array(moves, np.int64).reshape(-1, 6)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document: only documents longer than capacity are cut, every capacity tokens."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, seen = MemoTokenizer.of(tokenizer_path, True), TaskContext.get().partitionId(), {}
        try:
            for frame in frames:
                ids, texts = frame.column("doc_id").to_pylist(), frame.column("text").to_pylist()
                rows: list[tuple] = []
                for a, b in batches(texts):
                    for doc, got in zip(ids[a:b], tokenizer.encode(texts[a:b])):
                        got += end
                        for piece, at in enumerate(range(0, len(got), 4 * capacity)):
                            part = got[at : at + 4 * capacity]
                            n = len(part) // 4
                            nth = seen.get(n, 0)
                            seen[n] = nth + 1
                            rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, nth))
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            tokenizer.release()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, PIECES)


def pack_best_fit(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of PIECES; (task, length, nth) names a piece).

    Exact best-fit decreasing over all pieces. An empty table gives an empty result; repeated rows are packed each.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    moves = best_fit_moves(sizes, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["length", "task"])  # a row for each length and task: more than a broadcast may hold
    plan = spark.sparkContext.broadcast(moves)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = plan.value
        keys = -m[:, 0] << 40 | m[:, 1]  # moves are in order of falling length and rising rank
        for frame in frames:
            length, rank = (frame.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, -length << 40 | rank, "right") - 1
            within = rank - m[i, 1]
            sequence, offset = m[i, 2] + within // m[i, 4], m[i, 5] + within % m[i, 4] * length
            kept = [frame.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    picked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return picked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise documents (doc_id, text; null text is the empty text) and pack their pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. The pieces are written once, so each document
    is tokenised once. Null doc_id stays null; a document without text is the end id alone; other columns are ignored.
    """
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack_best_fit(pieces, capacity)

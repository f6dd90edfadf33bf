"""Token ids in binary files, compressed by Re-Pair grammars with random access.

A shard holds whole documents in ascending doc_id order. Frequent id pairs are replaced by nonterminals, round after round,
until no pair is frequent any more: a round counts the pairs of the places that the round before it touched, and where
frequent pairs overlap, the more frequent one takes the place; in a run of one id every second pair counts. No pair contains
the end id, so every document starts at a symbol of its own. A file stores the rules with the number of ids each expands to,
the symbols, and where each document starts in ids and in symbols: one document is decoded from its own symbols alone.

File: magic, five counts as 64-bit integers (documents, rules, symbols, first nonterminal, bytes a symbol: 2, 3 or 4), then
doc_ids, null flags, id starts, symbol starts, rules (pairs), expansion lengths, the symbols' low 16 bits, and what is above
them in a column of its own; all little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, open_fs, shuffle_parts, text_col, work_dir, write_bytes
from .memo_tokens import MemoTokenizer, batches

MAGIC = b"WLGRAM02"
#: Byte-level ids stay below this; nonterminals follow, or follow the largest id where that is larger.
FIRST_NONTERMINAL = 50257
MANIFEST = "part int, nth int, path string, docs long, ids long, symbols long"


def _count_pairs(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that occur least times, which of them each place has, their counts, places that have one).

    Pairs are counted by hash slot first; in a slot that is full enough one pair stands for the slot, and only places with
    another pair in such a slot are sorted.
    """
    slot = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(12)
    full = np.bincount(slot, minlength=1 << 20) >= least
    some = np.flatnonzero(full[slot])
    of = (np.cumsum(full, dtype=np.int32) - 1)[slot[some]]
    key = left[some].astype(np.uint64) << np.uint64(32) | right[some]
    pairs = np.zeros(int(full.sum()), np.uint64)
    pairs[of] = key
    other = np.flatnonzero(pairs[of] != key)
    more, back = np.unique(key[other], return_inverse=True)
    of[other] = len(pairs) + back
    pairs = np.concatenate([pairs, more])
    count = np.bincount(of, minlength=len(pairs))
    frequent = count >= least
    keep = frequent[of]
    return pairs[frequent], (np.cumsum(frequent, dtype=np.int32) - 1)[of[keep]], count[frequent], some[keep]


def grammar(ids: np.ndarray, first: int = FIRST_NONTERMINAL, end_id: int = 0, least: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[i] is the pair that symbol first + i stands for. least: occurrences that make a pair frequent.

    In the end no pair without the end id occurs ``least`` times, not counting overlaps in runs of one symbol. ids must
    be below first.
    """
    s, rules, made = ids.astype(np.uint32), [], 0
    live = np.arange(max(0, len(s) - 1), dtype=np.int32)  # places whose pair may be frequent
    while len(live) >= least:
        left, right = (s[live], s[live + 1]) if made else (s[:-1], s[1:])
        inner = (left != end_id) & (right != end_id)
        live, left, right = live[inner], left[inner], right[inner]
        # whether a place and the next hold one pair: within a run every second place counts
        run = np.zeros(len(live), bool)
        run[1:] = (left[1:] == right[1:]) & (left[:-1] == left[1:]) & (live[1:] == live[:-1] + 1)
        if run.any():
            at = np.arange(len(live), dtype=np.int32)
            odd = (at - np.maximum.accumulate(np.where(run, 0, at))) & 1 == 1
            live, left, right = live[~odd], left[~odd], right[~odd]
        pairs, of, count, some = _count_pairs(left, right, least)
        if not len(pairs):
            break
        at, rank = live[some], np.empty(len(pairs), np.int32)
        rank[np.lexsort((pairs, -count))] = np.arange(len(pairs), dtype=np.int32)
        mine = rank[of]
        beside = at[1:] == at[:-1] + 1
        less = mine[1:] < mine[:-1]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | less
        wins[:-1] &= ~(beside & less)
        enough = np.bincount(of[wins], minlength=len(pairs)) >= least  # the most frequent pair wins everywhere
        wins &= enough[of]
        number = (np.cumsum(enough) - 1 + first + made).astype(np.uint32)
        won, lost = at[wins], at[~wins]
        s[won] = number[of[wins]]
        rules.append(pairs[enough])
        made += int(enough.sum())
        keep = np.ones(len(s), bool)
        keep[won + 1] = False
        s = s[keep]
        new = won - np.arange(len(won), dtype=np.int32)  # each replacement before a place takes one symbol away
        touched = np.zeros(len(s) + 1, bool)
        touched[lost - np.searchsorted(won, lost)] = True
        touched[new] = True
        touched[np.maximum(new - 1, 0)] = True
        live = np.flatnonzero(touched[: max(0, len(s) - 1)]).astype(np.int32)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return s, np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids of every nonterminal; a rule only names ids and earlier rules."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.int64)


#: Nonterminals of at most so many ids are expanded at once by a table; longer ones are split into their pairs first.
SHORT = 4096


class Expander:
    """Turns symbols into the ids they stand for."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int):
        self.rules, self.first = rules, first
        self.long = np.concatenate([np.zeros(first, bool), lengths > SHORT])
        self.some_long = bool(self.long.any())
        short: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(lengths <= SHORT).tolist():
            short[i] = np.concatenate([short[x - first] if x >= first else np.array([x], np.uint32) for x in rules[i].tolist()])
        self.lengths = np.ones(first + len(lengths), np.int32)
        self.begin = np.arange(first + len(lengths), dtype=np.int32)
        at = first
        for i, x in short.items():
            self.lengths[first + i], self.begin[first + i] = len(x), at
            at += len(x)
        self.every = np.concatenate([np.arange(first, dtype=np.uint32), *short.values()])  # an id stands for itself

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.rules):
            return symbols.astype(np.uint32)
        while self.some_long and (long := self.long[symbols]).any():
            n = 1 + long.astype(np.int64)
            symbols = np.repeat(symbols, n)
            second = np.cumsum(n)[long] - 1
            pair = self.rules[symbols[second] - self.first]
            symbols[second - 1], symbols[second] = pair[:, 0], pair[:, 1]
        n = self.lengths[symbols]
        ends = np.cumsum(n, dtype=np.int32)
        return self.every[np.repeat(self.begin[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]


def encode_shard(docs: list[int | None], ids: list[bytes], end_id: int = 0, least: int = 64) -> tuple[list[bytes], int, int]:
    """(the file's parts, number of ids, number of symbols); each document's ids get the end id."""
    end = int(end_id).to_bytes(4, "little")
    flat = np.frombuffer(b"".join(x for doc in ids for x in (doc, end)), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 + 1 for x in ids])]).astype("<i8")
    first = max(FIRST_NONTERMINAL, int(flat.max()) + 1 if len(flat) else 0)
    symbols, rules = grammar(flat, first, end_id, least)
    lengths = expansion_lengths(rules, first)
    n = np.concatenate([np.ones(first, np.int64), lengths])[symbols]
    symbol_starts = np.searchsorted(np.concatenate([[0], np.cumsum(n)]), starts).astype("<i8")
    width = 2 if first + len(rules) <= 1 << 16 else 3 if first + len(rules) <= 1 << 24 else 4
    head = np.array([len(docs), len(rules), len(symbols), first, width], "<i8")
    high = (symbols >> np.uint32(16)).astype("u1" if width == 3 else "<u2").tobytes() if width > 2 else b""
    parts = [
        MAGIC, head.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), starts.tobytes(), symbol_starts.tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), high,
    ]
    return parts, len(flat), len(symbols)


class Shard:
    """Random access to one file's documents."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        n, rules, symbols, self.first, width = np.frombuffer(raw, "<i8", 5, 8).tolist()
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.doc_ids, self.null, self.starts, self.symbol_starts = take("<i8", n), take("u1", n), take("<i8", n + 1), take("<i8", n + 1)
        self.rules, self.lengths, self.symbols = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules), take("<u2", symbols).astype(np.uint32)
        if width > 2:
            self.symbols |= take("u1" if width == 3 else "<u2", symbols).astype(np.uint32) << np.uint32(16)
        self.expander = Expander(self.rules, self.lengths, self.first)

    def document(self, i: int) -> np.ndarray:
        return self.expander.ids(self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]])

    def all_ids(self) -> np.ndarray:
        return self.expander.ids(self.symbols)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, shard_ids: int = 4_000_000) -> DataFrame:
    """Write the ids of all documents (doc_id, text) and return the committed manifest of shards with their first id.

    Documents are in ascending order of doc_id, rows that share a doc_id in order of their texts' hashes; null doc_id comes
    first; null text is empty; a repeated row is a document each; other columns are ignored; an empty table has no shard.
    Shards close at shard_ids ids, whatever a task holds, and never cut a document. Rows of one doc_id are spread over
    tasks by their place in the input, so many of them are no hot key.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, nth, held = MemoTokenizer.of(tokenizer_path, False), TaskContext.get().partitionId(), 0, 0
        names, ids = [], []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held, names, ids
            path = f"{folder}/{part:06d}-{nth:06d}-{uuid.uuid4().hex[:12]}.ids"
            parts, n, symbols = encode_shard(names, ids, end_id)
            write_bytes(path, parts)
            row = [part], [nth], [path], [len(names)], [n], [symbols]
            nth, held, names, ids = nth + 1, 0, [], []
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "nth", "path", "docs", "ids", "symbols"])

        try:
            for frame in frames:
                doc_ids, texts = frame.column("doc_id").to_pylist(), frame.column("text").to_pylist()
                for a, b in batches(texts):
                    for doc, got in zip(doc_ids[a:b], tokenizer.encode(texts[a:b])):
                        names.append(doc)
                        ids.append(got)
                        held += len(got) // 4 + 1
                        if held >= shard_ids:
                            yield flush()
            if names:
                yield flush()
        finally:
            tokenizer.release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", F.xxhash64("text"), "place"]
    rows = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = materialize(rows.mapInArrow(write, MANIFEST), "token-shards")
    totals = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(bases, "part").withColumn("first_id", F.col("base") + F.coalesce(F.sum("ids").over(within), F.lit(0))).drop("base")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the manifest's shards, decoded from the files."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, first in zip(frame.column("path").to_pylist(), frame.column("first_id").to_pylist()):
                fs, local = open_fs(path)
                with fs.open_input_file(local) as f:
                    shard = Shard(f.read())
                ids = memoryview(shard.all_ids().astype("<u4").tobytes())
                bounds = (4 * shard.starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                columns = [pa.array(shard.doc_ids, pa.int64(), mask=shard.null.astype(bool)), pa.array(shard.starts[:-1] + first), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    each = manifest.select("path", "first_id").repartition(shuffle_parts(spark), "path")
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

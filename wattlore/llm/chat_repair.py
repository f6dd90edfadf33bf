"""Repair of conversation structure: the cheapest edits that make roles read (s?(ua)+)?, by rank-convergence parallel Viterbi.

Rows are sorted by conversation and turn over all partitions. The part of a conversation that lies in one partition is a
chunk. Conversations that lie in one partition wholly are solved on the spot. Chunks of others start from speculative costs
after their last row; fix-up passes give each the costs of the next chunk, and run it again until old and new costs
differ only by a constant, until no chunk has anything to run. Stitched costs then drive the trace of the edits, first as a
map of states for each chunk, then from the state that the chunks before it lead to. Only two chunks of a partition can be
open, so chunks' costs are a table of that size; texts are shipped once more for open chunks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialize, shuffle_parts
from .sorted_runs import runs, sort_conversations
from .viterbi import CUT, GONE, GUESS, LAST, NEXT, USER, alike, first_pass, fix_up, trace

_SPACE = " \t\n\x0b\x0c\r"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, piece int, turns array<long>, roles array<string>, texts array<string>, codes binary, digests array<binary>"
_LEGAL = {"su", "ua", "au"}


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: turns with faults by crc32(conv_id:turn) % 20.

    0 marks the row lost, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. Null roles,
    texts and, in the number, null ids and turns are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(k <= 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"), (k == 0).alias("lost"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def row_code(role: Column, text: Column) -> Column:
    """The byte of viterbi.py for a row, but for duplicates; bit 16: blank."""
    end = F.rtrim(text, F.lit(_SPACE))
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(end == "", GONE + 16).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return (kind + fault).cast("int")


class Repaired:
    """One conversation's counts, audit and repaired text, fed with its rows in order, in any number of parts."""

    def __init__(self) -> None:
        self.sha, self.any, self.audit = hashlib.sha256(), False, []
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def insert(self, state: int, n: int) -> int:
        for _ in range(n):
            state = int(NEXT[state])
            self._line("user" if state == USER else "assistant", "")
        self.audit.append("I" * n)
        self.cost += 2 * n
        return state

    def feed(self, turns, roles, texts, codes, inserted, letters, came) -> None:
        for turn, role, text, code, n, letter, state in zip(turns, roles, texts, codes, inserted, letters, came):
            if turn is not None and turn == turn:
                self.low = turn if self.low is None else self.low
                self.turns += self.high is None or turn != self.high
                self.high = turn
            initial = role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
            self.initial = initial
            self.blank += code & 16 > 0
            self.duplicate += code & GONE > 0 and not code & 16
            self.truncated += code & CUT > 0
            if n:
                state = self.insert(state, n)
            if letter == 68:
                self.cost += 3
            else:
                self.cost += code & CUT > 0
                if letter == 82:
                    self.cost += 2
                    role = "user" if NEXT[state] == USER else "assistant"
                self._line(role, text)
            self.audit.append(chr(letter))

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _mark(codes: np.ndarray, again: np.ndarray) -> np.ndarray:
    """codes where rows seen before are duplicates, and no longer truncated; blank ones stay blank."""
    return np.where(again & ((codes & 16) == 0), (codes & ~CUT) | GONE, codes).astype(np.uint8)


def _solve_whole(t: pa.Table) -> list[tuple]:
    """Results of whole conversations, sorted rows of many."""
    f = t.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    key = f["conv_id"].fillna(0).to_numpy(np.int64)
    none = f["conv_id"].isna().to_numpy()
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (none[1:] != none[:-1])])
    group = np.cumsum(first) - 1
    live = ~f["lost"].to_numpy(bool)
    ids = [None if x else int(k) for k, x in zip(key[first], none[first])]
    f, group = f[live], group[live]
    codes = _mark(f["code"].to_numpy().astype(np.int64), pd.DataFrame({"g": group, "r": f["role"].to_numpy(), "t": f["text"].to_numpy()}).duplicated().to_numpy())
    bounds = np.searchsorted(group, np.arange(len(ids) + 1))
    n = len(ids)
    inserted, letter, came, more, state = trace(codes, bounds, np.repeat(LAST[None, :], n, 0), np.zeros(n, np.int64), np.ones(n, bool))
    turns = [None if x is pd.NA else int(x) for x in f["turn"]]
    cols = (turns, f["role"].tolist(), f["text"].tolist(), codes.tolist(), inserted.tolist(), letter.tolist(), came.tolist())
    out = []
    for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        one = Repaired()
        one.feed(*(c[a:z] for c in cols))
        one.insert(int(state[i]), int(more[i]))
        out.append(one.row(ids[i]))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _sweep(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """One pass over the sorted rows: results of conversations that lie in a partition, pieces of the others."""
    ddl = f"{_RESULT}, {_PIECE}"
    schema = _arrow(rows.sparkSession, ddl)
    kinds = [f.type for f in schema]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        for t, edge in runs(batches, "conv_id", most_rows, most_bytes):
            if not edge:
                done = _solve_whole(t)
                cols = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
                yield pa.RecordBatch.from_arrays(cols + [pa.nulls(len(done), k) for k in kinds[len(cols) :]], schema=schema)
                continue
            live = t.filter(pa.compute.invert(t["lost"]))
            roles, texts = live["role"].to_pylist(), live["text"].to_pylist()
            digests = [_digest(r, x) for r, x in zip(roles, texts)]
            seen: dict[bytes, int] = {}
            again = np.array([seen.setdefault(d, i) != i for i, d in enumerate(digests)], bool)
            codes = _mark(live["code"].to_numpy().astype(np.int64), again)
            row = (t["conv_id"][0].as_py(), *[None] * 8, part, piece, live["turn"].to_pylist(), roles, texts, codes.tobytes(), [None if x else d for d, x in zip(digests, again)])
            yield _batch([row], schema)
            piece += 1

    return rows.mapInArrow(sweep, ddl)


def _chunks(pieces: DataFrame) -> DataFrame:
    """conv_id, part, codes, last, solo: a row for each chunk of the open conversations, duplicates over all pieces marked."""
    slim = pieces.select("conv_id", "part", "piece", F.posexplode("digests").alias("at", "digest")).filter("digest is not null")
    order = Window.partitionBy("conv_id", "digest").orderBy("part", "piece", "at")
    repeats = slim.withColumn("n", F.row_number().over(order)).filter("n > 1")
    repeats = repeats.groupBy("conv_id", "part", "piece").agg(F.collect_list("at").alias("again"))  # at most the rows of a piece
    same = F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.part") == F.col("r.part")) & (F.col("p.piece") == F.col("r.piece"))
    own = pieces.select("conv_id", "part", "piece", "codes").alias("p").join(repeats.alias("r"), same, "left").select("p.*", "r.again")

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        parts = []
        for c, again in zip(t["codes"].to_pylist(), t["again"].to_pylist()):
            mark = np.zeros(len(c), bool)
            mark[again or []] = True
            parts.append(_mark(np.frombuffer(c, np.uint8).astype(np.int64), mark).tobytes())
        return pa.table({"conv_id": t["conv_id"].slice(0, 1), "part": t["part"].slice(0, 1), "codes": pa.array([b"".join(parts)], pa.binary())})

    chunks = own.groupBy("conv_id", "part").applyInArrow(gather, "conv_id long, part int, codes binary")
    return chunks.withColumn("last", F.lead("part").over(Window.partitionBy("conv_id").orderBy("part")).isNull())


_COSTS = "used array<long>, start array<long>, settled boolean"


def _stitch(chunks: DataFrame) -> DataFrame:
    """chunks with end: the costs after each chunk's last row, up to a constant for a conversation."""
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used = [(LAST if x else GUESS).tolist() for x in b.column("last").to_pylist()]
            start = [first_pass(np.frombuffer(c, np.uint8), np.array(u)).tolist() for c, u in zip(b.column("codes").to_pylist(), used)]
            wide = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(used, wide), pa.array(start, wide), pa.array([False] * len(used))], [*b.schema.names, "used", "start", "settled"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, used, start, end in zip(*(b.column(x).to_pylist() for x in ("codes", "used", "start", "end"))):
                if end is None or alike(used, end):
                    out.append((used, start, True))
                else:
                    out.append((end, fix_up(np.frombuffer(c, np.uint8), used, start, end)[0].tolist(), False))
            used, start, settled = zip(*out) if out else ((), (), ())
            wide = pa.list_(pa.int64())
            names = ["conv_id", "part", "codes", "last", "used", "start", "settled"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:4]), pa.array(used, wide), pa.array(start, wide), pa.array(settled, pa.bool_())], names)

    ddl = f"conv_id long, part int, codes binary, last boolean, {_COSTS}"
    now = materialize(chunks.mapInArrow(guess, ddl), "costs")
    after = F.lead("start").over(Window.partitionBy("conv_id").orderBy("part"))
    while now.filter("not settled").head(1):
        new = materialize(now.withColumn("end", after).mapInArrow(again, ddl), "costs")
        discard(now)
        now = new
    return now


def _traces(costs: DataFrame) -> DataFrame:
    """conv_id, part, last, codes, trace (four bytes' arrays), more: every chunk's edits from the state that it is reached in."""
    every = np.arange(4)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = []
            for c, end, last in zip(*(b.column(x).to_pylist() for x in ("codes", "used", "last"))):
                codes = np.tile(np.frombuffer(c, np.uint8), 4)
                to.append(trace(codes, np.arange(5) * len(c), np.repeat([end], 4, 0), every, np.zeros(4, bool))[4].tolist())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(to, pa.list_(pa.int32()))], ["conv_id", "part", "to"])

    mapped = costs.mapInArrow(maps, "conv_id long, part int, to array<int>")
    # at most a row for each partition in a conversation's list
    listed = mapped.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "to"))).alias("maps"))
    first = F.array(F.lit(0))
    states = F.aggregate("maps", first, lambda acc, m: F.concat(acc, F.array(F.get(m["to"], F.element_at(acc, -1)))))
    zipped = F.arrays_zip(F.col("maps.part").alias("part"), states.alias("state"))
    reached = listed.select("conv_id", F.explode(zipped).alias("x")).filter("x.part is not null").select("conv_id", F.col("x.part").alias("part"), F.col("x.state").alias("state"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, end, last, state in zip(*(b.column(x).to_pylist() for x in ("codes", "used", "last", "state"))):
                codes = np.frombuffer(c, np.uint8)
                inserted, letter, came, more, to = trace(codes, np.array([0, len(c)]), np.array([end]), np.array([state]), np.array([last]))
                out.append((inserted.tobytes() + letter.tobytes() + came.tobytes(), int(more[0]), int(to[0])))
            traced, more, to = zip(*out) if out else ((), (), ())
            names = ["conv_id", "part", "codes", "trace", "more", "ends_in"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:3]), pa.array(traced, pa.binary()), pa.array(more, pa.int32()), pa.array(to, pa.int32())], names)

    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.part") == F.col("r.part"))
    joined = costs.alias("c").join(reached.alias("r"), same).select("c.*", "r.state")
    return joined.mapInArrow(follow, "conv_id long, part int, codes binary, trace binary, more int, ends_in int")


def _finish(pieces: DataFrame, traces: DataFrame) -> DataFrame:
    """Results of open conversations: their pieces pass through once, in order, each chunk's edits before its pieces."""
    schema = _arrow(pieces.sparkSession, _RESULT)
    columns = ["conv_id", "part", "piece", "turns", "roles", "texts", "codes", "trace", "more", "ends_in"]
    rows = pieces.drop("digests", "codes").unionByName(traces.withColumn("piece", F.lit(-1)), allowMissingColumns=True).select(*columns)
    ordered = rows.repartition(shuffle_parts(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = finish  # no conversation yet
        one, tail, out = Repaired(), (0, 0), []
        codes = edits = None
        for b in batches:
            for i in range(b.num_rows):
                conv, _, piece, turns, roles, texts, code, traced, more, to = (b.column(c)[i].as_py() for c in columns)
                if conv != at or at is finish:
                    if at is not finish:
                        one.insert(*tail)
                        out.append(one.row(at))
                    at, one = conv, Repaired()
                if piece < 0:
                    codes, edits, tail, done = code, np.frombuffer(traced, np.uint8).reshape(3, -1), (to, more), 0
                    continue
                n = len(texts)
                one.feed(turns, roles, texts, codes[done : done + n], *(e[done : done + n].tolist() for e in edits))
                done += n
            if out:
                yield _batch(out, schema)
                out = []
        if at is not finish:
            one.insert(*tail)
            yield _batch([one.row(at)], schema)

    return ordered.mapInArrow(finish, _RESULT)


def repair_conversations(turns: DataFrame, most_rows: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of damaged turns.

    turns: conv_id, turn, role, text and lost, as damage gives them; a conversation all of whose rows are lost has zeros,
    an empty audit and the empty text's hash. Rows follow by turn, nulls first, then by role and text. Edits are D, I, K, R
    (see viterbi.py); of the cheapest the ASCII-least audit is taken. A null conv_id is a conversation of its own; repeated
    rows are duplicates; texts of any length pass; other columns are ignored; an empty table gives none. A
    conversation's rows go through in pieces of most_rows rows or most_bytes bytes at most.
    """
    rows = turns.select("conv_id", "turn", "role", F.when(F.col("lost"), "").otherwise(F.col("text")).alias("text"), "lost").withColumn("code", row_code(F.col("role"), F.col("text")))
    swept = materialize(_sweep(sort_conversations(rows), most_rows, most_bytes), "swept")
    pieces = swept.filter("part is not null").select("conv_id", *[c.split()[0] for c in _PIECE.split(", ")])
    chunks = materialize(_chunks(pieces), "chunks")
    costs = _stitch(chunks)
    traces = materialize(_traces(costs), "traces")
    discard(chunks, costs)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return swept.filter("part is null").select(*names).unionByName(_finish(pieces, traces))

"""Prefix trie of conversations: what conversations share from their first turn on, and what storing it once would save.

Turns are sorted by conversation over all partitions and go on as runs of digests and lengths, without texts. Equal
conversations are one class. A turn that only one class has at the end of its prefix begins a private tail, whose
nodes follow from the conversation alone; only the shared part of each class and the top of its tail go into tries. Classes
are sorted by path and dealt by ranges; each shard builds its trie as balanced parentheses (parentheses.py). The nodes
on the first and last path of a shard, its spines, may go on in other shards: they are merged in one more trie of two paths
a shard, and what hangs on them takes its parent from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .chat_repair import _arrow
from .common import discard, materialize, shuffle_parts
from .parentheses import WIDTH, Trie
from .sorted_runs import runs, sort_all, sort_conversations
from .words import M1, M2, mix

NO_END = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FAR = np.iinfo(np.int64).max


def first_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from its hundred's first conversation: crc32 of the decimal id, modulo 6."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("long")


def turn_runs(turns: DataFrame, most_rows: int) -> DataFrame:
    """conv_id, at, n, digests, chars: runs of a conversation's turns in order, at: turns before; 16 bytes and an int for each turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).filter("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = sort_conversations(rows.withColumns({"digest": digest, "chars": F.length("text")}), "conv_id", "digest", "chars")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        for t, edge in runs(batches, "conv_id", most_rows):
            conv = t["conv_id"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]])
            raw, chars = b"".join(t["digest"].to_pylist()), t["chars"].to_numpy().astype("<i4")
            n = np.diff(cut)
            yield pa.RecordBatch.from_arrays([
                pa.array(conv[cut[:-1]]), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(piece, piece + len(n), dtype=np.int64)), pa.array(np.full(len(n), edge)), pa.array(n.astype(np.int64)),
                pa.array([raw[WIDTH * a : WIDTH * z] for a, z in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([chars[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()),
            ], ["conv_id", "part", "piece", "edge", "n", "digests", "chars"])
            piece += len(n)

    packed = materialize(rows.mapInArrow(pack, "conv_id long, part int, piece long, edge boolean, n long, digests binary, chars binary"), "packed")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    columns = ["conv_id", "at", "n", "digests", "chars"]
    spread = packed.filter("edge").withColumn("at", F.coalesce(before, F.lit(0)))
    return packed.filter("not edge").withColumn("at", F.lit(0).cast("long")).select(*columns).unionByName(spread.select(*columns))


def _lanes(digests: bytes, at: int) -> np.ndarray:
    """Two 64-bit hashes (rows) of each turn's digest and depth; those of a prefix, joined by exclusive or, tell the prefix."""
    d = np.frombuffer(digests, "<u8").reshape(-1, 2)
    depth = np.arange(at + 1, at + 1 + len(d)).astype(np.uint64)
    return np.stack([mix(d[:, 0] + depth * M1) ^ mix(d[:, 1] ^ M2), mix(d[:, 1] + depth * M2) ^ mix(d[:, 0] ^ M1)])


def rebuilt_paths(packed: DataFrame, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(convs, paths) of rebuilt conversations.

    convs: conv_id, steps. paths: conv_id, at, n, digests, chars, p1 and p2 (hash of the turns before), f1 and f2 (of all turns), steps, all_chars, later_chars (in runs after this one).
    """
    own = packed.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumns({"h": first_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = own.filter("conv_id = base").select("base", F.col("own").alias("base_own"))
    m = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = own.join(bases, "base", "left").select("conv_id", "base", "h", m.alias("m"), (m + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("steps"))
    convs = materialize(convs, "rebuilt")

    def piece(skip: str, n: str) -> list[Column]:
        """Turns skip to skip + n of a run."""
        return [F.expr(n).alias("n"), F.expr(f"substring(digests, cast(16 * ({skip}) + 1 as int), cast(16 * ({n}) as int))").alias("digests"), F.expr(f"substring(chars, cast(4 * ({skip}) + 1 as int), cast(4 * ({n}) as int))").alias("chars")]

    opening = packed.filter((F.col("conv_id") % group == 0) & (F.col("at") < 5)).withColumnRenamed("conv_id", "base")
    taken = convs.join(opening, "base").filter("at < m").select("conv_id", "steps", "at", *piece("0", "least(n, m - at)"))
    rest = packed.join(convs, "conv_id").filter("at + n > h").select("conv_id", "steps", F.expr("m + greatest(at, h) - h").alias("at"), *piece("greatest(h - at, 0L)", "n - greatest(h - at, 0L)"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lanes = [np.bitwise_xor.reduce(_lanes(d, at), axis=1).view(np.int64).tolist() for d, at in zip(b.column("digests").to_pylist(), b.column("at").to_pylist())]
            chars = [int(np.frombuffer(c, "<i4").sum(dtype=np.int64)) for c in b.column("chars").to_pylist()]
            t1, t2 = zip(*lanes) if lanes else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(chars, pa.int64())], [*b.schema.names, "t1", "t2", "c"])

    told = taken.unionByName(rest).mapInArrow(total, "conv_id long, steps long, at long, n long, digests binary, chars binary, t1 long, t2 long, c long")
    by_depth = Window.partitionBy("conv_id").orderBy("at")
    before, later, all_ = by_depth.rowsBetween(Window.unboundedPreceding, -1), by_depth.rowsBetween(1, Window.unboundedFollowing), by_depth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    paths = told.select(
        "conv_id", "steps", "at", "n", "digests", "chars", *(F.coalesce(F.bit_xor(f"t{i}").over(before), zero).alias(f"p{i}") for i in (1, 2)),
        *(F.bit_xor(f"t{i}").over(all_).alias(f"f{i}") for i in (1, 2)), F.sum("c").over(all_).alias("all_chars"), F.coalesce(F.sum("c").over(later), zero).alias("later_chars"),
    )
    return convs, materialize(paths, "paths")


def classes_of(convs: DataFrame, paths: DataFrame, most_rows: int) -> DataFrame:
    """conv_id (the smallest), members, ends_sha256 of each class of equal conversations."""
    told = paths.filter("at = 0").select("conv_id", F.concat_ws(":", "steps", "f1", "f2").alias("key"))
    told = told.unionByName(convs.filter("steps = 0").select("conv_id", F.lit("0").alias("key")))
    ordered = sort_all(told, ["key", "conv_id"], ["key", "conv_id"])
    ddl = "key string, part int, piece int, conv_id long, members long, ends_sha256 string, ids string"
    schema = _arrow(convs.sparkSession, ddl)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        for t, edge in runs(batches, "key", most_rows):
            ids, keys = t["conv_id"].to_pylist(), t["key"].to_pylist()
            rows, a = [], 0
            for z in range(1, len(ids) + 1):
                if z == len(ids) or keys[z] != keys[a]:
                    said = ",".join(map(str, ids[a:z]))
                    rows.append((keys[a], part, piece, ids[a], z - a, None if edge else hashlib.sha256(said.encode()).hexdigest(), said if edge else None))
                    a, piece = z, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    joined = materialize(ordered.mapInArrow(join, ddl), "class-runs")
    spread = joined.filter("ids is not null").repartition(shuffle_parts(convs.sparkSession), "key").sortWithinPartitions("key", "part", "piece")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, first, members, out = None, hashlib.sha256(), 0, 0, []
        for b in batches:
            for k, conv, n, ids in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "members", "ids"))):
                if k != key:
                    if key is not None:
                        out.append((first, members, sha.hexdigest()))
                    key, sha, first, members = k, hashlib.sha256(), conv, 0
                sha.update((("," if members else "") + ids).encode())
                members += n
        if key is not None:
            out.append((first, members, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "members", "ends_sha256"])

    whole = joined.filter("ids is null").select("conv_id", "members", "ends_sha256")
    return materialize(whole.unionByName(spread.mapInArrow(close, "conv_id long, members long, ends_sha256 string")), "classes")


def _private_from(paths: DataFrame) -> DataFrame:
    """conv_id, shared: the classes that have a private tail, and how many turns lie before it."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, at, n, d, p1, p2 in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "n", "digests", "p1", "p2"))):
                lanes = np.bitwise_xor.accumulate(_lanes(d, at), axis=1).view(np.int64) ^ np.array([[p1], [p2]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, conv)), pa.array(np.arange(at + 1, at + n + 1)), pa.array(lanes[0]), pa.array(lanes[1])], ["conv_id", "depth", "p1", "p2"])

    nodes = paths.mapInArrow(prefixes, "conv_id long, depth long, p1 long, p2 long").groupBy("depth", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    return nodes.filter("n = 1").groupBy("conv_id").agg((F.min("depth") - 1).alias("shared"))


def _tails(paths: DataFrame) -> DataFrame:
    """Nodes of private tails below their tops. paths: those of the classes, with members, ends_sha256 and shared."""
    schema = _arrow(paths.sparkSession, NODE)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "at", "n", "chars", "steps", "later_chars", "members", "ends_sha256", "shared")
        for b in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(5)]
            ends: list[str] = []
            for conv, at, n, chars, steps, later, members, sha, shared in zip(*(b.column(c).to_pylist() for c in names)):
                c = np.frombuffer(chars, "<i4").astype(np.int64)
                depth = np.arange(at + 1, at + n + 1)
                own = depth >= shared + 2
                saved = (members - 1) * (np.cumsum(c[::-1])[::-1] + later)
                k = int(own.sum())
                for col, x in zip(got, (np.full(k, conv), depth[own], np.full(k, members), (depth[own] < steps).astype(np.int64), saved[own])):
                    col.append(x)
                ends += [sha if d == steps else NO_END for d in depth[own].tolist()]
            conv_, depth_, members_, below, saved_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((conv_, depth_, conv_, members_, below, np.ones(len(conv_), np.int64), saved_, ends), schema)], schema=schema)

    return paths.filter("steps >= shared + 2 and at + n >= shared + 2").mapInArrow(tails, NODE)


_SPINE = "part int, side int, path binary, chars array<long>, members array<long>, leaves array<long>, saved array<long>, least array<long>, children array<long>, ends array<string>"
_HELD = f"{NODE}, part int, side int, held_at int"


def _shards(tops: DataFrame) -> DataFrame:
    """Nodes of each shard's trie off its spines, and the spines: rows of both kinds in one schema."""
    ddl = f"{_HELD}, {', '.join('s_' + c for c in _SPINE.split(', ')[2:])}"
    schema = _arrow(tops.sparkSession, ddl)
    ordered = sort_all(tops.withColumn("head", F.substring("path", 1, 64 * WIDTH)), ["head"], ["path"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables)
        trie = Trie(t["path"].to_pylist())
        n = len(trie.depth)
        shared, steps, rep, members = (t[c].to_numpy() for c in ("shared", "steps", "conv_id", "members"))
        lengths = [np.frombuffer(c, "<i4") for c in t["chars"].to_pylist()]
        chars = np.array([0 if d == 0 else lengths[o][d - 1] for d, o in zip(trie.depth.tolist(), trie.owner.tolist())], np.int64)
        ending, least = np.zeros(n, np.int64), np.full(n, _FAR)
        ending[trie.end], least[trie.end] = members, rep
        convs, least = trie.subtree_sums(ending), trie.subtree_least(least)
        tail = steps > shared  # its end is the top of a private tail
        own = (convs - 1) * chars
        own[trie.end[tail]] = t["tail_saved"].to_numpy()[tail]
        deeper = np.zeros(n, np.int64)
        deeper[trie.end[steps > shared + 1]] = 1
        sha = [NO_END] * n
        for node, x, here in zip(trie.end.tolist(), t["ends_sha256"].to_pylist(), (steps <= shared + 1).tolist()):
            if here:
                sha[node] = x
        spines = []
        for i in (0, len(rep) - 1):
            way = trie.ancestors(int(trie.end[i]))
            spines.append(way[: int(min(shared[i], steps[i])) + 1])
        side_of, depth_on = np.zeros(n, np.int64), trie.depth
        side_of[spines[1]] = 2
        side_of[spines[0]] = 1
        on = side_of > 0
        own[on] = 0
        leaves = trie.leaves - trie.subtree_sums(((trie.children == 0) & on).astype(np.int64))
        saved = trie.subtree_sums(own)
        up = np.maximum(trie.parent, 0)
        off = np.flatnonzero(~on)
        held = side_of[up[off]]
        parent = np.where(held > 0, 0, least[up[off]])
        none = lambda k: pa.nulls(k[0], k[1])
        kinds = [f.type for f in schema]
        cols = [least[off], trie.depth[off], parent, convs[off], trie.children[off] + deeper[off], leaves[off], saved[off]]
        cols = [pa.array(c, pa.int64()) for c in cols] + [pa.array([sha[i] for i in off.tolist()], pa.string()), pa.array(np.full(len(off), part, np.int32)), pa.array(held.astype(np.int32)), pa.array(depth_on[up[off]].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols + [none((len(off), k)) for k in kinds[len(cols) :]], schema=schema)
        inner = np.flatnonzero(on[1:]) + 1
        hung = [convs.copy(), leaves, saved, trie.children + deeper]  # of what hangs on a spine's node itself: without its children on a spine
        for total, x in zip(hung, (convs, leaves.copy(), saved.copy(), np.ones(n, np.int64))):
            np.subtract.at(total, trie.parent[inner], x[inner])
        paths, rows = t["path"].to_pylist(), []
        for side, (i, way) in enumerate(zip((0, len(rep) - 1), spines), 1):
            mine = side_of[way] == side  # the right spine leaves to the left one what they share
            value = [np.where(mine, x[way], 0).tolist() for x in hung]
            rows.append((
                *[None] * 8, part, side, None, paths[i][: WIDTH * (len(way) - 1)], chars[way].tolist(), *value[:3], least[way].tolist(), value[3],
                [sha[v] if x else NO_END for v, x in zip(way, mine)],
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    return materialize(ordered.mapInArrow(build, ddl), "shards")


def _merge(spines: DataFrame) -> DataFrame:
    """Nodes of all spines (two a shard), merged, and for each spine (part, side) its nodes' conv_ids by depth."""
    ddl = f"{NODE}, part int, side int, named array<long>"
    schema = _arrow(spines.sparkSession, ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["path"], r["part"], r["side"]))
        if not rows:
            return
        trie = Trie([r["path"] for r in rows])
        n = len(trie.depth)
        sums = {c: np.zeros(n, np.int64) for c in ("members", "leaves", "saved", "children")}
        chars, least, sha, ways = np.zeros(n, np.int64), np.full(n, _FAR), [NO_END] * n, []
        for r, end in zip(rows, trie.end.tolist()):
            way = trie.ancestors(end)
            ways.append(way)
            for c, x in sums.items():
                x[way] += np.array(r[c], np.int64)
            chars[way] = r["chars"]
            least[way] = np.minimum(least[way], r["least"])
            for v, x in zip(way, r["ends"]):
                if x != NO_END:
                    sha[v] = x
        convs, children = trie.subtree_sums(sums["members"]), sums["children"] + trie.children
        leaves = trie.subtree_sums(sums["leaves"] + (children == 0))
        saved = trie.subtree_sums(sums["saved"] + (convs - 1) * chars)
        nodes = [(int(least[v]), int(trie.depth[v]), int(least[trie.parent[v]]) if v else None, int(convs[v]), int(children[v]), int(leaves[v]), int(saved[v]), sha[v], None, None, None) for v in range(n)]
        named = [(*[None] * 8, r["part"], r["side"], least[way].tolist()) for r, way in zip(rows, ways)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes, *named), schema)], schema=schema)

    return materialize(spines.repartition(1).mapInArrow(merge, ddl), "spines")


def prefix_trie(turns: DataFrame, most_rows: int = 65536) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text; in order of turn (nulls first), then role and text; null roles and texts are empty.
    Conversation c takes the first h turns of conversation c - c % 100 (h: first_turns) in place of its own first h. A node is named by its
    smallest member and its depth. Rows without conv_id belong to no conversation and are left out; repeated rows are turns each;
    texts of any length pass; other columns are ignored; an empty table gives no node. saved_tokens counts code points.
    Turns are told apart by 128-bit hashes. Shards are dealt by the first 64 shared turns.
    """
    packed = materialize(turn_runs(turns, most_rows), "turn-runs")
    convs, paths = rebuilt_paths(packed)
    classes = classes_of(convs, paths, most_rows)
    own = materialize(paths.join(classes, "conv_id"), "class-paths")
    cut = materialize(_private_from(own), "cut")
    own = own.join(cut, "conv_id", "left").withColumn("shared", F.coalesce("shared", "steps"))
    top = own.filter("at < least(steps, shared + 1)")
    k = F.least("n", F.least("steps", F.col("shared") + 1) - F.col("at")).cast("int")
    part = F.struct("at", F.substring("digests", F.lit(1), k * WIDTH).alias("d"), F.substring("chars", F.lit(1), k * 4).alias("c"))
    glued = lambda c: F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x[c]))
    tops = top.groupBy("conv_id", "steps", "shared", "members", "ends_sha256", "all_chars").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    tops = tops.select("conv_id", "steps", "shared", "members", "ends_sha256", "all_chars", glued("d").alias("path"), glued("c").alias("chars"))
    bare = classes.join(convs.filter("steps = 0"), "conv_id", "left_semi").select(
        "conv_id", *(F.lit(0).cast("long").alias(c) for c in ("steps", "shared")), "members", "ends_sha256", F.lit(0).cast("long").alias("all_chars"), F.lit(b"").alias("path"), F.lit(b"").alias("chars")
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(*(b.column(c).to_pylist() for c in ("members", "all_chars", "shared", "chars")))
            saved = [(m - 1) * (a - int(np.frombuffer(c, "<i4")[:s].sum(dtype=np.int64))) for m, a, s, c in cols]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(saved, pa.int64())], [*b.schema.names, "tail_saved"])

    tops = tops.unionByName(bare).mapInArrow(weigh, "conv_id long, steps long, shared long, members long, ends_sha256 string, all_chars long, path binary, chars binary, tail_saved long")
    shards = _shards(tops)
    spine = [c.split()[0] for c in _SPINE.split(", ")]
    merged = _merge(shards.filter("s_path is not null").select("part", "side", *(F.col(f"s_{c}").alias(c) for c in spine[2:])))
    names = [c.split()[0] for c in NODE.split(", ")]
    held = shards.filter("s_path is null")
    named = merged.filter("named is not null").select("part", "side", "named")
    tied = held.filter("side > 0").join(named, ["part", "side"]).withColumn("parent_conv_id", F.get("named", F.col("held_at")))
    out = merged.filter("named is null").select(*names).unionByName(held.filter("side = 0").select(*names)).unionByName(tied.select(*names))
    out = materialize(out.unionByName(_tails(own).select(*names)), "trie")
    discard(packed, convs, paths, classes, cut, shards, merged)
    return out

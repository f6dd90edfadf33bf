"""N-gram Jaccard join: documents whose sets of k-word shingles are alike, and the groups that such links make.

Equal sets are one class first, so copies never meet each other. Classes are joined on prefix shingles, rarest first: the
order of shingles is (tier, document frequency, hash), where tier 0 holds a fixed share of the hash space, enough for nearly
every prefix, and only its frequencies are counted (exactly, over all classes). A shingle that one class has alone joins
nothing and is dropped. Length, positional and suffix filters (a parity bitmap bounds the sets' difference from below) come
before each verification.

Groups are found without all pairs of a group: first every class meets one pivot of each of its prefix shingles' postings,
and those links are contracted; then, in postings that still hold several groups, members outside the largest group meet
all others in blocks inside the tasks, and only pairs of different groups that pass every filter come out to be verified.
No link between different groups is lost, so the groups are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks_for, materialize, shuffle_parts, string_buffers, text_col
from .components import components
from .words import M1, M3, mix, segment_sum, shingles, slices, word_hashes

#: Bits of the smallest parity bitmap; a larger set has at least half as many bits as elements.
PARITY_BITS = 512
#: Numbers of 64 bits that the bitmaps of the first filter are folded to.
PARITY_WORDS = 4


def sets_of(texts: pa.Array, k: int, step: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """shingles of a column of texts, about step bytes at a time."""
    data, offs = string_buffers(texts)
    sets, bounds, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, z in slices(offs, step):
        g, b = shingles(*word_hashes(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]), k)
        sets.append(g)
        bounds.append(b[1:] + total)
        total += len(g)
    return np.concatenate(sets), np.concatenate(bounds)


def prints(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each set, whatever its order."""
    return segment_sum(mix(g * M1), bounds).view(np.int64), segment_sum(mix(g ^ M3), bounds).view(np.int64)


def least_shared(n: int, percent: int) -> int:
    """Elements that a set has to share, at least, with any set that it links to."""
    return -(-percent * n // 100)


def parity(g: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of elements fall on i. Two bitmaps differ in no more bits than the sets have elements apart."""
    size = max(PARITY_BITS, 1 << (len(g) // 2).bit_length())
    bits = np.bincount((g >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def bitmaps(rows: list[bytes]) -> dict[int, np.ndarray]:
    """For each size of bitmap (in bytes) all rows folded to it; rows that are smaller are zero there."""
    own = np.array([len(r) for r in rows])
    out = {}
    for size in np.unique(own).tolist():
        m = np.zeros((len(rows), size // 8), np.uint64)
        for i in np.flatnonzero(own >= size).tolist():
            m[i] = np.bitwise_xor.reduce(np.frombuffer(rows[i], "<u8").reshape(-1, size // 8))
        out[size] = m
    return out


def _classes_and_frequencies(docs: DataFrame, k: int, percent: int, blocks: int):
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text")).withColumn("block", block)

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            g, b = sets_of(f.column("text"), k)
            p, q = prints(g, b)
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), f.column("block"), pa.array(np.diff(b)), pa.array(p), pa.array(q)], ["doc_id", "block", "n", "p", "q"])

    signed = materialize(rows.mapInArrow(sign, "doc_id long, block int, n long, p long, q long"), "signed")
    first = signed.filter("n > 0").groupBy("p", "q", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block")).alias("first"))
    classes = materialize(first.select("p", "q", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.block").alias("block"), F.monotonically_increasing_id().alias("node")), "classes")
    able = classes.filter(F.col("n") >= percent // (100 - percent)).select("block", "doc_id", "p", "node")  # smaller sets only link to equal ones
    return rows.repartition(max(shuffle_parts(spark), blocks), "block"), signed, classes, able


def _own_sets(left: pa.Table, right: pa.Table, k: int) -> tuple[list[int], np.ndarray, np.ndarray, list[int]]:
    """Of a block's documents those that stand for a class: (row of each, sets, bounds, node of each)."""
    node_of = {(d, p): x for d, p, x in zip(right["doc_id"].to_pylist(), right["p"].to_pylist(), right["node"].to_pylist()) if x is not None}
    if not node_of:
        return [], np.zeros(0, np.uint64), np.zeros(1, np.int64), []
    g, b = sets_of(left["text"], k)
    p, _ = prints(g, b)
    rows, nodes = [], []
    for i, key in enumerate(zip(left["doc_id"].to_pylist(), p.tolist())):
        if (x := node_of.pop(key, None)) is not None:
            rows.append(i)
            nodes.append(x)
    take = np.concatenate([np.arange(b[i], b[i + 1]) for i in rows]) if rows else np.zeros(0, np.int64)
    return rows, g[take], np.concatenate([[0], np.cumsum([b[i + 1] - b[i] for i in rows])]).astype(np.int64), nodes


def candidates(docs: DataFrame, k: int, percent: int):
    """(signed documents, classes, candidate classes with their prefix, text and filters)."""
    blocks = max(blocks_for(docs), shuffle_parts(docs.sparkSession))
    texts, signed, classes, able = _classes_and_frequencies(docs, k, percent, blocks)
    tier_bits = max(b for b in (0, 1, 2, 3) if 2.0**-b >= min(1.0, 1.6 * (100 - percent) / 100))
    bucket_bits = min(20, max(4, (2 * blocks).bit_length()))
    edge = np.uint64((1 << 64 - tier_bits) - 1)

    def buckets(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - tier_bits - bucket_bits)).astype(np.int64)

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, g, b, _ = _own_sets(left, right, k)
        h, n = np.unique(g[g <= edge], return_counts=True)
        cut = np.searchsorted(buckets(h), np.arange((1 << bucket_bits) + 1))
        some = np.flatnonzero(np.diff(cut))
        block = left["block"][0].as_py() if left.num_rows else 0
        n = n.astype("<u4")
        return pa.table({
            "bucket": pa.array(some.astype(np.int32)), "block": pa.array([block] * len(some), pa.int32()),
            "h": pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), "c": pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
        })

    def count(told: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in told["h"].to_pylist()]
        h, back = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(back, np.concatenate([np.frombuffer(x, "<u4") for x in told["c"].to_pylist()]), len(h))
        df = np.minimum(df, 65535).astype("<u2")[back]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"bucket": told["bucket"], "block": told["block"], "df": pa.array([df[e - len(p) : e].tobytes() for e, p in zip(ends, parts)], pa.binary())})

    by_block = texts.groupBy("block")
    told = by_block.cogroup(able.groupBy("block")).applyInArrow(tell, "bucket int, block int, h binary, c binary")
    counted = told.groupBy("bucket").applyInArrow(count, "bucket int, block int, df binary")

    def prefix(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.filter(pa.compute.is_valid(right["node"]))
        rows, g, b, nodes = _own_sets(left, known, k)
        told_df = sorted((u, d) for u, d in zip(right["bucket"].to_pylist(), right["df"].to_pylist()) if u is not None)
        df = np.frombuffer(b"".join(d for _, d in told_df), "<u2")
        h = np.unique(g[g <= edge])
        out: dict[str, list] = {c: [] for c in ("node", "n", "alone", "keys", "at", "parity", "bits", "text")}
        text = left["text"]
        for r, node, a, z in zip(rows, nodes, b[:-1].tolist(), b[1:].tolist()):
            s = g[a:z]
            n = z - a
            need = n - least_shared(n, percent) + 1
            low = s[: np.searchsorted(s, edge, "right")]
            d = df[np.searchsorted(h, low)]
            order = np.lexsort((low, d))[:need]
            keys, often = low[order], d[order]
            if len(keys) < need:
                more = s[len(low) : len(low) + need - len(keys)]
                keys, often = np.concatenate([keys, more]), np.concatenate([often, np.full(len(more), 65535, "<u2")])
            shared = np.flatnonzero(often > 1)
            if len(shared):
                bitmap = parity(s)
                bits = np.bitwise_xor.reduce(np.frombuffer(bitmap, "<i8").reshape(-1, PARITY_WORDS))
                for c, v in zip(out, (node, n, int((d == 1).sum()), keys[shared].view(np.int64), shared.astype(np.int32), bitmap, bits, text[r])):
                    out[c].append(v)
        kinds = {"node": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "keys": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "parity": pa.binary(), "bits": pa.list_(pa.int64()), "text": pa.string()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    nothing = lambda kind: F.lit(None).cast(kind)
    right = able.select("block", "doc_id", "p", "node", nothing("int").alias("bucket"), nothing("binary").alias("df")).unionByName(
        counted.select("block", nothing("long").alias("doc_id"), nothing("long").alias("p"), nothing("long").alias("node"), "bucket", "df")
    )
    found = texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(prefix, "node long, n long, alone long, keys array<long>, at array<int>, parity binary, bits array<long>, text string")
    return signed, classes, materialize(found, "candidates")


def suffix_filter(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Of pairs (hub, node) those whose folded parity bitmaps differ in no more bits than linked sets may have elements apart.

    Bitmaps go along as a few numbers; texts only follow the pairs that are left.
    """
    words = range(PARITY_WORDS)
    side = lambda of: found.select(F.col("node").alias(of), F.col("n").alias(f"{of}_n"), *(F.col("bits")[i].alias(f"{of}_{i}") for i in words))
    both = F.col("hub_n") + F.col("node_n")
    apart = sum((F.bit_count(F.col(f"hub_{i}").bitwiseXOR(F.col(f"node_{i}"))) for i in words), F.lit(0))
    least = F.ceil(percent * both / F.lit(100 + percent) - 1e-9)  # elements that linked sets of these sizes share
    return pairs.join(side("node"), "node").join(side("hub"), "hub").filter(apart <= both - 2 * least).select("hub", "node")


def verify(pairs: DataFrame, found: DataFrame, k: int, percent: int, group: int = 64) -> DataFrame:
    """Of pairs (hub, node), each distinct, those that link: (a, b). A hub's pairs are dealt to groups of about ``group``."""
    sizes = materialize(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("salts")), "hubs")
    text = found.select("node", "text")
    salted = pairs.join(sizes, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("node", F.col("hub"))
    rows = salted.unionByName(hubs).join(text, "node")

    def check(t: pa.Table) -> pa.Table:
        node, hub = t["node"].to_numpy(), t["hub"][0].as_py()
        g, b = sets_of(t["text"], k)
        i = int(np.flatnonzero(node == hub)[0])
        own = g[b[i] : b[i + 1]]
        at = np.minimum(np.searchsorted(own, g), len(own) - 1)
        both = segment_sum((own[at] == g).astype(np.int64), b)
        links = 100 * both >= percent * (np.diff(b) + len(own) - both)
        links[i] = False
        return pa.table({"a": pa.array(np.full(int(links.sum()), hub)), "b": pa.array(node[links])})

    return rows.groupBy("hub", "salt").applyInArrow(check, "a long, b long")


def _first_round(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of every class with one pivot of each posting."""
    # one number tells the set's size and the shingle's place; a set with fewer shingles of its own makes the better pivot
    sized = found.select("node", "alone", F.shiftleft(F.col("n"), 32).alias("n"), F.explode(F.arrays_zip("keys", "at")).alias("k"))
    entries = sized.select("node", F.col("k.keys").alias("key"), F.col("n").bitwiseOR(F.col("k.at").cast("long")).alias("sized"))
    ranked = sized.select(F.col("k.keys").alias("key"), F.struct("alone", "node", F.col("n").bitwiseOR(F.col("k.at").cast("long")).alias("sized")).alias("pivot"))
    pivots = ranked.groupBy("key").agg(F.min("pivot").alias("pivot"), F.count(F.lit(1)).alias("many"))
    hub = [F.shiftright("pivot.sized", 32).alias("hub_n"), F.col("pivot.sized").bitwiseAND(F.lit((1 << 32) - 1)).alias("hub_at")]
    pivots = materialize(pivots.filter("many > 1").select("key", F.col("pivot.node").alias("hub"), *hub), "pivots")
    own = [F.shiftright("sized", 32).alias("n"), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1)).alias("at")]
    share = F.ceil(percent * (F.col("n") + F.col("hub_n")) / F.lit(100 + percent) - 1e-9)
    at_most = F.least("at", "hub_at") + F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at"))  # shared before and from this shingle on
    near = (F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (at_most >= share)
    met = entries.join(pivots, "key").select("node", "hub", "hub_n", "hub_at", *own).filter(near)
    return materialize(met.select("hub", "node").distinct(), "pivot-pairs")


def _left_pairs(found: DataFrame, labels: DataFrame, seen: DataFrame, percent: int, rows: int = 512, columns: int = 2048) -> DataFrame:
    """Pairs (hub, node) of different groups that share a prefix shingle, pass every filter and have not met before, each once."""
    grouped = materialize(found.drop("text", "bits").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    entries = grouped.select("label", F.explode("keys").alias("key"))
    by_label = entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    of_key = by_label.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
    grid = of_key.filter(F.col("all") > F.col("most.n")).select(
        "key", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / rows).cast("int").alias("ri"), F.ceil(F.col("all") / columns).cast("int").alias("rj")
    )
    grid = materialize(grid, "left-postings")
    # slim rows meet the postings that are left; bitmaps and earlier shingles only go along with what remains
    slim = grouped.select("node", "label", F.posexplode(F.arrays_zip("keys", "at")).alias("place", "k"))
    slim = slim.select("node", "label", "place", F.col("k.keys").alias("key"), F.col("k.at").alias("at")).join(grid, "key")
    full = slim.join(grouped.select("node", "n", "parity", "keys"), "node").withColumn("before", F.slice("keys", F.lit(1), F.col("place"))).drop("keys", "place")
    full = materialize(full, "left-rows")
    i, j = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(c)).cast("int") for s, c in ((1, "ri"), (2, "rj")))
    outside = full.filter("label <> main").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rj") - 1))).withColumn("outside", F.lit(True))
    everyone = full.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ri") - 1))).withColumn("outside", F.lit(False))
    columns_ = ["key", "i", "j", "outside", "node", "label", (F.col("label") == F.col("main")).alias("in_main"), "n", "at", "parity", "before"]

    def meet(t: pa.Table) -> pa.Table:
        side, in_main = (np.asarray(t[c]) for c in ("outside", "in_main"))
        node, label, n, at = (t[c].to_numpy() for c in ("node", "label", "n", "at"))
        raw = t["parity"].to_pylist()
        size, bits = np.array([len(r) for r in raw]), bitmaps(raw)
        m = np.flatnonzero(~side)
        before = [frozenset(x) for x in t["before"].to_pylist()]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for u in np.flatnonzero(side).tolist():
            both = n[m] + n[u]
            share = -(-percent * both // (100 + percent))
            ok = (label[m] != label[u]) & (in_main[m] | (node[m] > node[u]))
            ok &= 100 * np.minimum(n[m], n[u]) >= percent * np.maximum(n[m], n[u])
            ok &= np.minimum(at[m], at[u]) + np.minimum(n[m] - at[m], n[u] - at[u]) >= share
            some = np.flatnonzero(ok)
            if not len(some):
                continue
            apart, common = np.zeros(len(some), np.int64), np.minimum(size[m[some]], size[u])
            for w in np.unique(common).tolist():
                of = common == w
                apart[of] = np.bitwise_count(bits[w][m[some[of]]] ^ bits[w][u]).sum(1, dtype=np.int64)
            some = some[apart <= (both - 2 * share)[some]]
            some = some[[before[u].isdisjoint(before[x]) for x in m[some].tolist()]] if len(some) else some  # else the pair meets in an earlier posting
            if len(some):
                pairs.append((np.full(len(some), node[u]), node[m[some]]))
        hub, other = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        return pa.table({"hub": pa.array(hub), "node": pa.array(other)})

    met = outside.select(*columns_).unionByName(everyone.select(*columns_)).groupBy("key", "i", "j").applyInArrow(meet, "hub long, node long")
    met = met.select(F.greatest("hub", "node").alias("hub"), F.least("hub", "node").alias("node"))
    return materialize(met.join(seen.select(F.greatest("hub", "node").alias("hub"), F.least("hub", "node").alias("node")), ["hub", "node"], "left_anti"), "left-pairs")


def ngram_jaccard_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text).

    Documents link when 100 * shared >= percent * united distinct k-word shingles of lower-cased (A-Z) whole texts; fewer
    than k words are one shingle; null and empty texts have none and link with nothing. component_id is the smallest
    doc_id of the document's group. Rows that repeat are documents each; rows with a null doc_id take part in links and
    never name a group that has another; alone, their component_id is null. Other columns are ignored.
    """
    signed, classes, found = candidates(docs, k, percent)
    pairs = _first_round(found, percent)
    close = materialize(suffix_filter(pairs, found, percent), "close-pairs")
    links = materialize(verify(close, found, k, percent), "links-1")
    labels = materialize(components(links), "labels-1")
    left = _left_pairs(found, labels, pairs, percent)
    more = materialize(verify(left, found, k, percent), "links-2")
    if more.head(1):
        labels = materialize(components(links.unionByName(more)), "labels-2")
    label = F.coalesce("label", "node").alias("label")
    named = classes.join(labels, "node", "left").select("p", "q", "n", "doc_id", label)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = materialize(named.join(least, "label").select("p", "q", "n", "component_id"), "class-groups")
    grouped = signed.join(of_class, ["p", "q", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

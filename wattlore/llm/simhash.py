"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits lie within half the radius of a common value. So every distinct
fingerprint emits all values (variants) within half the radius, variants are shuffled, and fingerprints that share one are
linked. Variants are dealt to buckets by their leading bits; a fingerprint goes once to each bucket that any of its
variants falls in and is spread into its variants there, so the shuffle carries tens of rows for a fingerprint instead of
two thousand. Buckets that would hold too many variants are dealt again by further bits until none does.

All fingerprints of one variant are within the radius of each other: each is tied to the least of them, which loses no
connection and makes no pairs of all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, string_buffers, text_col
from .components import components
from .words import slices, spans

BITS = 64
#: Row i: the bits of byte i, one in each byte of a 64-bit number; up to 255 rows add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8")[:, 0]


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle, repeats included, of every text, and the bounds of each text's hashes.

    Words are joined by one space; a text with fewer than k words has its whole sequence as its one shingle.
    """
    from xxhash import xxh64_intdigest

    b, starts, lengths, own = spans(data, offs)
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(place[-1]), 0x20, np.uint8)
    fill = np.arange(int(lengths.sum())) - np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    joined[np.repeat(place[:-1], lengths) + fill] = b[np.repeat(starts, lengths) + fill]
    n = np.diff(own)
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(own[:-1] - out[:-1], count) + np.arange(int(out[-1]))
    last = np.minimum(first + k, np.repeat(own[1:], count))
    raw = joined.tobytes()
    return np.fromiter((xxh64_intdigest(raw[i:j], seed) for i, j in zip(place[first].tolist(), (place[last] - 1).tolist())), np.uint64, int(out[-1])), out


def fingerprints(texts: pa.Array, k: int = 4, seed: int = 42, step: int = 2_000_000) -> np.ndarray:
    """SimHash of each text as a signed 64-bit number; null and wordless texts have zero. About step bytes at a time."""
    data, offs = string_buffers(texts)
    out = np.zeros(len(texts), np.uint64)
    for a, z in slices(offs, step):
        h, bounds = shingle_hashes(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], k, seed)
        n = np.diff(bounds)
        some = np.flatnonzero(n > 0)
        if not len(some):
            continue
        # sums of up to 255 hashes in eight bits for each bit, then sums of those sums for each text
        runs = -(-n[some] // 255)
        of = np.concatenate([[0], np.cumsum(runs)])
        begin = np.repeat(bounds[some], runs) + 255 * (np.arange(int(of[-1])) - np.repeat(of[:-1], runs))
        ones = np.stack([np.add.reduceat(_SPREAD[x], begin) for x in h.view(np.uint8).reshape(-1, 8).T[::-1]], axis=1)  # big end first
        total = np.add.reduceat(ones.view(np.uint8).reshape(-1, BITS).astype(np.int64), of[:-1], axis=0)
        out[a + some] = np.packbits(2 * total > n[some][:, None], axis=1).view(">u8")[:, 0]
    return out.view(np.int64)


def _masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of ``bits`` bits with exactly ``flips`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), flips)], np.uint64)


def _weight(bits: int, flips: int) -> int:
    return sum(comb(bits, i) for i in range(flips + 1))


def bucket_links(fp: np.ndarray, left: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(hub, fingerprint) of those that share a variant, in a bucket of variants with the same 64 - bits leading bits.

    left: how many bits of each fingerprint may still be flipped among the last ``bits``.
    """
    low = np.uint64((1 << bits) - 1) if bits < BITS else np.uint64(2**64 - 1)
    fp = fp.view(np.uint64)
    variants, owners = [], []
    for flips in range(int(left.max(initial=0)) + 1):
        able = np.flatnonzero(left >= flips)
        masks = _masks(bits, flips)
        variants.append(((fp[able] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(able.astype(np.int32), len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(v)]]))
    keep = np.repeat(size > 1, size)
    start, size, o = np.cumsum(size[size > 1]) - size[size > 1], size[size > 1], o[keep]
    if not len(o):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.argsort(np.argsort(fp.view(np.int64)))
    hub = np.repeat(np.argsort(rank)[np.minimum.reduceat(rank[o], start)], size)
    pairs = np.unique((hub.astype(np.int64) << 32) | o.astype(np.int64))
    a, b = fp[pairs >> 32], fp[pairs & 0xFFFFFFFF]
    near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    return a[near].view(np.int64), b[near].view(np.int64)


def _meeting(bits: int, radius: int):
    def meet(t: pa.Table) -> pa.Table:
        a, b = bucket_links(t["fp"].to_numpy(), t["left"].to_numpy(), bits, radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meet


def near_pairs(prints: DataFrame, radius: int = 4, per_bucket: int = 256, most: int = 4_000_000) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp: long), enough to connect all that differ in at most ``radius`` bits.

    Every link is verified. ``radius`` is even. Buckets are as many as leave about ``per_bucket`` fingerprints to each; one
    with more than ``most`` variants is dealt again by four more bits, as often as it takes.
    """
    half, bits = radius // 2, BITS
    step = max(4, min(24, (max(1, prints.count() // per_bucket)).bit_length()))
    rows = prints.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(half).alias("left"))
    links, kept = None, []
    while True:
        rest = bits - step
        flip = [(int(m), i) for i in range(half + 1) for m in _masks(step, i)]
        table = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(i).alias("flips")) for m, i in flip))
        own = F.shiftrightunsigned("fp", rest).bitwiseAND(F.lit((1 << step) - 1))
        dealt = rows.withColumn("m", F.explode(F.filter(table, lambda x: x["flips"] <= F.col("left"))))
        dealt = dealt.select(
            "fp", F.shiftleft("prefix", step).bitwiseOR(own.bitwiseXOR(F.col("m.mask"))).alias("prefix"), (F.col("left") - F.col("m.flips")).cast("int").alias("left"),
        )
        bits = rest
        dealt = materialize(dealt, "variants")
        kept.append(dealt)
        weight = F.element_at(F.array(*(F.lit(_weight(bits, i)).cast("long") for i in range(half + 1))), F.col("left") + 1)
        heavy = materialize(dealt.groupBy("prefix").agg(F.sum(weight).alias("n")).filter(F.col("n") > most).select("prefix"), "heavy")
        kept.append(heavy)
        more = bits > 0 and bool(heavy.head(1))
        light = dealt.join(heavy, "prefix", "left_anti") if more else dealt

        found = light.groupBy("prefix").applyInArrow(_meeting(bits, radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not more:
            break
        rows, step = dealt.join(heavy, "prefix", "left_semi"), min(4, bits)
    out = materialize(links.distinct(), "near-pairs")
    discard(*kept)
    return out


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document (doc_id, text).

    Texts are lower-cased (A-Z) as a whole; a fingerprint's bit is set where over half of the k-word shingles' XXH64 have it
    set, repeats counted. Null, empty and wordless texts have fingerprint zero and are linked like any other. Documents
    whose fingerprints differ in at most radius bits link; component_id is the smallest doc_id of the group. Rows that
    repeat are documents each; a null doc_id takes part in links and never names a group that has another. Other columns
    are ignored; an empty table gives none.
    """
    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(fingerprints(f.column("text"), k, seed))], ["doc_id", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"))
    signed = materialize(rows.mapInArrow(sign, "doc_id long, fp long"), "fingerprints")
    prints = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    pairs = near_pairs(prints, radius)
    labels = materialize(components(pairs), "fingerprint-groups")
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = materialize(named.select("fp", "label", "first"), "named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = materialize(named.join(least, "label").select("fp", "component_id"), "fingerprint-components")
    discard(pairs, labels, named, prints)
    return signed.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

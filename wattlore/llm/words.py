"""Vectorised word and shingle kernels over the byte buffers of whole columns of text (no Spark here)."""

from __future__ import annotations

import numpy as np

#: Words are runs of other characters than space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Hash of the end symbol that closes every text.
END = np.uint64(0xE1D_0F_7E47)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= M2
    h ^= h >> np.uint64(29)
    h *= M3
    h ^= h >> np.uint64(32)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    h = lengths.astype(np.uint64) * M1
    at, left, which = starts, lengths, None
    while len(at):
        x = eight[at]
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            x[short] &= keep
        if which is None:
            h = (h ^ x) * M2
            h ^= h >> np.uint64(31)
            which = np.flatnonzero(left > 8)
            at, left = at[which] + 8, left[which] - 8
        else:
            g = (h[which] ^ x) * M2
            g ^= g >> np.uint64(31)
            h[which] = g
            more = np.flatnonzero(left > 8)
            at, left, which = at[more] + 8, left[more] - 8, which[more]
    return mix(h)


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word lengths, first word of each text and the end); texts lie one after another."""
    b = LOWER[data]
    token = ~SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    first = token.copy()
    first[1:] &= ~token[:-1] | edge[1:-1]
    last = token
    if len(b):
        last = token.copy()
        last[:-1] &= ~token[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return b, starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offs)


def slices(offs: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Ranges of texts of about step bytes each; a longer text is a range of its own."""
    group = offs[1:] // step
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
    return [(int(a), int(z)) for a, z in zip(cut[:-1], cut[1:])]


def word_hashes(data: np.ndarray, offs: np.ndarray, step: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end); working memory is bounded by step, not by the column."""
    hashes, bounds, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, z in slices(offs, step):
        b, starts, lengths, own = spans(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
        hashes.append(hash_spans(b, starts, lengths))
        bounds.append(own[1:] + total)
        total += len(starts)
    return np.concatenate(hashes), np.concatenate(bounds)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text: (hashes in ascending order within a text, bounds).

    A text with fewer than k words has its whole word sequence as its one shingle; a text without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    out = np.concatenate([[0], np.cumsum(count)])
    g = np.zeros(out[-1], np.uint64)
    long = n >= k
    at = np.repeat(bounds[:-1][long] - out[:-1][long], count[long]) + np.flatnonzero(np.repeat(long, count))
    s = np.zeros(len(at), np.uint64)
    for i in range(k):
        s = (s ^ h[at + i]) * M1
        s ^= s >> np.uint64(31)
    g[np.repeat(long, count)] = mix(s)
    for i in np.flatnonzero((n > 0) & ~long):
        x = np.array([n[i]], np.uint64) * M3
        for j in range(bounds[i], bounds[i + 1]):
            x = (x ^ h[j : j + 1]) * M1
            x ^= x >> np.uint64(31)
        g[out[i]] = mix(x)[0]
    return distinct_sorted(g, out)


def distinct_sorted(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and deduplicate within each segment."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    keep[bounds[:-1][bounds[:-1] < len(g)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return g[keep], total[bounds]


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, empty ones included."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]

"""A block-max inverted index over numbered texts, for exact BM25 searches with dynamic pruning.

Postings of a term are grouped by blocks of consecutive texts, each with its largest impact. A search adds the block maxima
of its terms, visits blocks in falling order of that bound and stops where the bound can't reach the threshold any more.
"""

from __future__ import annotations

import numpy as np

K1, B = 1.2, 0.75


def impacts(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25's part without idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))


def idf(n: float, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of every distinct term of every text."""
    texts, terms, counts = [], [], []
    for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        t, c = np.unique(h[a:z], return_counts=True)
        texts.append(np.full(len(t), i))
        terms.append(t)
        counts.append(c)
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return cat(texts, np.int64), cat(terms, np.uint64), cat(counts, np.int64)


class BlockMaxIndex:
    """terms: sorted hashes. Block entries of term i are first[i]:first[i + 1]; postings of entry e are at[e]:at[e + 1]."""

    def __init__(self, texts: int, text: np.ndarray, term: np.ndarray, impact: np.ndarray, block: int = 32):
        order = np.lexsort((text, term))
        self.texts, self.block = texts, block
        self.text, self.impact = text[order].astype(np.int32), impact[order].astype(np.float64)
        self.terms, start = np.unique(term[order], return_index=True)
        of = self.text // block
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        new[start] = True
        self.at = np.append(np.flatnonzero(new), len(of))
        self.of = of[self.at[:-1]]
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(of) else np.zeros(0)
        self.first = np.append(np.searchsorted(self.at[:-1], start), len(self.of))

    ARRAYS = ("text", "impact", "terms", "at", "of", "most", "first")

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, shape=np.array([self.texts, self.block]), **{a: getattr(self, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "BlockMaxIndex":
        import io

        found, new = np.load(io.BytesIO(raw)), cls.__new__(cls)
        new.texts, new.block = found["shape"].tolist()
        for a in cls.ARRAYS:
            setattr(new, a, found[a])
        return new

    def frequencies(self) -> np.ndarray:
        return np.diff(self.at[self.first])

    def entries(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block entries of the query's terms, weight of each); terms that the index lacks fall away."""
        i = np.searchsorted(self.terms, terms)
        here = i < len(self.terms)
        here[here] = self.terms[i[here]] == terms[here]
        i, w = i[here], weights[here]
        n = self.first[i + 1] - self.first[i]
        e = np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return e, np.repeat(w, n)

    def scores(self, e: np.ndarray, w: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, scores) of the texts that have a query term, within the blocks marked in some."""
        pick = some[self.of[e]]
        e, w = e[pick], w[pick]
        n = self.at[e + 1] - self.at[e]
        p = np.repeat(self.at[e] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        total = np.bincount(self.text[p], self.impact[p] * np.repeat(w, n), self.texts)
        hit = np.flatnonzero(total)
        return hit, total[hit]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int | None = None, least: float = 0.0, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best texts, or all, that score at least ``least``; ties go to the smaller of ids (default: the number)."""
        e, w = self.entries(terms, weights)
        blocks = -(-self.texts // self.block)
        bound = np.bincount(self.of[e], self.most[e] * w, blocks) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        a, step, floor = 0, 8 if k else blocks, least
        while a < len(order) and bound[order[a]] >= floor:
            z = min(len(order), a + step)
            z = a + int(np.searchsorted(-bound[order[a:z]], -floor, "right"))
            some = np.zeros(blocks, bool)
            some[order[a:z]] = True
            t, s = self.scores(e, w, some)
            found, score = np.concatenate([found, t[s >= floor]]), np.concatenate([score, s[s >= floor]])
            if k and len(found) > k:
                best = np.lexsort((ids[found] if ids is not None else found, -np.round(score, 6)))[:k]
                found, score = found[best], score[best]
            if k and len(found) == k:
                floor = max(least, score.min() - 2e-6)  # what rounds to the same score still competes by id
            a, step = z, step * 2
        best = np.lexsort((ids[found] if ids is not None else found, -np.round(score, 6)))
        return found[best], score[best]

    def search_each(self, terms: np.ndarray, weights: np.ndarray, least: np.ndarray, block_least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that score at least their own of ``least``. Only blocks whose bound reaches block_least are visited."""
        e, w = self.entries(terms, weights)
        bound = np.bincount(self.of[e], self.most[e] * w, len(block_least)) * (1 + 1e-9)
        hit, score = self.scores(e, w, (bound > 0) & (bound >= block_least))
        some = score >= least[hit]
        return hit[some], score[some]

    def block_least(self, least: np.ndarray) -> np.ndarray:
        """The smallest of least in each block of texts."""
        return np.minimum.reduceat(least, np.arange(0, self.texts, self.block)) if self.texts else np.zeros(0)


class PrunedShard:
    """One shard of a search: postings of rare terms are walked, common terms are asked for only where block maxima allow it.

    Texts lie in blocks of consecutive numbers, the same for all terms, so the pivot test of block-max WAND is one sum for each
    block. A batch of queries takes it at once: the maxima of the common terms in every block, times the queries' weights, are
    a matrix product. The rare terms' part is exact for each text; where it and the block's bound together miss the query's
    threshold, the text is skipped. What is left gets its common part from a matrix product over the batch's texts, in single
    precision, and everything within rounding of the k best is scored again in double precision.
    """

    BLOCK, BATCH, SLACK = 16, 64, 1e-4

    def __init__(self, file: dict[str, np.ndarray], mean_length: float, common: float = 1 / 16):
        self.ids, self.terms, self.start, self.text, self.length = (file[x] for x in ("ids", "terms", "start", "text", "length"))
        self.mean, n, df = mean_length, len(self.ids), np.diff(self.start)
        self.impact = impacts(file["tf"].astype(np.float64), self.length[self.text], mean_length)
        often = np.flatnonzero(df >= max(8, common * n))
        self.column = np.full(len(df), -1, np.int32)
        self.column[often] = np.arange(len(often))
        column = np.repeat(self.column, df)
        here = np.flatnonzero(column >= 0)
        self.dense, self.tf = np.zeros((n, len(often)), np.float32), np.zeros((n, len(often)), file["tf"].dtype)
        self.dense[self.text[here], column[here]] = self.impact[here]
        self.tf[self.text[here], column[here]] = file["tf"][here]
        self.most = np.maximum.reduceat(self.dense, np.arange(0, n, self.BLOCK)) if n else np.zeros((0, len(often)), np.float32)

    def rare_part(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.start[terms + 1] - self.start[terms]
        p = np.repeat(self.start[terms] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.text[p], self.impact[p] * np.repeat(weights, size), len(self.ids))

    def search(self, terms: np.ndarray, weights: np.ndarray, start: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Merge this shard's texts into best: for each query (terms start[i]:start[i + 1]) ids and scores of its k best.

        Returns the number of texts whose common part was computed, over all batches.
        """
        n, visited = len(self.ids), 0
        if not len(self.terms):
            return 0
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[i] == terms
        some = min(n, 2 * k)
        for a in range(0, len(best), self.BATCH):
            batch = range(a, min(len(best), a + self.BATCH))
            common, rare = np.zeros((len(batch), self.dense.shape[1])), np.zeros((len(batch), n))
            for row, q in enumerate(batch):
                mine = slice(start[q], start[q + 1])
                t, w = i[mine][here[mine]], weights[mine][here[mine]]
                c = self.column[t]
                common[row, c[c >= 0]] = w[c >= 0]
                rare[row] = self.rare_part(t[c < 0], w[c < 0])
            common32, rare32 = common.astype(np.float32), rare.astype(np.float32)
            bound = np.repeat(common32 @ self.most.T, self.BLOCK, axis=1)[:, :n] + rare32
            floor = np.array([x[1].min() if len(x[1]) >= k else 0.0 for x in (best[q] for q in batch)])
            # the texts with the highest bounds set a threshold first
            seed = np.argpartition(bound, n - some, axis=1)[:, n - some :]
            tried = (self.dense[seed] @ common32[:, :, None])[:, :, 0] + np.take_along_axis(rare32, seed, 1)
            if some >= k:
                floor = np.maximum(floor, np.partition(tried, some - k, axis=1)[:, some - k] * (1 - self.SLACK))
            floor = np.maximum(floor * (1 - self.SLACK), 1e-30).astype(np.float32)  # a bound of zero shares no word
            texts = np.flatnonzero((bound >= floor[:, None]).any(0))
            visited += len(texts)
            if not len(texts):
                continue
            if 2 * len(texts) > n:
                texts = np.arange(n)
                score = common32 @ self.dense.T
                score += rare32
            else:
                score = common32 @ self.dense[texts].T + rare32[:, texts]
            for row, q in enumerate(batch):
                s = score[row]
                pick = np.flatnonzero(s >= floor[row])
                if len(pick) > k:
                    close = s[pick]
                    pick = pick[close >= np.partition(close, len(pick) - k)[len(pick) - k] * (1 - 2 * self.SLACK)]
                if len(pick):
                    pick = texts[pick]
                    c = np.flatnonzero(common[row])
                    exact = rare[row, pick] + impacts(self.tf[pick[:, None], c].astype(np.float64), self.length[pick, None], self.mean) @ common[row, c]
                    found, value = np.concatenate([best[q][0], self.ids[pick]]), np.concatenate([best[q][1], exact])
                    order = np.lexsort((found, -np.round(value, 6)))[:k]
                    best[q] = found[order], value[order]
        return visited

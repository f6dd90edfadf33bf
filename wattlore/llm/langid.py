"""Language ID by a linear-chain conditional random field over the words of a text.

Every word is a position; its features are its affixes (first and last one to four bytes), its byte trigrams with the word's
edges, and, for words of a lexicon gathered in training, the word itself, all hashed into one weight table. Transitions are
learned from sequences spliced out of texts of several languages, so the chain can switch within a text. Forward-backward
gives each word's language probabilities; a text's language is the one with most of its words' probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, release_memory, string_buffers
from .words import M1, M2, M3, hash_spans, spans

UNKNOWN = "und"
BITS = 17


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages), log
    lexicon: np.ndarray  # sorted word hashes


def letters_only(text) -> F.Column:
    """Lower-cased text, everything but letters and marks turned into spaces; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{M}]+", " "))


def features(data: np.ndarray, offs: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids of all words one after another, first feature of each word and the end, first word of each text and the end)."""
    b, starts, lengths, bounds = spans(data, offs)
    n = len(starts)
    padded = np.concatenate([np.zeros(8, np.uint8), b, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    whole = hash_spans(b, starts, lengths)
    shift = np.uint64(64 - BITS)
    fixed = []
    head, tail = eight[starts + 8], eight[starts + lengths]
    for k in range(1, 5):
        own = 8 * np.minimum(lengths, k).astype(np.uint64)  # a shorter word is its own affix
        fixed.append(((head & ((np.uint64(1) << own) - np.uint64(1))) * M1 + np.uint64(k)) * M2 >> shift)
        fixed.append(((tail >> (np.uint64(64) - own)) * M3 + np.uint64(k)) * M1 >> shift)
    known = np.zeros(n, bool)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)] == whole
    # trigrams at every byte of a word, the bytes outside the word read as 0
    total = int(lengths.sum())
    of = np.repeat(np.arange(n), lengths)
    first = np.cumsum(lengths) - lengths
    at = np.arange(total) - first[of]
    place = starts[of] + at + 8
    before = np.where(at > 0, padded[place - 1], 0).astype(np.uint64)
    after = np.where(at + 1 < lengths[of], padded[place + 1], 0).astype(np.uint64)
    tri = ((before << np.uint64(16) | padded[place].astype(np.uint64) << np.uint64(8) | after) * M3 + M2) * M1 >> shift
    size = lengths + len(fixed) + known
    ends = np.cumsum(size)
    begin = ends - size
    out = np.empty(int(size.sum()), np.int32)
    for k, f in enumerate(fixed):
        out[begin + k] = f
    out[begin[known] + len(fixed)] = (whole[known] * M3) >> shift
    out[begin[of] + len(fixed) + known[of] + at] = tri
    return out, np.concatenate([[0], ends]), bounds


def features_of(texts: list[str], lexicon: np.ndarray, step: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features of many texts, a few at a time: only the result is held whole."""
    feats, edges, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for a in range(0, len(texts), step):
        f, e, b = features(*string_buffers(pa.array(texts[a : a + step], pa.string())), lexicon)
        feats.append(f)
        bounds.append(b[1:] + sum(len(x) for x in edges) - 1)
        edges.append(e[1:] + edges[-1][-1])
    return np.concatenate(feats), np.concatenate(edges), np.concatenate(bounds)


def emissions(model: Model, feats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n = len(edges) - 1
    out = np.empty((n, len(model.languages)), np.float32)
    step = 1 << 15
    for a in range(0, n, step):
        z = min(n, a + step)
        part = model.weights[feats[edges[a] : edges[z]]]
        out[a:z] = np.add.reduceat(part, edges[a:z] - edges[a], axis=0)
    return out


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals of every word, expected transition counts, log partition sum) of chains laid one after another.

    All chains advance together, longest first, so the number of steps is the longest chain's length.
    """
    peak = emit.max(1, keepdims=True) if len(emit) else emit
    psi = np.exp(emit - peak)
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    move = np.exp(transitions).astype(np.float32)
    alpha, scale = np.empty_like(psi), np.ones(len(psi), np.float32)
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), "right")
    a = None
    for t, m in enumerate(alive.tolist()):
        if not m:
            break
        i = s[:m] + t
        a = psi[i] if a is None else (a[:m] @ move) * psi[i]
        total = a.sum(1, keepdims=True)
        a = a / total
        alpha[i], scale[i] = a, total[:, 0]
    beta = np.ones((len(s), psi.shape[1]), np.float32)
    expected = np.zeros_like(move, dtype=np.float64)
    for t in range(len(alive) - 1, 0, -1):
        m = int(alive[t])
        if not m:
            continue
        i = s[:m] + t
        back = psi[i] * beta[:m] / scale[i][:, None]
        expected += (alpha[i - 1].T @ back) * move
        alpha[i] *= beta[:m]
        beta[:m] = back @ move.T
    m = int(alive[0]) if len(alive) else 0
    alpha[s[:m]] *= beta[:m]
    marginals = alpha / alpha.sum(1, keepdims=True)
    return marginals, expected, float(np.log(scale).sum() + peak.sum())


def train(texts: list[str], langs: list[str], epochs: int = 4, words_per_step: int = 6000, seed: int = 7) -> Model:
    """Fit a model on letters_only texts with one language each; sequences of 8 to 40 words, half of them spliced."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    data, offs = string_buffers(pa.array(texts, pa.string()))
    b, starts, lengths, bounds = spans(data, offs)
    hashes, count = np.unique(hash_spans(b, starts, lengths), return_counts=True)
    lexicon = hashes[count >= 3]
    feats, edges, bounds = features_of(texts, lexicon)
    label = np.repeat(np.array([languages.index(x) for x in langs], np.int64), np.diff(bounds))
    L = len(languages)
    model = Model(languages, np.zeros((1 << BITS, L), np.float32), np.zeros((L, L)), lexicon)
    if L < 2 or not len(label):
        return model
    square, move_square = np.full(model.weights.shape, 1e-8, np.float32), np.full((L, L), 1e-8)
    runs = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        while a < z:
            n = int(rng.integers(4, 21))
            runs.append((a, min(z, a + n)))
            a += n
    for _ in range(epochs):
        rng.shuffle(runs)
        i = 0
        while i < len(runs):
            words, chain, held = [], [], 0
            while i < len(runs) and held < words_per_step:
                k = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
                part = [np.arange(*r) for r in runs[i : i + k]]
                words += part
                chain.append(sum(map(len, part)))
                held += chain[-1]
                i += k
            w = np.concatenate(words)
            n = edges[w + 1] - edges[w]
            own = np.concatenate([[0], np.cumsum(n)])
            f = feats[np.repeat(edges[w] - own[:-1], n) + np.arange(own[-1])]
            emit = emissions(model, f, own)
            size = np.array(chain)
            begin = np.cumsum(size) - size
            p, expected, _ = forward_backward(emit, begin, size, model.transitions)
            slope = p.astype(np.float64)
            slope[np.arange(len(w)), label[w]] -= 1
            each = np.repeat(slope, n, axis=0)
            grad = np.stack([np.bincount(f, each[:, c], 1 << BITS) for c in range(L)], 1).astype(np.float32)
            used = np.unique(f)
            g = grad[used] / len(w) * 100 + 1e-4 * model.weights[used]
            square[used] += g * g
            model.weights[used] -= 0.1 * g / np.sqrt(square[used])
            inner = np.ones(len(w), bool)
            inner[begin] = False
            y = label[w]
            seen = np.zeros((L, L))
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            g = (expected - seen) / len(w) * 100
            move_square += g * g
            model.transitions -= 0.1 * g / np.sqrt(move_square)
    return model


def label_texts(model: Model, texts: pa.Array, chars: int = 600_000) -> tuple[list[str], np.ndarray]:
    """(language or und, mean probability of that language over the words) of letters_only texts."""
    data, offs = string_buffers(texts)
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")
    names, score = [UNKNOWN] * len(size), np.zeros(len(size))
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // chars)) + 1):
        if not len(part):
            continue
        n = size[part]
        at = np.repeat(offs[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        feats, edges, bounds = features(data[at], np.concatenate([[0], np.cumsum(n)]), model.lexicon)
        words = np.diff(bounds)
        if not len(edges) - 1:
            continue
        emit = emissions(model, feats, edges)
        some = np.flatnonzero(words)
        p, _, _ = forward_backward(emit, bounds[:-1][some], words[some], model.transitions)
        mean = np.add.reduceat(p.astype(np.float64), bounds[:-1][some], axis=0) / words[some][:, None]
        best = mean.argmax(1)
        for i, k, v in zip(part[some].tolist(), best.tolist(), mean[np.arange(len(some)), best].tolist()):
            names[i], score[i] = model.languages[k], v
    return names, np.clip(score, 0, 1)


def held_out(doc_id, parts: int = 4, kept: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == kept, F.lit(False))


def training_sample(docs: DataFrame, rows_per_language: int = 300) -> DataFrame:
    """About rows_per_language labelled documents of each language outside the held-out fold, chosen by a hash of the text.

    This bound on the rows that the model is fitted on is the only sample; a document's own text is whole.
    """
    labelled = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    counts = labelled.groupBy("lang").count()  # one row per language
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64("text", F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    known = share.collect()
    rate = F.lit(0.0)
    for r in known:
        rate = F.when(F.col("lang") == r["lang"], F.lit(r["share"])).otherwise(rate)
    return labelled.filter(drawn < rate).select(letters_only(F.col("text")).alias("text"), "lang")


def fit(docs: DataFrame, rows_per_language: int = 300) -> Model:
    rows = training_sample(docs, rows_per_language).toPandas()  # bounded by rows_per_language for each language
    rows = rows.sort_values(["lang", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with lang_pred and lang_score added; lang, source and doc_id play no part.

    Null texts and texts without a letter are ``und`` with score 0; a model that has learned one language or none gives
    that language or ``und``; ties go to the language that is first in the alphabet. Rows that repeat are labelled each, an
    empty table stays empty, and a long text is one chain, however long. Columns that are already called lang_pred or
    lang_score are replaced; all others stay, whatever they are called.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights for each language and a lexicon of the bounded sample
    found = free_name(docs, "found")

    @F.arrow_udf("struct<lang_pred: string, lang_score: double>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for letters in batches:
            names, score = label_texts(shared.value, letters) if shared.value.languages else ([UNKNOWN] * len(letters), np.zeros(len(letters)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "lang_score"])
        letters = names = score = None
        release_memory()

    # only the letters go to Python; told to be nondeterministic, a filter on the result doesn't label the texts twice
    labelled = docs.select(*kept, label.asNondeterministic()(letters_only(docs["text"])).alias(found))
    return labelled.select(*kept, f"{found}.lang_pred", f"{found}.lang_score")

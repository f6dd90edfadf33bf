import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wattlore.llm import langid as L
from wattlore.llm import suffix_tree as S

SYLLABLES = {"en": ["the", "ing", "and", "th", "er"], "de": ["der", "sch", "ung", "ein", "ch"], "fr": ["le", "eau", "que", "ou", "ai"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=(3, 3))
    p, expected, log_z = L.forward_backward(emit, np.array([0]), np.array([4]), trans)
    score = {y: sum(emit[i, y[i]] for i in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:])) for y in itertools.product(range(3), repeat=4)}
    z = sum(math.exp(s) for s in score.values())
    assert log_z == pytest.approx(math.log(z), abs=1e-4)
    for i in range(4):
        for c in range(3):
            assert p[i, c] == pytest.approx(sum(math.exp(s) for y, s in score.items() if y[i] == c) / z, abs=1e-4)
    want = np.zeros((3, 3))
    for y, s in score.items():
        for a, b in zip(y, y[1:]):
            want[a, b] += math.exp(s) / z
    assert np.allclose(expected, want, atol=1e-4)


def test_chains_together_equal_chains_alone():
    rng = np.random.default_rng(2)
    emit, trans = rng.normal(size=(12, 3)).astype(np.float32), rng.normal(size=(3, 3))
    starts, lengths = np.array([0, 5, 6]), np.array([5, 1, 6])
    p, _, _ = L.forward_backward(emit, starts, lengths, trans)
    for a, n in zip(starts, lengths):
        own, _, _ = L.forward_backward(emit[a : a + n], np.array([0]), np.array([n]), trans)
        assert np.allclose(p[a : a + n], own, atol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randint(5, 60)), lang, "s", 0.5) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "en", "s", 0.5), (1001, "123 !!", "en", "s", 0.5), (1002, "", None, "s", 0.5), (None, text(rng, "de"), "de", "s", 0.5), (1003, text(rng, "fr", 20000), None, "s", 0.5), (1003, text(rng, "fr"), None, "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_score double")
    model = L.fit(docs, 60)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id in (1000, 1001, 1002)}
    assert all(r.lang_pred == "und" and r.lang_score == 0 for r in odd.values())
    assert all(r.lang_pred == "fr" for r in got if r.doc_id == 1003) and all(0 <= r.lang_score <= 1 for r in got)
    assert L.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "de", "ing", "é", "wörter"], k=rng.randint(0, 9))) for _ in range(130)]
    lexicon = np.sort(np.array([1, 2], np.uint64))
    whole, parts = L.features(*L.string_buffers(pa.array(texts)), lexicon), L.features_of(texts, lexicon, 7)
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(whole, parts))


def test_code_switching_follows_the_words():
    rng = random.Random(4)
    texts, langs = zip(*[(text(rng, lang), lang) for lang in SYLLABLES for _ in range(80)])
    model = L.train(list(texts), list(langs))
    mixed = text(rng, "en", 30) + " " + text(rng, "fr", 30)
    data, offs = L.string_buffers(pa.array([mixed]))
    feats, edges, bounds = L.features(data, offs, model.lexicon)
    p, _, _ = L.forward_backward(L.emissions(model, feats, edges), bounds[:-1], np.diff(bounds), model.transitions)
    best = [model.languages[i] for i in p.argmax(1)]
    assert np.mean([b == "en" for b in best[:30]]) > 0.9 and np.mean([b == "fr" for b in best[30:]]) > 0.9


def brute_scores(rows, max_depth, least, pseudo, divergence):
    """A dictionary version of the suffix tree: (rows, P(word | history), retained contexts, training counts)."""
    start, end = "<s>", "</s>"
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    seqs = [[start, *re.findall(r"[^\x20\x09-\x0D]+", lower(t)), end] for _, t in rows]
    train = [s for (d, _), s in zip(rows, seqs) if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for s in train for w in s[1:])
    N, V = sum(count.values()), len(count)
    kept = {}

    def prob(w, history):
        for k in range(min(max_depth, len(history)), 0, -1):
            if (c := tuple(history[-k:])) in kept:
                n, own = sum(kept[c].values()), {v: k for v, k in kept[c].items() if k >= least}
                return (own.get(w, 0) + (n - sum(own.values()) + pseudo) * prob(w, c[1:])) / (n + pseudo)
        return (count[w] + 1) / (N + V + 1)

    for depth in range(1, max_depth + 1):
        follow = {}
        for s in train:
            for i in range(depth, len(s)):
                follow.setdefault(tuple(s[i - depth : i]), Counter())[s[i]] += 1
        found = {}
        for c, next_words in follow.items():
            n = sum(next_words.values())
            gain = sum(k * math.log(((k if k >= least else 1) - 1 + pseudo * prob(w, c[1:])) / (n - 1 + pseudo) / prob(w, c[1:])) for w, k in next_words.items())
            if n >= least and gain >= divergence * n:
                found[c] = next_words
        kept.update(found)
    out = []
    for (d, _), s in zip(rows, seqs):
        base = sum(math.log10((count[w] + 1) / (N + V + 1)) for w in s[1:])
        out.append((d, len(s) - 1, sum(w in count for w in s[1:]), N, base, sum(math.log10(prob(s[i], s[max(0, i - max_depth) : i])) for i in range(1, len(s)))))
    return out, prob, kept, count


def walks(rng, n, words="abcdefgh"):
    chain = {w: rng.choices(words, k=3) for w in words}
    for _ in range(n):
        w, out = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(chain.get(w, "ab")) if rng.random() < 0.8 else rng.choice("ABCdefghxyz")
            out.append(w)
        yield " ".join(out)


@pytest.mark.parametrize("depth, least", [(1, 2), (3, 2), (4, 5)])
def test_suffix_tree_equals_brute_force(spark, depth, least):
    rng = random.Random(7)
    text = list(walks(rng, 83))
    rows = [*enumerate(text[:80]), (100, None), (101, ""), (102, "ÀÉ\tunknownword\n\x0b a"), (None, text[80]), (5, text[81]), (5, text[81]), (103, text[82] + " q" * 3000)]
    how = dict(max_depth=depth, least=least, pseudo=2.0, divergence=0.01)
    want, prob, kept, count = brute_scores(rows, **how)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    for c in kept:  # every state's distribution sums to 1, the root's share of unknown words included
        unknown = prob("never seen", c)
        assert sum(prob(w, c) for w in count) + unknown == pytest.approx(1)
    docs = spark.createDataFrame([(d, t, 0.0, 1) for d, t in rows], "doc_id long, text string, score double, block int")
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in S.score_texts(docs, **how).collect()]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:4], round(r[4], 3))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1e-8)
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-3)


def test_what_the_tree_knows_grows_with_the_text(spark):
    """A text that occurs twice is told from one that occurs once, however much other text there is."""
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2]
    for size in (100, 1500):
        rng = random.Random(size)
        texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(30)) for _ in range(size)]
        rows = list(zip(learned, [*texts, texts[0]]))
        got = {r.doc_id: r.score - r.base_score for r in S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        once = [got[i] for i, _ in rows[1:-1]]
        assert got[rows[0][0]] == pytest.approx(got[rows[-1][0]]) and got[rows[0][0]] > max(once) + 10


def test_nothing_to_learn(spark):
    assert S.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")], "doc_id long, text string")
    row = S.score_texts(only).first()
    assert row.held_out and row.train_tokens == 0 and row.n_tokens == 3 and row.score == 0

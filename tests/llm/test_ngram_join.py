import random
import re

import pytest

from wattlore.llm import ngram_join as N
from wattlore.llm.components import components


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((-1 if d is None else d), len(s), -1 if least.get(find(i)) is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [None, "", " \n ", "one", "One", "two words", "TWO words", "a b c", "x" * 3000]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([12, 30, 80, 200]))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 5
    for _ in range(30):
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60)) + passage))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[20], (None, rows[30][1]), (None, "nothing like it at all"), (rows[10][0], "same id and another text")]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 70)])
def test_groups_equal_brute_force(spark, k, percent):
    rows = corpus(k * percent)
    docs = spark.createDataFrame([(d, t, 1, 0) for d, t in rows], "doc_id long, text string, n int, node int")
    got = N.ngram_jaccard_groups(docs, k, percent).fillna(-1).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, percent)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Left-over postings cut into many blocks, hubs into many groups."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, verify = N._left_pairs, N.verify
    monkeypatch.setattr(N, "_left_pairs", lambda *a: pairs(*a, rows=3, columns=5))
    monkeypatch.setattr(N, "verify", lambda *a: verify(*a, group=4))
    monkeypatch.setattr(N, "blocks_for", lambda d: 7)
    got = N.ngram_jaccard_groups(docs, 3, 90).fillna(-1).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 90)


def test_empty(spark):
    assert N.ngram_jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label

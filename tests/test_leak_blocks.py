"""Leaks among texts of ordinary language: all pairs of like sizes by blocks."""

import random
import time

import numpy as np

from wattlore.operators import datasets


def test_shared_counts_of_two_blocks_equal_those_of_sets(monkeypatch):
    rng = random.Random(2)
    for dense in (0, 8, 256, 10**9):
        monkeypatch.setattr(datasets, "DENSE", dense)
        a, b = ([rng.sample([*range(30), *range(100, 3000)] if k % 2 else range(40), rng.randint(1, 30)) for k in range(n)] for n in (50, 30))
        flat = lambda s: (np.array([x for v in s for x in v], np.int64), np.array([len(v) for v in s], np.int32))
        got = datasets._shared(*flat(a), *flat(b))
        assert got.tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_unlike_texts_of_one_language_make_no_candidates(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(60)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(20, 90)))
    a, b = [(i, text()) for i in range(300)], [(i, text()) for i in range(80)]
    b += [(100 + i, a[i][1] + " zq") for i in range(5)] + [(200, ""), (201, None), (202, "é" * 9)]
    monkeypatch.setattr(datasets, "BLOCK", 2_000)
    monkeypatch.setattr(datasets, "LEAST", 20)

    def grams(t):
        t = "".join((t or "").lower().split())
        return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) >= 8 else set(t)

    want = {(i, j): len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for i, x in a for j, y in b if y}
    want = {k: v for k, v in want.items() if v > 0.9}
    out = datasets.near_duplicate_leaks(spark.createDataFrame(a, "train_id int, text string"), spark.createDataFrame(b, "test_id int, text string"))
    got = {(r.train_id, r.test_id): r.jaccard for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) >= 5


def test_bigrams_of_a_long_text_are_cut_in_one_pass(spark):
    from pyspark.sql import functions as F

    from wattlore.operators.graph import bigrams

    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc é😀\n", k=40_000))) for i in range(2)] + [(2, "A b"), (3, "x"), (4, ""), (5, "\U0001f600y\U0001f600")]
    start = time.monotonic()
    got = {r.i: r.g for r in spark.createDataFrame(rows, "i int, t string").select("i", bigrams(F.col("t")).alias("g")).collect()}
    assert time.monotonic() - start < 60  # worked out again for each place, this takes far longer
    for i, t in rows:
        t = "".join(t.lower().split())
        assert got[i] == (list(dict.fromkeys(t[k : k + 2] for k in range(len(t) - 1))) if len(t) > 1 else [t])

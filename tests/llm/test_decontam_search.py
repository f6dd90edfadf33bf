import math
import random
import re

import pyarrow as pa
import pytest

from wattlore.llm import decontam as D
from wattlore.llm import search as S

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghijkl", k=RNG.randint(2, 6))) for _ in range(400)]
ITEMS = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(10, 50))).capitalize() + ". " + " ".join(RNG.choices(WORDS, k=RNG.randint(1, 6))) + ".") for i in range(30)]


def text(n):
    return " ".join(RNG.choices(WORDS, k=n))


def leak_corpus():
    docs = [(i, text(RNG.randint(1, 400))) for i in range(150)]
    for i, (_, item) in enumerate(ITEMS):
        docs.append((1000 + i, f"{text(RNG.randint(0, 200))}\n{item}\n{text(RNG.randint(0, 90))}"))
        docs.append((2000 + i, f"{text(30)} {item.upper().replace('. ', ' -- ')}"))
    docs += [(3000, ITEMS[0][1] + " " + ITEMS[1][1]), (3001, None), (3002, ""), (None, ITEMS[2][1]), (3003, text(3000) + " " + ITEMS[3][1] + " " + text(3000)), (1000, text(5))]
    return docs


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_leaks_are_all_found_and_nothing_else(spark):
    rows = leak_corpus()
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    items = spark.createDataFrame([*ITEMS, (900, None), (901, "too short")], "item_id long, text string")
    want = {(d, i) for d, t in rows for i, x in ITEMS if " ".join(words(x)) in " ".join(words(t))}
    for chars in (32_000_000, 1500):
        got = D.find_leaks(docs, items, shard_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_bound_prunes_no_match():
    """Every passage that scores enough is searched: scan against plain BM25 over all passages."""
    items = D.build_items([i for i, _ in ITEMS], *[[" ".join(words(x)) for _, x in ITEMS]] * 2, [""] * len(ITEMS), len(ITEMS), None, None)
    docs = [" ".join(words(t)) for _, t in leak_corpus()]
    mixed = docs + [" ".join(w for w in words(x) if RNG.random() < 0.8) for _, x in ITEMS]
    got = {(d, i) for d, i, *_ in D.scan(items, list(range(len(mixed))), pa.array(mixed), 0.5, 0.0)}
    bags = [set(words(x)) for _, x in ITEMS]
    df = {w: sum(w in b for b in bags) for b in bags for w in b}
    mean = sum(len(words(x)) for _, x in ITEMS) / len(ITEMS)

    def weight(w, x):
        tf = x.count(w)
        return math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))

    want = set()
    for d, t in enumerate(mixed):
        w = t.split()
        for a in range(0, max(1, len(w)), items.stride):
            seen = set(w[a : a + 2 * items.stride])
            for i, (_, x) in enumerate(ITEMS):
                x = words(x)
                if sum(weight(q, x) for q in set(x) & seen) >= 0.5 * sum(weight(q, x) for q in set(x)) + 1e-9:
                    want.add((d, i))
    assert want <= got and len(got) <= len(want) + 2


def test_many_items_take_bounded_memory_and_give_the_same(monkeypatch):
    """Segments by items that don't fit into the table are summed by sorting."""
    long = [" ".join(words(x)) for _, x in ITEMS]
    items = D.build_items([i for i, _ in ITEMS], long, long, [""] * len(ITEMS), len(ITEMS), None, None)
    docs = [" ".join(words(t)) for _, t in leak_corpus()]
    want = D.scan(items, list(range(len(docs))), pa.array(docs), 0.5, 0.0)
    monkeypatch.setattr(D, "CELLS", 40)
    assert len(want) > 60 and sorted(D.scan(items, list(range(len(docs))), pa.array(docs), 0.5, 0.0)) == sorted(want)


def test_a_hundred_thousand_items():
    import tracemalloc

    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(60_000)]
    texts = [" ".join(rnd.choices(vocabulary, k=8)) for _ in range(100_000)]
    items = D.build_items(list(range(len(texts))), texts, texts, [""] * len(texts), len(texts), None, None)
    docs = [" ".join(rnd.choices(vocabulary, k=20)) + " " + texts[i] + " " + " ".join(rnd.choices(vocabulary, k=20)) for i in range(300)]
    tracemalloc.start()
    got = D.scan(items, list(range(300)), pa.array(docs), 0.7, 0.6)
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert {(i, i) for i in range(300)} == {(d, i) for d, i, *_ in got}


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert D.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert D.find_leaks(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("shard_chars", [48_000_000, 4_000])
def test_top_k_equals_brute_force(spark, shard_chars):
    rows = [(i, text(RNG.randint(1, 60)) + (" same words here" * (i % 3))) for i in range(120)]
    rows += [(200, None), (220, ""), (240, rows[0][1]), (241, rows[0][1]), (260, rows[0][1]), (260, "zzz unique"), (None, rows[0][1])]
    docs = spark.createDataFrame([(d, t, d, 1.0) for d, t in rows], "doc_id long, text string, rank long, score double")
    got = S.top_k(docs, (docs["doc_id"].isNotNull()) & (docs["doc_id"] % 20 == 0), k=5, shard_chars=shard_chars, query_chars=2_000).collect()
    bags = [(t or "").lower().split() for _, t in rows]
    mean, n = sum(map(len, bags)) / len(bags), len(bags)
    df = {}
    for b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    want = []
    for (q, _), own in zip(rows, bags):
        if q is not None and q % 20 == 0:
            scored = []
            for (d, _), b in zip(rows, bags):
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in set(own) & set(b))
                if s > 0:
                    scored.append((-round(s, 6), -1 if d is None else d))
            want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:5])]
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], round(r[3], 4))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_short_items_match_as_word_sequences(spark):
    items = [(1, "Who? Me."), (2, "zebra"), (3, "one two three four"), (4, "zebra!"), (5, None), (6, "?!"), *[(100 + i, t) for i, t in ITEMS]]
    rows = [(1, "so: who? ME, of course"), (2, "who was me"), (3, "Zebra"), (4, "zebras one two three five four"), (5, text(50) + " One, two;\nthree four. " + text(50)), (6, None), (None, "a zebra zebra"), (7, "one two three"), (8, ITEMS[4][1] + " zebra")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, x in items if words(x) and f" {' '.join(words(x))} " in f" {' '.join(words(t))} "}
    assert {(1, 1), (3, 2), (None, 4), (5, 3), (8, 2), (8, 104)} <= want and (4, 2) not in want
    for chars in (32_000_000, 1500):
        got = D.find_leaks(docs, table, shard_chars=chars).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.score > 0 for r in got)


def test_least_scores_of_items_decide_which_blocks_are_visited(monkeypatch):
    long = [" ".join(words(x)) for _, x in ITEMS]
    items = D.build_items([i for i, _ in ITEMS], *[long] * 2, [""] * len(ITEMS), len(ITEMS), None, None)
    index, visited = items.index, []
    plain = type(index).scores
    monkeypatch.setattr(type(index), "scores", lambda self, e, w, some: visited.append(int(some.sum())) or plain(self, e, w, some))
    least, steps = 0.7 * items.own, 0
    for x in long:
        terms = index.terms[[t in set(D.word_hashes(*D.string_buffers(pa.array([x])))[0].tolist()) for t in index.terms.tolist()]]
        weights = items.idf[[index.terms.tolist().index(t) for t in terms.tolist()]]
        every, score = index.search(terms, weights)
        visited.clear()
        hits, _ = index.search_each(terms, weights, least, index.block_least(least))
        assert set(hits.tolist()) == set(every[score >= least[every]].tolist()) and len(hits)
        steps += sum(visited)
    assert steps < len(ITEMS) * -(-len(ITEMS) // index.block)

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wattlore.llm import packing as P
from wattlore.llm import token_files as T
from wattlore.llm.common import materialize
from wattlore.llm.memo_tokens import MemoTokenizer

TEXTS = ["", None, "the cat sat on the mat. " * 700, "a", "Ünïcode é\x1c x  \n y 中 <|endoftext|>", "the cat sat on the mat. " * 3, "  ", "x" * 9000, "the\tcat", "the cat sat on the mat. " * 3]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "a", "y", 2), (None, "null id", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")


def brute(hist, capacity):
    left = []
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            i = bisect.bisect_left(left, n)
            bisect.insort(left, (left.pop(i) if i < len(left) else capacity) - n)
    return left


def test_moves_equal_piecewise_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([7, 20, 64])
        hist = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        fill, ranks = {}, {}
        for n, rank, first, count, per, offset in P.best_fit_moves(hist, capacity).tolist():
            assert ranks.get(n, 0) == rank
            ranks[n] = rank + count * per
            for q in range(first, first + count):
                assert fill.get(q, 0) == offset
                fill[q] = offset + per * n
        assert ranks == hist
        assert sorted(capacity - x for x in fill.values()) == brute(hist, capacity)


def test_pack_documents(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = P.pack_documents(docs, path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for doc, text, *_ in docs.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(key, want))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        assert s["length"].sum() <= 4096
    assert got["sequence_id"].nunique() == len(brute(got["length"].value_counts().to_dict(), 4096))


def test_pack_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def expanded(symbols, rules, first):
    return T.Expander(rules, T.expansion_lengths(rules, first), first).ids(symbols)


@pytest.mark.parametrize("high", [3, 300, 70000])
def test_grammar_round_trip(high):
    rng = np.random.default_rng(high)
    first = max(high, T.FIRST_NONTERMINAL)
    for n in (0, 1, 5, 30000):
        ids = (rng.zipf(1.3, n) % high).astype(np.uint32)
        symbols, rules = T.grammar(ids, first, least=4)
        assert (expanded(symbols, rules, first) == ids).all()
        left = np.unique(np.stack([symbols[:-1], symbols[1:]], 1)[(symbols[:-1] != 0) & (symbols[1:] != 0) & (symbols[:-1] != symbols[1:])], axis=0, return_counts=True)[1]
        assert left.max(initial=0) < 4  # no pair is frequent any more
        if n == 30000 and high == 300:
            assert len(symbols) < 0.8 * n


def test_grammar_folds_runs_and_long_repeats():
    run = np.full(1 << 18, 7, np.uint32)
    symbols, rules = T.grammar(run)
    assert len(symbols) < 128 and len(rules) >= 12 and (expanded(symbols, rules, T.FIRST_NONTERMINAL) == run).all()
    odd = np.full(1001, 7, np.uint32)
    symbols, rules = T.grammar(odd, least=2)
    assert (expanded(symbols, rules, T.FIRST_NONTERMINAL) == odd).all()
    repeat = np.tile(np.arange(1, 257, dtype=np.uint32), 1000)
    symbols, rules = T.grammar(repeat)
    assert len(symbols) <= 1000 and (expanded(symbols, rules, T.FIRST_NONTERMINAL) == repeat).all()


def test_symbols_may_need_more_than_16_bits():
    ids = [np.tile(np.arange(1, 20000, dtype="<u4"), 2).tobytes(), np.array([5, 1 << 20], "<u4").tobytes()]
    parts, n, _ = T.encode_shard([1, None], ids, least=2)
    shard = T.Shard(b"".join(parts))
    assert n == 2 * 19999 + 2 + 2 and len(shard.rules) + shard.first > 1 << 16
    assert [shard.document(i).astype("<u4").tobytes() for i in (0, 1)] == [x + b"\0\0\0\0" for x in ids]


def test_ids_equal_the_library():
    rnd = random.Random(1)
    pool = list("aBéßİıſ²½ªº1٣中日の क्😀\u200b\u200d\xad\u0301\u2003 \n\t\x1c\x1f\x85\xa0\u3000'’_-<>Ǆǅŏ\x00\x7fµÅÅﬁΩ") + ["  ", "\r\n", "'s", "'LL", "...", "<|endoftext|>", "<|startoftext|>", "word", "don't", "I'M"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["中" * 5000, "x" * 5000]
    for name, strip in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        m = MemoTokenizer(public_tokenizers.path(name), strip)
        m.memo.most = 20_000  # emptied many times on the way
        want = [np.array(e.ids, "<u4").tobytes() for e in m.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert m.encode(texts) == want
        assert m.memo.held < 21_000 and max(map(len, m.memo)) <= 64
        m.release()
        assert not m.memo


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, path string")
    manifest = materialize(T.write_token_files(empty, public_tokenizers.path("byte_bpe_50k.json")), "m")
    assert manifest.count() == 0 and T.read_token_files(manifest).count() == 0


def test_token_files(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = materialize(T.write_token_files(docs, path, shard_ids=500), "m")
    got = T.read_token_files(manifest).toPandas().sort_values("start")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((-1 if d is None else d), t or "") for d, t, *_ in docs.collect())
    at, want = 0, []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got.fillna(-1).astype("int64").values.tolist() == [list(w) for w in want]
    from wattlore.llm.common import open_fs

    one = manifest.filter("docs > 1").first()
    fs, local = open_fs(one["path"])
    shard = T.Shard(fs.open_input_file(local).read())
    whole = shard.all_ids()
    for i in range(len(shard.doc_ids)):
        assert (shard.document(i) == whole[shard.starts[i] : shard.starts[i + 1]]).all()

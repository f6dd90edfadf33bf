"""The Latin pre-token pattern cuts as the file's pattern does."""

import random

import numpy as np
import public_tokenizers

from wattlore.llm.memo_tokens import BYTE_PIECES, LATIN, LATIN_BYTE_PIECES, ODD, MemoTokenizer, latin_byte_pieces


def test_latin_pattern_cuts_like_the_general_one():
    rng = random.Random(4)
    every = [chr(c) for c in range(0x250) if LATIN.fullmatch(chr(c)) and not ODD.match(chr(c))]
    few = list(" 'stmdrevlL\n\t\x0b0a9_,.é \xa0\x85")
    for k in range(40_000):
        text = "".join(rng.choices(every if k % 2 else few, k=rng.randint(0, 12)))
        assert LATIN_BYTE_PIECES.findall(text) == BYTE_PIECES.findall(text), repr(text)
    assert LATIN_BYTE_PIECES.findall("".join(every)) == BYTE_PIECES.findall("".join(every))


def test_batches_are_cut_like_single_texts():
    rng = random.Random(5)
    every = [chr(c) for c in range(0x250) if LATIN.fullmatch(chr(c)) and not ODD.match(chr(c))]
    few = list(" 'stmdrevlL\n\t\x0b0a9_,.é \xa0\x85")
    for k in range(4_000):
        texts = ["".join(rng.choices(every if k % 2 else few, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        pieces, ends = latin_byte_pieces(texts)
        bounds = [0, *(ends + 1).tolist()]
        assert [pieces.to_pylist()[a : z - 1] for a, z in zip(bounds, bounds[1:])] == [LATIN_BYTE_PIECES.findall(t) for t in texts], texts


def test_latin_batches_look_each_piece_up_once_and_equal_the_library():
    rng = random.Random(6)
    tokenizer = MemoTokenizer(public_tokenizers.path("byte_bpe_50k.json"), False)
    tokenizer.memo = None  # the look-up of piece after piece
    words = ["the", " the", "l'été", "'s", " 'll", "\n", "  ", "naïve-", "x" * 500, "12", "..."]
    texts = ["", *("".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(300))]
    want = [np.array(tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokenizer.encode(texts) == want
    assert tokenizer.encode(texts[::-1]) == want[::-1]
    tokenizer.table.most = 0  # emptied before each batch
    assert tokenizer.encode(texts) == want and tokenizer.encode([""]) == [b""]

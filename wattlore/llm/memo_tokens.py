"""Whole-text tokenisation by a public tokenizer file, each distinct piece of text encoded once.

A text of Latin characters is cut into the file's pre-tokens here, and each pre-token that isn't known yet goes to the
file's BPE model. For the byte-level file the texts of a batch are cut together, as arrays, and each distinct pre-token is
looked up once a batch. The pre-tokenizers of the supported files never join characters across the start of a run of white space,
so any other text is cut there and its chunks take the same way where they are Latin; the rest of them goes through the whole
tokenizer, many chunks in one call. Texts with control separators that the two notions of white space see differently are
encoded whole. The memo is bounded in bytes and holds short pieces only: a full one is emptied, which costs time and changes
nothing. Tasks release it at their end, because workers outlive a job and the next one may need the memory.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import string_buffers

#: Characters Python counts as white space and the tokenizer files do not.
ODD = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters whose case, normal form and class are the same in every Unicode version at hand; without the numbers that
#: Python's \w takes for letters.
LATIN = re.compile("[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
#: The pre-token patterns that the two files state, with [^\W\d_] for a letter and \d for a number.
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _class(kind: str) -> str:
    """The characters of LATIN, without ODD, that the pattern kind matches, as the inside of a character class: looked up in a
    table, where negated and named classes are tried one after another for each character."""
    own = [c for c in range(0x250) if LATIN.fullmatch(chr(c)) and not ODD.match(chr(c)) and re.fullmatch(kind, chr(c))]
    edges = [c for c in own if c - 1 not in own], [c for c in own if c + 1 not in own]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in zip(*edges))


_LETTER, _DIGIT, _SPACE, _OTHER = map(_class, (r"[^\W\d_]", r"\d", r"\s", r"[^\s\w]|_"))
#: BYTE_PIECES for Latin texts; what most pieces are comes first.
LATIN_BYTE_PIECES = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGIT}]+| ?[{_OTHER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Kinds of Latin characters by code point: 0 for ODD, of which END stands after each text of a batch, else what the pattern takes together.
LETTER, DIGIT, SPACE, OTHER = range(1, 5)
KIND = np.array([next((k for k, own in enumerate((_LETTER, _DIGIT, _SPACE, _OTHER), 1) if re.match(f"[{own}]", chr(c))), 0) for c in range(0x250)], np.uint8)
END = "\x1c"
#: Bytes that a memo may take, by the estimate of _COST bytes an entry besides its characters and ids, and the longest piece it keeps.
MEMO_BYTES, MEMO_PIECE, _COST = 96_000_000, 64, 200
#: Bytes for a known piece in the look-up's own table and in the count of its ids.
_SLOT = 100


def _byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as a printable character: itself where it is one, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


LETTERS = _byte_letters()
_CODES = np.array([ord(x) for x in LETTERS], "<u4")


def latin_byte_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """(the pieces that LATIN_BYTE_PIECES finds in Latin texts without ODD, END after each text's; the places of the ENDs)."""
    joined = END.join([*texts, ""])
    at = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = KIND[at]
    end, seen = kind == 0, (kind != 0) & (kind != SPACE)
    start = end.copy()
    start[:1] = True
    start[1:] |= kind[1:] != kind[:-1]
    start[:-1] |= (kind[:-1] == SPACE) & seen[1:]  # of white space before a word the last character stands alone,
    start[1:] &= ~(seen[1:] & (at[:-1] == 32))  # or with the word, where it is a space
    quote = np.flatnonzero(start & (at == ord("'")))
    one, two = at[quote + 1], at[np.minimum(quote + 2, len(at) - 1)]  # END is the last
    length = 2 * np.isin(one, [ord(c) for c in "stmd"])
    for a, b in ("re", "ve", "ll"):
        length[(one == ord(a)) & (two == ord(b))] = 3
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    start[quote + length] = True
    begin = np.flatnonzero(start)
    raw = joined.encode()
    offsets = begin if len(raw) == len(at) else begin + (np.cumsum(at >= 128) - (at >= 128))[begin]  # two bytes each from there on
    offsets = np.append(offsets, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw)), np.flatnonzero(end[begin])


class _Memo(dict):
    """Piece -> ids; what is missing is encoded, so a piece that is known costs one look-up."""

    def __init__(self, model, most: int = MEMO_BYTES):
        super().__init__()
        self.tokenize, self.most, self.held = model.tokenize, most, 0

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():  # a word, perhaps after a space: only the space is written otherwise
            said = LETTERS[32] + piece[1:] if piece[0] == " " else piece
        else:
            said = "".join([LETTERS[b] for b in piece.encode()])
        ids = array("I", [t.id for t in self.tokenize(said)]).tobytes()
        if len(piece) <= MEMO_PIECE:
            if self.held >= self.most:
                self.release()
            self.held += _COST + 2 * len(piece) + len(ids)
            self[piece] = ids
        return ids

    def release(self) -> None:
        self.clear()
        self.held = 0


class _Table:
    """Pieces -> ids of the byte-level file for many pieces at once: known pieces as an Arrow array, their ids in a row. Bounded like
    _Memo. New pieces go to the file's model together, with a space between them, which no piece has in byte letters; as
    each id stands for so many bytes, the ids of a piece are found by the pieces' lengths."""

    def __init__(self, tokenizer, most: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.most = Tokenizer(tokenizer.model), most
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        self.size[list(vocab.values())] = [len(x) for x in vocab]
        self.release()

    def ids(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each distinct piece's ids begin, how many they are, the ids); END has none."""
        if self.known.nbytes + self.flat.nbytes + _SLOT * len(self.known) > self.most:
            self.release()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).copy()
        at[at < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            n, ids = self._encoded(new)
            self.known, self.n, self.flat = pa.concat_arrays([self.known, new]), np.append(self.n, n), np.append(self.flat, ids)
        return (np.cumsum(self.n) - self.n)[at], self.n[at], self.flat

    def _encoded(self, pieces: pa.StringArray, group: int = 500) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = string_buffers(pieces)
        said = np.insert(_CODES[raw], ends[1:-1], 32).tobytes().decode("utf-32-le")
        edges = [*(ends[:-1] + np.arange(len(pieces)))[::group].tolist(), len(said) + 1]
        got = self.model.encode_batch_fast([said[a : z - 1] for a, z in zip(edges, edges[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in got])
        upto = np.cumsum(self.size[ids])
        last = np.searchsorted(upto, ends[1:])
        if upto[-1] != ends[-1] or (upto[last] != ends[1:]).any():
            raise ValueError("the tokenizer file lacks bytes")
        return np.diff(last, prepend=-1), ids

    def release(self) -> None:
        self.known, self.n, self.flat = pa.array([END]), np.zeros(1, np.int64), np.zeros(0, "<u4")


class MemoTokenizer:
    def __init__(self, path: str, strip_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.strip = Tokenizer.from_file(path), strip_space
        self.pieces = (WORD_PIECES if strip_space else LATIN_BYTE_PIECES).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        half = MEMO_BYTES // 2
        self.memo = _Memo(self.tokenizer.model, MEMO_BYTES if strip_space else half)
        self.table = None if strip_space else _Table(self.tokenizer, half)

    @staticmethod
    def of(path: str, strip_space: bool) -> "MemoTokenizer":
        """strip_space: the file is the lower-casing word BPE that drops white space; else the byte-level BPE."""
        key = (path, strip_space)
        if key not in _open:
            _open[key] = MemoTokenizer(*key)
        return _open[key]

    def _latin(self, text: str) -> bool:
        return (text.isascii() or LATIN.fullmatch(text) is not None) and not ("<" in text and any(s in text for s in self.special))

    def _known(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text.lower() if self.strip else text)))

    def _known_together(self, texts: list[str]) -> list[bytes]:
        """_known of each text, for the byte-level file."""
        pieces, ends = latin_byte_pieces(texts)
        coded = pieces.dictionary_encode()
        begin, n, flat = self.table.ids(coded.dictionary)
        which = coded.indices.to_numpy()
        taken = n[which]
        upto = np.cumsum(taken)
        place = np.repeat(begin[which] - (upto - taken), taken) + np.arange(taken.sum())
        ids = flat[place].tobytes()
        bounds = [0, *(4 * upto[ends]).tolist()]
        return [ids[a:z] for a, z in zip(bounds, bounds[1:])]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        rest, places, together = [], [], []
        for i, t in enumerate(texts):
            odd = ODD.search(t)
            if not odd and self._latin(t):
                if self.strip:
                    out.append([self._known(t)])
                else:
                    together.append((i, t))
                    out.append([])
                continue
            parts = []
            for chunk in [t] if odd else CHUNK.findall(t):
                if not odd and self._latin(chunk):
                    parts.append(self._known(chunk))
                else:
                    rest.append(chunk)
                    places.append((i, len(parts)))
                    parts.append(b"")
            out.append(parts)
        if together:
            for (i, _), ids in zip(together, self._known_together([t for _, t in together])):
                out[i] = [ids]
        for a in range(0, len(rest), 4096):
            got = self.tokenizer.encode_batch(rest[a : a + 4096], add_special_tokens=False)
            for (i, k), e in zip(places[a : a + 4096], got):
                out[i][k] = array("I", e.ids).tobytes()
        return [b"".join(x) for x in out]

    def release(self) -> None:
        self.memo.release()
        if self.table:
            self.table.release()


_open: dict[tuple[str, bool], MemoTokenizer] = {}


def batches(texts: list[str], chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Index ranges of about chars characters each."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)

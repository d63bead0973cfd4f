"""Texts cut at boundaries that no token crosses, and distinct pieces encoded in batches.

The pattern of a byte-level tokenizer starts a new match at every white-space character that
follows another character: no alternative holds white space behind something else. Such a
place splits a text without changing its tokens, also beside special strings, which hold no
white space. Words repeat far more than texts, so a batch encodes each distinct piece once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Python's white space holds all that Unicode calls so, and four control characters more:
# it may cut less often than possible, never at a wrong place.
_RUN = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<!\s)(?: (?!\n)|(?=\n))")
_SPACE = re.compile(r"\s")
# Marks behind a letter or digit begin a match of their own; the apostrophe may not.
_MARKS = ".,!?;:*&%$#|\"()[]"


def cut(text: str) -> list[str]:
    """Pieces of ``text``. A piece that begins with a line break stands for itself; any other but the first
    for a space and itself. So a space before a line break is no cut: the piece behind it could not tell."""
    if _RUN.search(text):
        return _CUT.split(text)
    return text.replace("\n", " \n").split(" ")


def as_written(piece: str) -> str:
    """The stretch of text that a piece other than the first stands for."""
    return piece if piece[:1] == "\n" else " " + piece


def splits_at_spaces(path: str) -> bool:
    """Whether :func:`cut` is safe for the tokenizer file: byte-level pattern, no normaliser, plain specials."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not any(
                t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                for t in spec.get("added_tokens", [])))


class LibraryPieces:
    """Ids of pieces by the tokenizers library, many pieces to a call.

    Pieces that begin with a space or line break and hold no other white space are strung
    together: each begins a new match, so the ids of one start at the token that starts with
    its white space. The library's cost for each text it is given is saved, the ids are the same.
    """

    GROUP = 64
    # Texts to a call: what the library makes of a text is many times larger than its ids.
    CALL = 128

    def __init__(self, model):
        self.model = model
        vocab = model.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        # the letters that stand for a space and a line break in byte-level vocabularies
        self.opens[[i for token, i in vocab.items() if token[:1] in ("\u0120", "\u010a")]] = True

    def single(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for a in range(0, len(texts), self.CALL)
                for e in self.model.encode_batch_fast(texts[a:a + self.CALL], add_special_tokens=False)]

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit bytes."""
        plain = [i for i, p in enumerate(pieces) if p[:1] in (" ", "\n") and len(p) > 1 and not _SPACE.search(p, 1)]
        out: list = [None] * len(pieces)
        groups = [plain[a:a + self.GROUP] for a in range(0, len(plain), self.GROUP)]
        for group, ids in zip(groups, self.single(["".join([pieces[i] for i in g]) for g in groups])):
            starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(starts) != len(group):
                raise ValueError("pieces must begin with tokens of their own")
            data = ids.tobytes()
            for i, a, b in zip(group, starts, [*starts[1:], len(data)]):
                out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.single([pieces[i] for i in rest])):
            out[i] = ids.tobytes()
        return out


class PieceCache:
    """Values of pieces, made in batches by ``encode``; holds about ``limit`` pieces.

    Half of them make a generation: when one is full, the one before it goes, and what is asked for
    again passes to the next. So words stay and junk, which comes once, leaves.
    A value is what ``encode`` gives for the piece as written; values of neighbours add up. The
    first piece of a text has no space before it and is kept apart.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.spaced: dict = {}
        self.older: dict = {}
        self.first: dict = {}
        self.marks: dict = {}

    def tidy(self) -> None:
        if len(self.spaced) > self.limit // 2:
            self.older, self.spaced = self.spaced, {}
        for known in (self.first, self.marks):
            if len(known) > self.limit // 2:
                known.clear()

    def learn(self, pieces: set[str], first: set[str]) -> None:
        """Make values of unknown pieces; words are shared by the forms that differ in marks behind them."""
        split, wanted, marks = {}, set(), set()
        for piece in pieces:
            word = piece.rstrip(_MARKS)
            if word is not piece and word and (word[-1].isalpha() or word[-1].isdecimal()):
                split[piece] = word
                marks.add(piece[len(word):])
            else:
                word = piece
            wanted.add(word)
        self.spaced.update({w: self.older[w] for w in wanted if w in self.older})
        new = [w for w in wanted if w not in self.spaced]
        self.spaced.update(zip(new, self.encode([as_written(w) for w in new])))
        for known, asked in ((self.marks, marks), (self.first, first)):
            new = [x for x in asked if x not in known]
            known.update(zip(new, self.encode(new)))
        for piece, word in split.items():
            self.spaced[piece] = self.spaced[word] + self.marks[piece[len(word):]]

    def fetch(self, texts: list[str]) -> Iterable[list]:
        """The values of all pieces of each text, that of its first piece last.

        Pieces are looked up while they are fresh, text by text; only unknown ones are held
        until the batch has learnt them.
        """
        self.tidy()
        get, rows = self.spaced.get, []
        for text in texts:
            pieces = cut(text)
            head = pieces.pop(0)
            values = list(map(get, pieces))
            unknown = list(compress(pieces, map(is_, values, repeat(None)))) if None in values else ()
            rows.append((head, values, unknown))
        self.learn(set(chain.from_iterable(r[2] for r in rows)), {r[0] for r in rows})
        known = self.spaced.__getitem__
        for head, values, unknown in rows:
            if unknown:
                late = map(known, unknown)
                values = [next(late) if v is None else v for v in values]
            values.append(self.first[head])
            yield values


def by_bytes(texts: pa.Array, limit: int) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes each; a longer text makes a range of its own."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)

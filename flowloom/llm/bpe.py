"""Byte-pair encoding and decoding with an index of pair occurrences.

A task holds the distinct pieces of its texts as one array of symbols, linked to their
neighbours. The index maps each pair that has a merge rank to all its positions in the
partition. The lowest active rank is taken, all its occurrences are merged at once, and only
the lists of the pairs that this made are updated. Ranks ascend until none is active.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import whole
from flowloom.llm.pieces import PieceCache, by_bytes, cut, splits_at_spaces

# Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes of text that are encoded, decoded and sent on at a time.
BATCH_BYTES = 2 << 20
_MODELS: dict = {}


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairIndexBpe:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        if not splits_at_spaces(path):
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()], default=0) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = (bytes(letters[c] for c in token) if all(c in letters for c in token)
                                else token.encode())
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of_key]
        self.words = regex.compile(PATTERN)
        self.marks = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
                      if self.specials else None)
        self.cache = PieceCache(self._pieces)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        active: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enlist(at: np.ndarray) -> None:
            found = self.ranks(sym[at], sym[after[at]])
            some = found >= 0
            at, found = at[some], found[some]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for rank, part in zip(found[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if rank in active:
                    active[rank].append(part)
                else:
                    active[rank] = [part]
                    heapq.heappush(queue, rank)
        enlist(np.flatnonzero(after >= 0))
        while queue:
            rank = heapq.heappop(queue)
            parts = active.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = np.unique(at) if len(at) > 1 else at
            at = at[sym[at] == a]
            to = after[at]
            ok = (to >= 0) & (sym[to] == b)
            at, to = at[ok], to[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # of overlapping occurrences every second one is merged, from the left
                starts = np.r_[True, at[1:] != to[:-1]]
                i = np.arange(len(at))
                odd = (i - np.maximum.accumulate(np.where(starts, i, 0))) & 1
                at, to = at[odd == 0], to[odd == 0]
            sym[at], sym[to] = new, -1
            far = after[to]
            after[at] = far
            has = far >= 0
            before[far[has]] = at[has]
            left = before[at]
            enlist(np.concatenate([left[left >= 0], at[has]]))
        ids = sym[sym >= 0].astype("<u4")
        counts = np.add.reduceat((sym >= 0).astype(np.int64), np.r_[0, ends[:-1]]).tolist()
        data, out, at = ids.tobytes(), [], 0
        for c in counts:
            out.append(data[at:at + 4 * c])
            at += 4 * c
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each by itself: special strings first, then words by the pattern."""
        parts: list[list] = []
        known: dict[str, int] = {}
        for piece in pieces:
            own: list = []
            for text in self.marks.split(piece) if self.marks and self.marks.search(piece) else (piece,):
                if text in self.specials:
                    own.append(self.specials[text].to_bytes(4, "little"))
                else:
                    own += [known.setdefault(w, len(known)) for w in self.words.findall(text)]
            parts.append(own)
        ids = self.encode_words([w.encode() for w in known])
        return [ids[own[0]] if len(own) == 1 and isinstance(own[0], int) else
                b"".join(x if isinstance(x, bytes) else ids[x] for x in own) for own in parts]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes; the index spans all new pieces of the call."""
        cache = self.cache
        cache.tidy()
        spaced, first = set(), set()
        for text in texts:
            pieces = cut(text)
            first.add(pieces[0])
            spaced.update(pieces[1:])
        cache.learn({p for p in spaced if p not in cache.spaced}, first)
        for text in texts:
            pieces = cut(text)
            yield cache.first[pieces[0]] + b"".join(map(cache.spaced.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> str:
        """Text of ids, special ones included; bytes that form no character become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def model(path: str) -> PairIndexBpe:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBpe(path)
    return _MODELS[path]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False, with_text: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    ``ids`` are little-endian unsigned 32-bit numbers. Whole texts are encoded; null is the empty text, which has no ids. Ids of rows may be null
    or repeat. An empty table gives no rows. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    extra = (", ids binary" if with_ids else "") + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            # a range of texts at a time, each a batch of its own, whatever the rows of the batch hold
            for start, stop in by_bytes(batch.column("text"), batch_bytes):
                counts, digests, back, all_ids, texts = [], [], [], [], []
                for ids in bpe.encode(batch.column("text").slice(start, stop - start).to_pylist()):
                    text = bpe.decode(ids)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                    if with_text:
                        texts.append(text)
                columns = {"id": batch.column("id").slice(start, stop - start), "n_tokens": pa.array(counts, pa.int64()),
                           "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(all_ids, pa.binary())
                if with_text:
                    columns["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    out = rows.mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("id", id_col)

"""Blocks of documents with their words and pairs of words, and the messages between blocks and ranges.

A block holds whole documents as numbers of its own words, which are sorted by a 64-bit hash. Blocks
send sorted slices of their words and pairs to ranges of the hashes, where equal ones meet; ranges
answer with arrays in the order of the slice. The number of ranges follows from the number of tokens, so a
range holds about as much as a block. There are blocks times ranges of slices, with the square of the corpus: their
rows are cut out of whole arrays by offsets and read as one array again, with no work in Python for each.
Arrays of a block or range travel as byte planes under zstandard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowloom.llm.common import whole

HELD_OUT = (5, 1)
# Tokens per range of hashes.
RANGE_TOKENS = 1 << 19
# Bytes of text that are split into words at once.
SPLIT_BYTES = 1 << 20

MESSAGE = ("kind string, range int, block bigint, types string, words binary, a binary, b binary, c binary, d binary, e binary, "
           "f binary, n1 bigint, n2 bigint")
_ARROW = pa.schema([("kind", pa.string()), ("range", pa.int32()), ("block", pa.int64()), ("types", pa.string()),
                    ("words", pa.binary()), *[(x, pa.binary()) for x in "abcdef"], ("n1", pa.int64()), ("n2", pa.int64())])


def arrow_type(kind) -> pa.DataType:
    return to_arrow_type(kind)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers: the finalizer of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest type that holds them all."""
    if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
        return a.astype(np.min_scalar_type(a.max()), copy=False)
    return a


def pack(values: np.ndarray) -> bytes:
    """An array as its type and its byte planes, compressed; high planes that are all zero are left out."""
    a = np.ascontiguousarray(values)
    short = _short(a)
    planes = short.view(np.uint8).reshape(len(a), short.itemsize).T.tobytes()
    return (a.dtype.str.encode().ljust(4) + short.dtype.str.encode().ljust(4)
            + zstandard.ZstdCompressor(level=1).compress(planes))


def unpack(data: bytes) -> np.ndarray:
    kind, short = (np.dtype(data[i:i + 4].decode().strip()) for i in (0, 4))
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(short.itemsize, -1).T).view(short).ravel().astype(kind, copy=False)


def pack_sorted(values: np.ndarray) -> bytes:
    """A rising array by its differences, in its own type."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = unpack(data)
    return np.cumsum(steps, dtype=steps.dtype)


def pack_words(words: np.ndarray | bytes) -> bytes:
    """The bytes of words that are each followed by a space; words hold none."""
    return zstandard.ZstdCompressor(level=1).compress(words)


def unpack_words(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def word_ends(words: np.ndarray) -> np.ndarray:
    """Where words that are each followed by a space begin, and the end of all."""
    return np.r_[0, np.flatnonzero(words == 32) + 1]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between neighbouring ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)),
                                                              pa.py_buffer(np.ascontiguousarray(data))])


def word_array(words: np.ndarray) -> pa.Array:
    """Words that are each followed by a space, without it."""
    ends = word_ends(words)
    return binary(words[words != 32], ends - np.arange(len(ends)))


def with_spaces(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by a space, and their ends; the other way round of ``word_array``."""
    ends = np.r_[0, np.cumsum(pc.binary_length(words).to_numpy() + 1, dtype=np.int64)]
    out, inner = np.full(ends[-1], 32, np.uint8), np.ones(ends[-1], bool)
    inner[ends[1:] - 1] = False
    out[inner] = flat(words)
    return out, ends


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, one behind the other."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk) and chunk.buffers()[2] is not None:
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]])
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])


class Messages:
    """Rows of the one layout in which blocks and ranges talk."""

    def __init__(self):
        self.rows, self.slices = [], []

    def add(self, kind: str, **fields) -> None:
        self.rows.append({"kind": kind, **fields})

    def cut(self, kind: str, ranges, blocks, ends: np.ndarray, n1: int | None = None, words=None, **arrays: np.ndarray) -> None:
        """One row for each stretch between neighbouring ``ends`` of the arrays, to or from one of ``ranges`` and
        ``blocks`` (or the one); ``words`` has bytes and ends of its own."""
        n = len(ends) - 1
        columns, types = {}, []
        for name, values in arrays.items():
            short = np.ascontiguousarray(_short(values))
            columns[name] = binary(short.view(np.uint8).ravel(), ends * (short.nbytes // max(1, len(short))))
            types.append(f"{name}:{values.dtype.str}:{short.dtype.str if short.ndim == 1 else SEVEN}")
        if words is not None:
            columns["words"] = binary(*words)
        fixed = {"kind": kind, "range": ranges, "block": blocks, "types": " ".join(types), "n1": n1}
        for name, value in fixed.items():
            many = isinstance(value, np.ndarray)
            columns[name] = pa.array(value, _ARROW.field(name).type) if many else pa.repeat(
                pa.scalar(value, _ARROW.field(name).type), n)
        if n:
            self.slices.append(pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW))

    def table(self) -> pa.Table:
        return pa.concat_tables([pa.Table.from_pylist(self.rows, _ARROW), *self.slices])


def by_kind(messages: pa.Table) -> dict[str, pa.Table]:
    """Messages of each kind in the order of range and block."""
    out = {}
    for kind in pc.unique(messages["kind"]).to_pylist():
        rows = messages.filter(pc.equal(messages["kind"], kind))
        place = [pc.fill_null(rows[x], 0).to_numpy() for x in ("block", "range")]
        out[kind] = rows.take(pa.array(np.lexsort(place))).combine_chunks()
    return out


def only(rows: pa.Table) -> dict:
    """The fields of the one row of its kind."""
    return rows.slice(0, 1).to_pylist()[0]


# The low seven bytes of hashes, whose range tells the first one.
SEVEN = "7"


def low(names: np.ndarray, bits: int) -> np.ndarray:
    """What tells hashes of one range apart."""
    return names if bits < 8 or not len(names) else np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, :7]


def _types(rows: pa.Table, field: str) -> list[tuple[str, str, str]]:
    """Each text of types, the type of the field and the one it travels in."""
    known = []
    for text in pc.unique(rows["types"]).to_pylist():
        name, kind, short = next(x for x in (part.split(":") for part in text.split(" ")) if x[0] == field)
        known.append((text, kind, short))
    return known


def _values(raw: np.ndarray, kind: str, short: str) -> np.ndarray:
    if short != SEVEN:
        return raw.view(np.dtype(short)).astype(kind, copy=False)
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = raw.reshape(-1, 7)
    return out.view(np.uint64).ravel()


def joined(rows: pa.Table, field: str) -> np.ndarray:
    """The arrays of all rows, one behind the other."""
    known = _types(rows, field)
    if len(known) == 1:
        return _values(flat(rows[field]), *known[0][1:])
    parts, sizes = [], layout(rows, field)[1]
    starts = np.cumsum(sizes) - sizes
    for text, kind, short in known:
        of = pc.equal(rows["types"], text)
        at, n = starts[of.to_numpy()], sizes[of.to_numpy()]
        values = _values(flat(rows.filter(of)[field]), kind, short)
        parts.append((np.arange(len(values)) + np.repeat(at - (np.cumsum(n) - n), n), values))
    out = np.empty(sizes.sum(), np.result_type(*[values.dtype for _, values in parts]))
    for at, values in parts:
        out[at] = values
    return out


def range_bits(tokens: int) -> int:
    """Leading bits of a hash that name its range."""
    return min(30, max(1, (max(1, tokens) // RANGE_TOKENS).bit_length()))


def cut(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the slices of sorted hashes."""
    top = (names >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else []
    for a, b in zip(starts, np.r_[starts[1:], len(top)] if len(top) else []):
        yield int(top[a]), int(a), int(b)


# --- blocks ------------------------------------------------------------------------------

def held_out(doc_id) -> bool:
    """Whether a document is held out: crc32 of its id as text (null: no text) leaves the remainder 1 by 5."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _split(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and lists of words of some documents at a time; every list ends in an empty word.

    Lower-cases A-Z only, and splits at the six white-space characters only.
    """
    ids, texts, start = batch.column("id").to_pylist(), batch.column("text"), 0
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    while start < len(ids):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right")))
        some = pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(start, end - start)))
        # what follows the last space is empty; the empty text itself is one empty word
        some = pc.if_else(pc.equal(pc.binary_length(some), 0), "", pc.binary_join_element_wise(some, "", " "))
        yield ids[start:end], pc.ascii_split_whitespace(some)
        start = end


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of about ``block_tokens``: words sorted by hash, training counts, documents as numbers of words."""
    rows = docs.select(F.col("doc_id").alias("id"), whole("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words, lengths, doc_ids = [], [], []

        def flush():
            coded = pa.concat_arrays(words).dictionary_encode()
            spaced, ends = with_spaces(coded.dictionary)
            listed = spaced.tobytes()[:-1].split(b" ")
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))
            order = np.argsort(names, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            ids = rank[coded.indices.to_numpy()]
            apart, sizes = np.array([held_out(x) for x in doc_ids], bool), np.concatenate(lengths)
            train = np.bincount(ids[np.repeat(~apart, sizes)], minlength=len(order))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()),
                 pa.array([pack_words(flat(binary(spaced, ends).take(pa.array(order))))], pa.binary()),
                 pa.array([pack_sorted(names[order])], pa.binary()), pa.array([pack(train)], pa.binary()),
                 pa.array([doc_ids], pa.list_(id_type)), pa.array([apart], pa.list_(pa.bool_())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())],
                names=["block", "words", "names", "train", "doc_ids", "held_out", "lengths", "ids"])
        tokens = 0
        for batch in batches:
            id_type = batch.column("id").type
            for ids, split in _split(batch):
                sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
                ends, values, start = np.r_[0, np.cumsum(sizes)], split.flatten(), 0
                while start < len(ids):
                    # the document that fills the block ends it
                    full = np.searchsorted(ends[1:], ends[start] + block_tokens - tokens)
                    end = min(len(ids), max(start, int(full)) + 1)
                    words.append(values.slice(ends[start], ends[end] - ends[start]))
                    lengths.append(sizes[start:end])
                    doc_ids += ids[start:end]
                    tokens += int(ends[end] - ends[start])
                    start = end
                    if tokens >= block_tokens:
                        yield flush()
                        words, lengths, doc_ids, tokens, number = [], [], [], 0, number + 1
                        # the worker stays for later steps, whose memory this would be
                        pa.default_memory_pool().release_unused()
        if doc_ids:
            yield flush()
    return rows.mapInArrow(run, f"block bigint, words binary, names binary, train binary, doc_ids array<{kind}>, "
                                "held_out array<boolean>, lengths array<bigint>, ids binary")


class Pairs:
    """The distinct pairs of neighbours in a block, by the numbers of their words.

    The word before the first one of a document is an end, the last token of every document.
    """

    def __init__(self, row: dict, named: bool = True):
        self.ids = unpack(row["ids"])
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens = np.r_[self.ids[-1:], self.ids[:-1]].astype(np.uint64) << np.uint64(32) | self.ids
        if named:
            apart = np.repeat(np.array(row["held_out"], bool), self.lengths)
            keys = self.tokens << np.uint64(1) | apart
            keys.sort()
            pair = keys >> np.uint64(1)
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            self.train = np.add.reduceat(1 - (keys & np.uint64(1)).astype(np.int64), first)
            pair = pair[first]
        else:
            pair = np.sort(self.tokens)
            pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
        self.keys, (self.u, self.w) = pair, halves(pair)
        if named:
            names = unpack_sorted(row["names"])
            self.names = mix(mix(names[self.u]) + names[self.w])
            self.order = np.argsort(self.names)

    def from_names(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of hashes, put in the order of pairs."""
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def places(self) -> np.ndarray:
        """The pair of each token."""
        order = np.argsort(self.tokens)
        ranked = self.tokens[order]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        return out


# --- messages ----------------------------------------------------------------------------

def _ends(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of sorted hashes, and where each begins with the end of all."""
    cuts = np.array([(r, a) for r, a, _ in cut(names, bits)], np.int64).reshape(-1, 2)
    return cuts[:, 0], np.r_[cuts[:, 1], len(names)]


def word_slices(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, names = unpack_words(batch.column("words")[i].as_py()), unpack_sorted(batch.column("names")[i].as_py())
                (ranges, ends), out = _ends(names, bits), Messages()
                out.cut("slice", ranges, batch.column("block")[i].as_py(), ends, words=(words, word_ends(words)[ends]),
                        a=low(names, bits), b=unpack(batch.column("train")[i].as_py()))
                yield from out.table().to_batches()
    return rows.select("block", "words", "names", "train").mapInArrow(run, MESSAGE)


def lexicon(messages: pa.Table) -> pa.Table:
    """The words of a range with their training counts, and for each slice where its words stand."""
    slices, out = by_kind(messages)["slice"], Messages()
    names, first, at = np.unique(joined(slices, "a"), return_index=True, return_inverse=True)
    words = flat(slices["words"])
    words = binary(words, word_ends(words)).take(pa.array(first))
    c = np.bincount(at, joined(slices, "b"), len(names)).astype(np.int64)
    of = slices["range"][0].as_py()
    out.add("words", range=of, words=pack_words(flat(words)), a=pack(c), n1=int(c.sum()), n2=int((c > 0).sum()))
    out.cut("at", of, slices["block"].to_numpy(), ends_of(slices, "a"), a=at.astype(np.int32), b=c[at])
    return out.table()


def pair_slices(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pairs, out = Pairs(row), Messages()
                names = pairs.names[pairs.order]
                ranges, ends = _ends(names, bits)
                out.cut("slice", ranges, row["block"], ends, a=low(names, bits), b=pairs.train[pairs.order])
                yield from out.table().to_batches()
    return rows.mapInArrow(run, MESSAGE)


def totals(messages: pa.Table) -> pa.Table:
    """Table-wide counts for the pairs of each slice, and whether its block is the first that holds them."""
    slices, out = by_kind(messages)["slice"], Messages()
    _, first, at = np.unique(joined(slices, "a"), return_index=True, return_inverse=True)
    c = np.bincount(at, joined(slices, "b"), len(first)).astype(np.int64)
    own = np.zeros(len(at), bool)
    own[first] = True
    out.cut("total", slices["range"][0].as_py(), slices["block"].to_numpy(), ends_of(slices, "a"), a=c[at], b=own)
    return out.table()


def halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of pairs that are kept in one number."""
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def counted(at: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, size).astype(np.int64)


def layout(slices: pa.Table, field: str) -> tuple[np.ndarray, np.ndarray]:
    """The range of each slice and how many values it has."""
    size = {text: 7 if short == SEVEN else np.dtype(short).itemsize for text, _, short in _types(slices, field)}
    texts = slices["types"].combine_chunks().dictionary_encode()
    each = np.array([size[x] for x in texts.dictionary.to_pylist()], np.int64)[texts.indices.to_numpy()]
    return slices["range"].to_numpy().astype(np.int64), pc.binary_length(slices[field]).to_numpy().astype(np.int64) // each


def ends_of(slices: pa.Table, field: str) -> np.ndarray:
    """Where each slice begins in the joined array, with the end of all."""
    return np.r_[0, np.cumsum(layout(slices, field)[1])]


def send_sums(out: Messages, block: int, load, customers, at, ranges, sizes) -> None:
    """Tables of a block's own pairs, summed by the word before and by the word itself, to the words' ranges."""
    out.cut("sum", ranges, block, np.r_[0, np.cumsum(sizes)], a=at, b=load, c=customers)


def customers(messages: pa.Table) -> pa.Table:
    """The words of a range with the tables of their own restaurants (b) and their customers in the parent's (c)."""
    told, out = by_kind(messages), Messages()
    if "words" in told:
        row = only(told["words"])
        size = len(unpack(row["a"]))
        load, n = (np.zeros(size, np.int64) for _ in range(2))
        if "sum" in told:
            at = joined(told["sum"], "a")
            load, n = (counted(at, size, joined(told["sum"], x)) for x in "bc")
        out.add("words", range=row["range"], words=row["words"], a=row["a"], b=pack(load), c=pack(n), n1=int(n.sum()))
    return out.table()


def vocabulary(state: DataFrame) -> DataFrame:
    """``word`` and ``c``, its customers in the restaurant of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, n = word_array(unpack_words(batch.column("words")[i].as_py())), unpack(batch.column("c")[i].as_py())
                for a in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([words[a:a + (1 << 16)], pa.array(n[a:a + (1 << 16)], pa.int64())],
                                                     names=["word", "c"])
    return state.select("words", "c").mapInArrow(run, "word binary, c bigint")

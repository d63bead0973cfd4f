"""Token ids, counts and byte-pair encoding against the libraries."""

import hashlib
import itertools
from decimal import Decimal
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm.bit_planes import bit_plane_ids, pack, unpack, write_ids, read_ids
from flowloom.llm.bpe import bpe_round_trip, model
from flowloom.llm.common import workspace
from flowloom.llm.pieces import LibraryPieces, PieceCache, as_written, cut
from flowloom.llm.token_counts import counter, token_counts
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def little(values):
    return np.array(values, "<u4").tobytes()


def test_junk_leaves_the_piece_cache_and_words_stay():
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [p.encode() for p in pieces]
    cache = PieceCache(encode, 100)
    for turn in range(20):
        text = "a the " + " ".join(f"junk{turn}x{i}" for i in range(20)) + " the"
        (values,) = cache.fetch([text])
        assert values.pop() + b"".join(values) == text.encode()
        assert len(cache.spaced) + len(cache.older) <= 100 + 2 * 21
    assert asked.count(" the") == 1


def test_library_gets_few_texts_at_a_time():
    sizes = []

    class Model:
        def get_vocab(self, with_added_tokens):
            return {}

        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return LIBRARY.encode_batch_fast(texts, add_special_tokens=add_special_tokens)
    texts = [f"text {i}" for i in range(300)]
    got = LibraryPieces(Model()).single(texts)
    assert [x.tolist() for x in got] == [ids(t) for t in texts] and max(sizes) <= 128


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 4097])
def test_planes_round_trip(n, bits):
    values = (np.arange(n) * 2_654_435_761 % 2 ** 32).astype("<u4")
    data, sizes = pack(values, 512, bits)
    assert len(sizes) == -(-n // 512) * (32 if bits else 4)
    assert np.array_equal(unpack(data, sizes, n, 512, bits), values)


@pytest.mark.parametrize("bits", [False, True])
def test_written_ids(spark, docs, bits):
    options = {"block_ids": 100, "bits": bits}
    folder = workspace(spark)
    chunks, index = write_ids(docs, folder, PATH, chunk_ids=500, batch_bytes=300, **options)
    got = read_ids(chunks, index, with_ids=True, **options).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    start = 0
    for row, (_, text) in zip(got, order):
        want = [*ids(text), 0]
        assert (row.start, row.n_tokens, row.ids_crc32, row.ids) == (start, len(want), zlib.crc32(little(want)), want)
        start += len(want)
    assert index.agg({"n_ids": "sum"}).first()[0] == start


def test_token_counts(spark, docs):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH, batch_bytes=50).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in TEXTS)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_libraries_read_whole_texts(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in TEXTS]
    if name.endswith(".model"):
        import sentencepiece
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counter(path)(texts) == want


def test_bpe_round_trip(spark, docs):
    rows = bpe_round_trip(docs, PATH, with_ids=True).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in rows)
    assert got == sorted((i or 0, len(ids(t)), hashlib.sha256(little(ids(t))).hexdigest(),
                          hashlib.sha256(LIBRARY.decode(ids(t), skip_special_tokens=False).encode()).hexdigest(),
                          little(ids(t))) for i, t in TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abesti' \n\t.,!0 　\x1c\x85éÄ中<|>"), max_size=40), min_size=1, max_size=5))
def test_every_text_encodes_like_the_library(texts):
    texts = [t.replace("<>", "<|endoftext|>") for t in texts]
    want = [little(ids(t)) for t in texts]
    assert list(model(PATH).encode(texts)) == want
    assert counter(PATH)(texts) == [len(w) // 4 for w in want]
    assert [model(PATH).decode(w) for w in want] == [LIBRARY.decode(ids(t), skip_special_tokens=False) for t in texts]
    for t in texts:
        first, *rest = cut(t)
        assert first + "".join(map(as_written, rest)) == t


@pytest.mark.parametrize("text", ["a \nb", " \nb", "a \n", "a \n\nb \n", "a b \n c", "x \n y\n z "])
def test_spaces_before_line_breaks_are_kept(text):
    first, *rest = cut(text)
    assert first + "".join(map(as_written, rest)) == text
    assert list(model(PATH).encode([text])) == [little(ids(text))]
    assert counter(PATH)([text]) == [len(ids(text))]


def test_decoding_broken_characters():
    some = ids("中文字é")[:1] + ids("é")[:1]
    assert model(PATH).decode(little(some)) == LIBRARY.decode(some, skip_special_tokens=False)


def test_empty_tables(nothing):
    assert bit_plane_ids(nothing, PATH).count() == 0
    assert token_counts(nothing, PATH).count() == 0
    assert bpe_round_trip(nothing, PATH).count() == 0


def test_ids_of_any_type_and_repeated(spark):
    """Decimal ids, one of them on many rows, and null ids come back as they were."""
    rows = [(Decimal("7.5"), f"text number {i}") for i in range(40)] + [(None, "no id"), (None, None), (Decimal("1.0"), "one")]
    df = spark.createDataFrame(rows, "doc_id decimal(10,1), text string")
    got = bit_plane_ids(df, PATH).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert sorted(r.start for r in got) == [0, *itertools.accumulate(r.n_tokens for r in sorted(got, key=lambda r: r.start))][:-1]

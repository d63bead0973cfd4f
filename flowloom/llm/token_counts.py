"""Token counts: batches balanced by bytes, encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import whole
from flowloom.llm.pieces import PieceCache, by_bytes, splits_at_spaces

BATCH_BYTES = 4 << 20

_COUNTERS: dict = {}


def counter(path: str):
    """Function from a list of texts to their token counts, as the file's library counts them.

    ``.model`` files are read by sentencepiece, others by tokenizers; neither adds begin or end
    tokens, cuts or pads. Kept for the life of a worker.
    """
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            _COUNTERS[path] = _library(path)
    return _COUNTERS[path]


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    if not splits_at_spaces(path):
        return lengths
    cache = PieceCache(lengths)

    def by_pieces(texts: list[str]) -> list[int]:
        return [sum(values) for values in cache.fetch(texts)]
    return by_pieces


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Whole texts are counted, however long: they are cut at places that no token crosses where
    the file allows it, and encoded whole where not. Null is the empty text and has no tokens.
    Ids may be null or repeat; rows keep their number. No shuffle.
    """
    wanted = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_type = wanted.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = []
            for start, stop in by_bytes(batch.column("text"), batch_bytes):
                counts += lengths(texts[start:stop])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64())], names=["id", "n_tokens"]).append_column(
                    "n_bytes", pa.compute.binary_length(batch.column("text")).cast(pa.int64()))

    import pyarrow.compute  # noqa: F401
    out = wanted.mapInArrow(count, f"id {id_type}, n_tokens bigint, n_bytes bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Token ids on disk as compressed planes.

Documents are dealt out by ranges of their id; each task is a shard and encodes its documents
in order. Ids are gathered into chunks of whole documents. Inside a chunk, blocks of a fixed
number of ids are transposed into byte planes (all first bytes, all second bytes ...) or bit
planes, and every plane is compressed by itself with zstandard: the high planes of small ids
are nearly constant. A chunk is one row of a Parquet table; an index table names its place,
its sizes and the position of its first id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import whole, workspace, written
from flowloom.llm.pieces import LibraryPieces, PieceCache, by_bytes, splits_at_spaces
from flowloom.operators.scan import Running, keyed_scan

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
LEVEL = 1
BATCH_BYTES = 1 << 20
# Pieces whose ids a worker keeps; idle workers keep them, too.
PIECES = 1 << 17

CHUNKS = ("shard int, chunk int, start bigint, n_ids bigint, doc_ids array<{id}>, doc_tokens array<bigint>, "
          "plane_sizes array<int>, planes binary")

_ENCODERS: dict = {}


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """Planes of ``ids`` (unsigned 32 bit), block by block, and the compressed size of each plane."""
    codec, out = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), block_ids):
        planes = ids[at:at + block_ids].astype("<u4").view(np.uint8).reshape(-1, 4).T
        if bits:
            planes = np.packbits(np.unpackbits(planes, axis=0).reshape(4, 8, -1), axis=2).reshape(32, -1)
        out += [codec.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return b"".join(out), [len(x) for x in out]


def unpack(planes: bytes, sizes: list[int], n_ids: int, block_ids: int = BLOCK_IDS, bits: bool = False) -> np.ndarray:
    """The ids that :func:`pack` was given."""
    codec, out, at = zstandard.ZstdDecompressor(), [], 0
    depth = 32 if bits else 4
    for b in range(0, len(sizes), depth):
        n, rows = min(block_ids, n_ids - b // depth * block_ids), []
        for size in sizes[b:b + depth]:
            rows.append(np.frombuffer(codec.decompress(planes[at:at + size]), np.uint8))
            at += size
        block = np.stack(rows)
        if bits:
            block = np.packbits(np.unpackbits(block.reshape(4, 8, -1), axis=2)[:, :, :n].reshape(32, n), axis=0)
        out.append(np.ascontiguousarray(block.T).view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, "<u4")


def id_encoder(path: str):
    """Function from texts to their ids as little-endian 32-bit bytes, by the tokenizers library; one per worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        pieces = LibraryPieces(model)

        def encode(texts: list[str]) -> list[bytes]:
            return [ids.tobytes() for ids in pieces.single(texts)]
        cache = PieceCache(pieces, PIECES)

        def by_pieces(texts: list[str]) -> list[bytes]:
            out = []
            for values in cache.fetch(texts):
                first = values.pop()
                out.append(first + b"".join(values))
            return out
        _ENCODERS[path] = by_pieces if splits_at_spaces(path) else encode
    return _ENCODERS[path]


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
              block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, bits: bool = False,
              batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode all documents in ascending id order; returns the written tables of chunks and of the index.

    Each document ends with ``end_id``; null text is the empty text, null ids come first, rows
    that repeat an id are ordered by text. A document longer than a chunk makes one of its own.
    Memory holds one chunk and one batch of texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids_of = TaskContext.get().partitionId(), id_encoder(path)
        held, names, counts, start, n_held, chunk = [], [], [], 0, 0, 0

        def flush():
            data, sizes = pack(np.frombuffer(b"".join(held), "<u4"), block_ids, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([n_held], pa.int64()), pa.array([names], pa.list_(batch.column("id").type)), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["shard", "chunk", "start", "n_ids", "doc_ids", "doc_tokens", "plane_sizes", "planes"])
        for batch in batches:
            doc_ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for a, b in by_bytes(texts, batch_bytes):
                for doc_id, data in zip(doc_ids[a:b], ids_of(texts.slice(a, b - a).to_pylist())):
                    n = len(data) // 4 + 1
                    if held and n_held + n > chunk_ids:
                        yield flush()
                        start, chunk = start + n_held, chunk + 1
                        held, names, counts, n_held = [], [], [], 0
                    held += [data, end]
                    names.append(doc_id)
                    counts.append(n)
                    n_held += n
        if held:
            yield flush()

    # equal and null ids may spread over tasks, too
    ordered = (rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash")
               .sortWithinPartitions("id", "hash", "text").drop("hash"))
    chunks = written(ordered.mapInArrow(encode, CHUNKS.format(id=id_type)), folder, "chunks")
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    bases = keyed_scan(sums, [], "shard", [Running("base", F.col("ids"), inclusive=False)], width=1 << 10)
    index = chunks.select("shard", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"), "plane_sizes").join(
        bases.select("shard", "base"), "shard").select(
            "shard", "chunk", (F.col("base") + F.col("start")).alias("start"), "n_ids", "n_docs", "plane_sizes")
    return chunks, written(index, folder, "index")


def read_ids(chunks: DataFrame, index: DataFrame, id_col: str = "doc_id", block_ids: int = BLOCK_IDS,
             bits: bool = False, with_ids: bool = False) -> DataFrame:
    """Documents of written tables: id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    extra = ", ids array<bigint>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["plane_sizes"], row["n_ids"], block_ids, bits)
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                parts = [ids[e - n:e] for e, n in zip(ends, counts)]
                columns = [pa.array([row["shard"]] * len(parts), pa.int32()),
                           pa.array([row["chunk"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], batch.column("doc_ids").type.value_type),
                           pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "chunk", "id", "inside", "n_tokens", "crc"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = chunks.select("shard", "chunk", "n_ids", "doc_ids", "doc_tokens", "plane_sizes", "planes").mapInArrow(
        decode, f"shard int, chunk int, id {id_type}, inside bigint, n_tokens bigint, crc bigint{extra}")
    out = docs.join(index.select("shard", "chunk", "start"), ["shard", "chunk"])
    return out.select(F.col("id").alias(id_col), (F.col("start") + F.col("inside")).alias("start"), "n_tokens",
                      F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []))


def bit_plane_ids(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write all documents and read them back; an empty table gives no rows."""
    folder = workspace(docs.sparkSession)
    chunks, index = write_ids(docs, folder, path, **options)
    kept = {k: v for k, v in options.items() if k in ("id_col", "block_ids", "bits")}
    return read_ids(chunks, index, **kept)

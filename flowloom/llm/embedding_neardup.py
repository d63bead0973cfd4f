"""Near-duplicate vectors by p-stable hashing under Euclidean distance, verified by exact cosine.

A table of the index projects each normalised vector on k Gaussian directions, shifts and
quantises the projections with a fixed width, and hashes the k integers to the code of a bucket. Two
unit vectors at distance c fall into one interval of width w with a probability that depends on
w / c only, so k follows from the number of vectors to be told apart (about one stranger in a bucket) and
the number of tables from the miss allowed at the cosine that is asked for. Both come from
counts of the whole table; no bucket is cut and nothing is sampled.

Equal vectors of a label form a class and are indexed once. Codes are narrow; the vectors
themselves travel only to buckets with company. A bucket is cut into blocks and each pair of blocks is
one group of rows, so a large group of near copies spreads over tasks. Tasks return for each
class how many rows it links with, and a spanning forest of the links; a pair counts in the
first table in which its codes agree, so no pair is written anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import partitions, with_group_facts, workspace, written
from flowloom.llm.components import components

COSINE = 0.98
# Width of an interval, in units of the unit sphere; the exponent of the cost is flat around it.
WIDTH = 2.0
# Chance that a pair exactly at the threshold shares no bucket; closer pairs are missed less.
MISS = 1e-5
# Classes of one block of a bucket.
BLOCK = 512
# Groups up to this size are compared by shifting rows against each other, larger ones as matrices.
SMALL = 24
SEED = 20_011
LINK_SCHEMA = "a bigint, b bigint, links bigint"


def same_interval(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance share the interval of one Gaussian projection."""
    r = width / max(distance, 1e-12)
    return (math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2)))


def index_shape(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(projections of a table, tables) that tell ``n`` unrelated vectors apart and miss at most ``miss``."""
    near, far = same_interval(math.sqrt(max(0.0, 2 - 2 * cosine))), same_interval(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-near ** k))


def directions(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections, shifts and mixing multipliers of vectors of ``dim`` components; the same in every task."""
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((dim, tables * k))
    return a, rng.uniform(0, WIDTH, tables * k), rng.integers(1, 1 << 62, (tables, k), dtype=np.uint64) * 2 + 1


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(rows: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The 32-bit bucket code of each unit row in each table."""
    a, shift, mix = directions(rows.shape[1], k, tables)
    cells = np.floor((rows @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64)
    sums = (cells.reshape(len(rows), tables, k) * mix[None]).sum(axis=2, dtype=np.uint64)
    sums ^= sums >> np.uint64(29)
    return ((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length among the lists of a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def coded(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, tables), np.uint32)
            for at, rows in _vectors(batch.column("vec")):
                out[at] = codes(unit(rows), k, tables)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in out], pa.binary())], names=[*batch.schema.names, "codes"])
    return run


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (row, other) that connect what the symmetric boolean matrix connects."""
    free = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            node = queue.pop()
            fresh = np.flatnonzero(linked[node] & free)
            free[fresh] = False
            queue.extend(fresh.tolist())
            yield from ((int(x), node) for x in fresh)


def _links(table: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links inside whole groups of rows that are sorted by group."""
    x, y, own = (table.column(c).to_numpy() for c in ("x", "y", "own"))
    nth, cls, rows = (table.column(c).to_numpy() for c in ("t", "cls", "rows"))
    group = table.column("bucket").to_numpy()
    new = np.flatnonzero((np.diff(group) != 0) | (np.diff(nth) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(cls)]])
    code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint32).reshape(len(cls), -1)
    (_, vec), = _vectors(table.column("vec"))
    vec = unit(vec)
    degree: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def add(at: np.ndarray, amount: np.ndarray) -> None:
        for c, n in zip(cls[at].tolist(), amount.tolist()):
            degree[c] = degree.get(c, 0) + n

    def first_here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs whose codes agree in no table before the one of their group."""
        return (code[i] == code[j]).argmax(axis=1) == nth[i]

    sizes = ends - starts
    # groups by size: rows of small ones against the rows d further on
    small = np.repeat(sizes <= SMALL, sizes)
    end_of = np.repeat(ends, sizes)
    for d in range(1, min(SMALL, int(sizes.max()))):
        i = np.flatnonzero(small & (np.arange(len(cls)) + d < end_of))
        j = i + d
        # two blocks meet: pairs inside one of them belong to another group
        met = (x[i] == y[i]) | (own[i] != own[j])
        i, j = i[met], j[met]
        near = np.einsum("ij,ij->i", vec[i], vec[j]) >= cosine
        i, j = i[near], j[near]
        first = first_here(i, j)
        i, j = i[first], j[first]
        add(i, rows[j])
        add(j, rows[i])
        edges.extend(zip(cls[i].tolist(), cls[j].tolist()))
    for lo, hi in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist()):
        near = vec[lo:hi] @ vec[lo:hi].T >= cosine
        np.fill_diagonal(near, False)
        if x[lo] != y[lo]:
            near &= own[lo:hi, None] != own[None, lo:hi]
        at = np.flatnonzero(near.any(axis=1)) + lo
        if not len(at):
            continue
        edges.extend((int(cls[lo + a]), int(cls[lo + b])) for a, b in _forest(near))
        t = int(nth[lo])
        for before in range(t):
            near &= code[lo:hi, None, before] != code[None, lo:hi, before]
        add(np.arange(lo, hi), near.astype(np.int64) @ rows[lo:hi])
    pairs = [*((c, None, n) for c, n in degree.items() if n), *((a, b, None) for a, b in set(edges))]
    if not pairs:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b", "links"])


def compared(cosine: float):
    """Links of the groups of a partition, which comes sorted by group; holds one batch and one group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            last = [held.column(c)[-1].as_py() for c in ("dim", "bucket", "t", "x", "y")]
            same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("dim", "bucket", "t", "x", "y"), last)])
            cut = held.num_rows - int(same.sum())
            # the last group may go on in the next batch
            yield from of_one_length(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from of_one_length(held)

    def of_one_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        dims = table.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for lo, hi in zip(cuts, cuts[1:]):
            found = _links(table.slice(lo, hi - lo).combine_chunks(), cosine)
            if found is not None:
                yield found
    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Rows of equal label and equal length of vector link when their cosine, in double precision, is at
    least ``cosine``. A null label, and a vector that is null, empty, all zero or holds a null or
    non-finite component, links with nothing; such a row is its own component. ``component_id`` is the
    smallest id that links reach, null only where no id in reach is known; the row that bears it is kept. Rows that
    repeat an id are rows of their own, each of which may count the other as a link. An empty
    table gives no rows. Only the three columns are read, so others may have any name.
    """
    spark = rows.sparkSession
    folder = workspace(spark)
    vec = F.col(vec_col)
    if not isinstance(rows.schema[vec_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        vec = vec.cast("array<double>")
    fine = (F.col(label_col).isNotNull() & vec.isNotNull() & F.exists(vec, lambda v: v != 0)
            & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    named = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(fine, vec).alias("vec"))
    # 128 bits stand for label and vector wherever rows and classes meet again
    named = named.select("id", "label", "vec", *[F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(s), "label", "vec")).alias(h)
                                                 for s, h in ((1, "h1"), (2, "h2"))])
    narrow = written(named.select("id", "h1", "h2"), folder, "rows")
    grouped = named.where(F.col("vec").isNotNull()).groupBy("label", "vec", "h1", "h2").agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    classes = written(grouped.select("h1", "h2", "rows", "least", F.xxhash64("label", F.size("vec")).alias("part"), "vec")
                      .withColumn("cls", F.monotonically_increasing_id()), folder, "classes")

    most = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    k, tables = index_shape(most, cosine, miss)
    index = written(classes.select("cls", "rows", "part", "vec").mapInArrow(
        coded(k, tables), f"cls bigint, rows bigint, part bigint, vec {classes.schema['vec'].dataType.simpleString()}, codes binary"),
        folder, "index")
    entries = index.select("cls", "part", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"), "codes").select(
        "cls", "t", F.xxhash64("part", F.substring("codes", F.col("t") * 4 + 1, F.lit(4))).alias("bucket"))
    company = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = entries.join(company, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select(
        "cls", "t", "bucket", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("own"), "blocks")
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "cls", "t", "bucket", "own", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
    group = ["dim", "bucket", "t", "x", "y"]
    brought = (met.join(index.select("cls", "rows", "vec", "codes", F.size("vec").alias("dim")), "cls")
               .repartition(partitions(spark), "bucket", "t", "x", "y").sortWithinPartitions(*group))
    links = written(brought.mapInArrow(compared(cosine), LINK_SCHEMA), folder, "links")

    roots = components(links.where("b is not null").select("a", "b"), folder, "stars")
    degree = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    least = roots.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("lowest"))
    facts = (classes.select("cls", "h1", "h2", "rows", "least")
             .join(degree, "cls", "left")
             .join(roots.join(least, "root").select(F.col("node").alias("cls"), "lowest"), "cls", "left")
             .select("h1", "h2", "rows", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("lowest", "least").alias("lowest")))
    facts = written(facts, folder, "facts")
    linked = with_group_facts(narrow.where(F.col("h1").isNotNull()), facts, ["h1", "h2"], "rows", narrow.count())
    done = linked.select("id", "n_links", "lowest").union(
        narrow.where(F.col("h1").isNull()).select("id", F.lit(0).cast("bigint"), "id"))
    return done.select(F.col("id").alias(id_col), "n_links", F.col("lowest").alias("component_id"),
                       F.col("id").eqNullSafe(F.col("lowest")).alias("kept"))

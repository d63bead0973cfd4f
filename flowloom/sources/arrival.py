"""Arrival order of records that carry none: places of file lines and of queue records.

A place is a text that sorts as its parts do: when the file or record came, from where, and its position there.
Places of all sources compare with each other and none repeats, so both sensors of a merge share one order, in
batch as in a stream, where a row number over all files cannot exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Digits of microseconds, byte positions and line numbers.
TIME_DIGITS, START_DIGITS, LINE_DIGITS = 17, 16, 12
# Bytes of a block of a file, part of the place of its lines.
FILE_BLOCK = 128 << 20


def place(time_us: Column, source: Column, start: Column, line: Column) -> Column:
    """Sortable place; ``source`` must hold no space. Times before 1970 and null times come first."""
    def digits(c: Column, n: int) -> Column:
        return F.lpad(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint").cast("string"), n, "0")
    return F.concat_ws(" ", digits(time_us, TIME_DIGITS), source, digits(start, START_DIGITS), digits(line, LINE_DIGITS))


def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``line`` counts the rows of each block of a file; a task reads blocks one after the other."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, start = batch.column("path").to_pylist(), batch.column("start").to_numpy()
        paths = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(paths) != 0) | (np.diff(start) != 0)) + 1
        first = np.concatenate([[0], cuts])
        line = np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))
        if (path[0], start[0]) == last:
            line[:cuts[0] if len(cuts) else n] += seen
        last, seen = (path[-1], start[-1]), int(line[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line, pa.int64())], names=[*batch.schema.names, "line"])


def line_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` for reading files as lines: each file is cut every ``FILE_BLOCK`` bytes.

    Otherwise the cuts, and so the places, depend on the number of cores and on what other files are read, which differ
    between batch and stream and between two runs of a stream. Files are not packed into common tasks here.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", FILE_BLOCK)
    own.conf.set("spark.sql.files.openCostInBytes", FILE_BLOCK)
    return own


def placed_lines(text: DataFrame, name: str = "seq") -> DataFrame:
    """Lines of text files (``value``, batch or stream) with their place: file time, path, block, line.

    Read ``text`` through :func:`line_session`, so that places are the same whenever a file is read.
    """
    meta = text.select("value", F.unix_micros("_metadata.file_modification_time").alias("time"),
                       F.regexp_replace("_metadata.file_path", " ", "%20").alias("path"),
                       F.col("_metadata.file_block_start").alias("start"))
    counted = meta.mapInArrow(count_lines, "value string, time bigint, path string, start bigint, line bigint")
    return counted.select("value", place(F.col("time"), F.col("path"), F.col("start"), F.col("line")).alias(name))


def placed_records(records: DataFrame, name: str = "seq") -> DataFrame:
    """Queue records (``value``, ``timestamp``, ``topic``, ``partition``, ``offset``) as text with their place.

    An offset counts inside its partition of its topic only; time, topic and partition make it comparable and unique.
    """
    source = F.concat_ws("/", "topic", F.lpad(F.col("partition").cast("string"), 10, "0"))
    return records.select(F.col("value").cast("string").alias("value"),
                          place(F.unix_micros("timestamp"), source, F.lit(0), F.col("offset")).alias(name))


def queue_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows as queue records: ``key`` and the whole row as JSON, nulls included, in ``value``."""
    return rows.select(F.col(key).cast("string").alias("key"),
                       F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))

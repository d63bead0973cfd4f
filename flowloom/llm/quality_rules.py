"""Quality rules: plain counts, and a log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the
buckets, one of trusted documents and one of the whole corpus, give every bucket a weight, the
logarithm of their ratio; a document scores the mean weight of its features and passes at or
above a fixed threshold. All of it is DataFrame code: arrays of words never leave the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import SPACE, whole

# Buckets of the hashed features; the only statistics that the driver sees.
BUCKETS = 1 << 14
# Pseudo-count of every bucket, in average buckets of the trusted text: a bucket must stand out for its weight to
# leave 0, so rare words of clean documents say little. As a share it treats tables of every size alike.
SMOOTHING = 1.0
# Trusted ids, each a row of a few bytes, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1 << 18
THRESHOLD = -0.09
MIN_WORDS, MAX_REPEATED = 50, 50


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside lambdas an expression would run for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _unigram(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _pair(word: Column, after: Column) -> Column:
    return F.pmod(F.xxhash64(word, F.coalesce(after, F.lit(""))), F.lit(BUCKETS)).cast("int")


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more, first occurrences included."""
    hashes = let(words, lambda ws: F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = let(ranked, lambda r: F.filter(r, lambda s, j: F.coalesce(
            (F.get(r, j - 1)["x"] == s["x"]) | (F.get(r, j + 1)["x"] == s["x"]),
            F.get(r, j - 1)["x"] == s["x"], F.get(r, j + 1)["x"] == s["x"], F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(
            places, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))),
               lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _table(values: list[float]) -> Column:
    """A constant array; folded once, so that a lambda finds an element without building it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def pseudo_count(trusted_words: int) -> float:
    # without trusted words all weights are 0, whatever it is
    return SMOOTHING * trusted_words / BUCKETS or 1.0


def feature_weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> tuple[list[float], list[float]]:
    """Weights of word buckets and of pair buckets, from all documents and from all those of ``trusted`` ids."""
    ids = trusted.select(F.col(id_col).alias("id"), F.lit(1).alias("good"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = (docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(ids, "id", "left")
              .select("good", words_of(F.col("text")).alias("ws")))
    pairs = marked.select("good", F.inline(F.arrays_zip(
        F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.greatest(F.size("ws"), F.lit(1))).alias("after"))))
    counted = (pairs.select("good", F.explode(F.array(_unigram(F.col("w")), _pair(F.col("w"), F.col("after")) + BUCKETS))
                            .alias("bucket"))
               .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")))
    # at most 2 * BUCKETS rows
    raw, good = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for row in counted.collect():
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    out = []
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        # both multinomials have as many counts as the trusted one, and the same pseudo-counts
        share, pseudo = sum(good[part]) / max(1, sum(raw[part])), pseudo_count(sum(good[part]))
        out.append([math.log(g + pseudo) - math.log(r * share + pseudo) for g, r in zip(good[part], raw[part])])
    return out[0], out[1]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``llr`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows. ``kept``: not
    failed, and ``llr``, the mean log-likelihood ratio of the words and pairs, reaches the
    threshold. Null text has no words and fails. Without trusted documents all weights are 0 and
    the threshold keeps all. Ids may be null or repeat; an empty table gives no rows.
    """
    trusted = labels.where(F.col("quality") == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    one, two = feature_weights(docs, trusted, id_col, text_col)
    if not trusted.take(1):
        one, two = [0.0] * BUCKETS, [0.0] * BUCKETS
    weights, pair_weights = _table(one), _table(two)
    text = whole(text_col)

    def measure(ws: Column) -> Column:
        score = F.aggregate(
            F.zip_with(ws, F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))),
                       lambda w, after: F.get(weights, _unigram(w)) + F.get(pair_weights, _pair(w, after))),
            F.lit(0.0), lambda total, x: total + x)
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"), F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            repeated_words(ws).cast("bigint").alias("n_repeat_words"),
            (score / (2 * F.greatest(F.size(ws), F.lit(1)))).alias("llr"))
    measured = docs.select(
        F.col(id_col), let(words_of(text), measure).alias("m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        duplicate_lines(text).cast("bigint").alias("n_dup_lines"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEATED)
    out = measured.select(
        id_col, "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"),
        "m.llr")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))

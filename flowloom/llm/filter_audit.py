"""How document filters interact: what each removes, alone and behind others, in every order.

Each filter is stored as one table of the ids of the rows that fail it. The rows that outlive a
set of filters come from those of a smaller set by a left-anti join with one id table, so all
2 ** n sets take n joins, each of which doubles the table. A filter's removals behind
a set are the left-semi join of that set's survivors with its ids, its redundant failures the ids
that the left-anti join with the survivors leaves. An order of filters only picks sets, so the n! orders are
read from the counts per part, set and filter.

Tables of ids compress so well that Spark takes millions of rows for a few megabytes and would collect them on the
driver to broadcast them; joins of rows therefore name their method.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import SPACE, whole, with_group_facts, workspace, written

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed values of the filters.
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that need one text only, by the letter of their filter."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_SHARE,
            "C": capitals * 100 > F.char_length(text) * CAPITAL_SHARE,
            "D": text.rlike(SYMBOLS)}


def copies(rows: DataFrame) -> DataFrame:
    """Rows (``row``, ``id``, ``sha``) with a row of smaller id and the same ``sha``; null ids are the largest."""
    same = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    met = with_group_facts(rows, same, ["sha"], "n", rows.count())
    return met.where((F.col("id") > F.col("least")) | (F.col("id").isNull() & F.col("least").isNotNull())).select("row")


def id_tables(docs: DataFrame, labels: DataFrame, folder: str, id_col: str, text_col: str,
              part_col: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All rows (``row``, ``part``, ``good``, ``toxic``) and, for each filter, the ids of the rows that fail it.

    Rows are named by a number of their own, since ids may repeat or be null.
    """
    text = whole(text_col)
    checks = failures(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"),
        *[check.alias(letter) for letter, check in checks.items()])
    rows = written(rows, folder, "rows")
    known = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    failing = {letter: rows.where(letter).select("row") for letter in checks}
    failing["E"] = copies(rows.select("row", "id", "sha"))
    failing = {letter: written(ids, folder, f"failing-{letter}") for letter, ids in failing.items()}
    everyone = rows.join(known.hint("merge"), "id", "left").select(
        "row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return written(everyone, folder, "everyone"), failing


def survivors(rows: DataFrame, failing: dict[int, DataFrame]) -> DataFrame:
    """``rows`` once for each set of the filters that the row passes; ``behind`` has the bits of the set.

    Each filter doubles the table; its anti-join strikes failing rows from the new half. All joins are on
    ``row``, so the table is exchanged once.
    """
    def one_more(table: DataFrame, k: int) -> DataFrame:
        ids = failing[k].hint("shuffle_hash").withColumnRenamed("row", "struck")
        both = table.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1 << k))))
        return both.join(ids, (F.col("row") == F.col("struck")) & (F.col("more") > 0), "left_anti").select(
            "row", "part", "good", "toxic", (F.col("behind") + F.col("more")).alias("behind"))
    return reduce(one_more, failing, rows.withColumn("behind", F.lit(0)))


def filter_counts(k: int, everyone: DataFrame, failing: dict[int, DataFrame], folder: str) -> DataFrame:
    """``part``, ``behind``, ``filter`` (k): removed, redundant, good_lost, toxic_lost behind each set of other filters."""
    others = {j: ids for j, ids in failing.items() if j != k}
    failed = everyone.join(failing[k].hint("shuffle_hash"), "row", "left_semi")
    # rows that fail k and pass the set: what k removes behind it
    removed = written(survivors(failed, others), folder, f"removed-{k}")
    gone = removed.groupBy("part", "behind").agg(
        F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    sets = [s for s in range(1 << len(failing)) if not s >> k & 1]
    missed = (failed.select("row", "part", F.explode(F.array(*map(F.lit, sets))).alias("behind"))
              .join(removed.select("row", "behind").hint("merge"), ["row", "behind"], "left_anti")
              .groupBy("part", "behind").agg(F.count(F.lit(1)).alias("redundant")))
    return written(gone.join(missed, ["part", "behind"], "full").withColumn("filter", F.lit(k)), folder, f"counts-{k}")


def set_counts(everyone: DataFrame, failing: dict[int, DataFrame], folder: str) -> DataFrame:
    """``part``, ``filter`` (number), ``behind`` (set of earlier filters): kept, removed, redundant and what the removals lose.

    Every part has a row for every filter and every set of other filters, zeros included.
    """
    n = len(failing)
    kept = survivors(everyone, failing).groupBy("part", "behind").agg(F.count(F.lit(1)).alias("kept"))
    kept = written(kept.withColumnRenamed("behind", "after"), folder, "kept")
    found = reduce(DataFrame.unionByName, [filter_counts(k, everyone, failing, folder) for k in failing])
    # behind nothing all parts have survivors
    cells = kept.where("after = 0").select("part", F.explode(F.array(*[
        F.struct(F.lit(k).alias("filter"), F.lit(s).alias("behind"), F.lit(s | 1 << k).alias("after"))
        for k in range(n) for s in range(1 << n) if not s >> k & 1])).alias("cell")).select("part", "cell.*")
    out = cells.join(found, ["part", "filter", "behind"], "left").join(kept, ["part", "after"], "left")
    return out.select("part", "filter", "behind", *[
        F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley``.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % capitals; D: holds a symbol; E: equals the text
    of a smaller id, removed or not. Null text is the empty text, a null part the empty one; a null id is larger than all
    others and has no label; rows of one id are rows of their own; of repeated labels the highest counts. ``shapley`` sums what the
    filter removes over all orders. An empty table gives no rows. Other columns are not read.
    """
    folder = workspace(docs.sparkSession)
    everyone, failing = id_tables(docs, labels, folder, id_col, text_col, part_col)
    letters = list(failing)
    n = len(letters)
    found = written(set_counts(everyone, dict(enumerate(failing.values())), folder), folder, "counts")
    size = F.expr("bit_count(behind)")
    # so many orders have just this set in front of the filter
    orders = reduce(lambda rest, s: F.when(size == s, math.factorial(s) * math.factorial(n - 1 - s)).otherwise(rest),
                    range(n), F.lit(0))
    total = found.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders).alias("shapley"),
        # behind all others only those are left that fail nothing else
        F.sum(F.when(size == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"))
    steps = [("".join(letters[k] for k in order), step + 1, k, sum(1 << j for j in order[:step]))
             for order in permutations(range(n)) for step, k in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, behind int")
    return found.join(total, ["part", "filter"]).join(F.broadcast(steps), ["filter", "behind"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

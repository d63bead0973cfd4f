"""Similarity join on word n-grams with prefix filters under several global token orders.

If two sets have a Jaccard similarity of at least t, then under any order of all tokens their
prefixes of n - ceil(t n) + 1 tokens share one. Candidates come from shared tokens of one
order; they must also share prefix tokens under two other orders before their sets are
fetched and compared. All orders put frequent tokens last: a sketch of fixed size holds how
often the tokens of a cell were met by several documents of a stretch of the table.

Documents with the same set form a class and are joined once. Inside the list of a token the
members are first compared with one leader; members of one component need no further
comparison, so only pairs that are still apart are formed: a group of near copies costs its
size and not its square. All pairs that are left are compared; no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import discard, whole, workspace, written
from flowloom.llm.components import components

# Cells of the frequency sketch, whatever the corpus: eight bytes each while it is made, one in the tasks that use it.
CELL_BITS = 20
# Tokens of a stretch that is searched for repeated tokens, and how many documents must share one.
STRETCH, SHARED = 1 << 20, 3
LEADER_ROUNDS = 1
# Lists up to this size are joined pair by pair; longer ones are cut into blocks of members and
# tokens, and a task compares two blocks and returns no more links than it has members.
SHORT_LIST = 64
BLOCK_MEMBERS, BLOCK_TOKENS = 256, 1 << 19
# Columns of the membership matrix that are multiplied at a time.
COLUMNS = 1 << 12
# Words whose hashes a worker keeps; idle workers keep them, too.
WORD_CACHE = 1 << 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Seeds of the second and third order; the first is by the token itself.
ORDERS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """Texts of a batch one by one, so that a worker never holds them all as Python strings."""
    column = batch.column("text")
    for i in range(batch.num_rows):
        yield column[i].as_py()


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word windows; of all words where there are fewer.

    A-Z are lower-cased; words end at the six white-space characters only.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    count = len(words) - width + 1
    out = hashes[:count] + np.uint64(width)
    for k in range(1, width):
        out = _mix(out) * _STEP + hashes[k:count + k]
    return np.unique(_mix(out))


def set_name(tokens: np.ndarray) -> int:
    """64-bit name of a set, by size and two sums over its tokens."""
    if not len(tokens):
        return 0
    parts = np.array([tokens.sum(), _mix(tokens ^ ORDERS[0]).sum(), len(tokens)], np.uint64)
    return int(xxhash.xxh3_64_intdigest(parts.tobytes()) - (1 << 63))


def prefix_length(n: int, num: int, den: int) -> int:
    return n + num * n // -den + 1 if n else 0


def prefix(tokens: np.ndarray, weights: np.ndarray, seed: np.uint64 | None, num: int, den: int,
           times: int = 1) -> np.ndarray:
    """The smallest keys of a set under one order, ``times`` as many as must share one; a key is the weight of the token's cell, then its hash.

    Keys stand for tokens from here on: two tokens with the same key, which would have to agree
    in 56 bits, are one token to the filter and are told apart by the comparison of the sets.
    """
    size = times * prefix_length(len(tokens), num, den)
    hashes = tokens if seed is None else _mix(tokens ^ seed)
    keys = weights[tokens >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    return np.partition(keys, size - 1)[:size] if 0 < size < len(keys) else keys


def _weights(rows: DataFrame, n: int) -> np.ndarray:
    """Weight of each cell: the binary logarithm of how often its repeated tokens occur, over the whole table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << CELL_BITS), [], 0

        def take():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= SHARED
            np.add.at(total, (tokens[many] >> np.uint64(64 - CELL_BITS)).astype(np.int64), times[many])
        for batch in batches:
            for text in _texts(batch):
                held.append(shingles(text, n))
                size += len(held[-1])
                if size >= STRETCH:
                    take()
                    held, size = [], 0
        if held:
            take()
        cells = np.flatnonzero(total)
        for a in range(0, len(cells), 1 << 16):
            part = cells[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.float64())],
                                             names=["cell", "n"])
    # at most one row per cell
    sums = rows.select("text").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(1 << CELL_BITS, np.uint8)
    weights[sums.column("cell").to_numpy()] = (1 + np.log2(sums.column("n").to_numpy())).astype(np.uint8)
    return weights


def _signed(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens).view(np.int64)


def _prefixes(rows: DataFrame, n: int, num: int, den: int, weights: np.ndarray) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, firsts, seconds, thirds = [], [], [], [], []
            for text in _texts(batch):
                tokens = shingles(text, n)
                sizes.append(len(tokens))
                names.append(set_name(tokens))
                firsts.append(_signed(prefix(tokens, weights, None, num, den)))
                for seed, out, times in zip(ORDERS, (seconds, thirds), (2, 1)):
                    keys = prefix(tokens, weights, seed, num, den, times)
                    out.append((keys & np.uint64(0x7FFFFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(firsts, pa.list_(pa.int64())), pa.array(seconds, pa.list_(pa.int32())),
                 pa.array(thirds, pa.list_(pa.int32()))], names=["id", "n", "cls", "first", "second", "third"])
    return rows.mapInArrow(run, f"id {kind}, n bigint, cls bigint, first array<bigint>, second array<int>, third array<int>")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, n) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array([set_name(t) for t in found], pa.int64()),
                 pa.array([t.tobytes() for t in found], pa.binary())], names=["cls", "name", "tokens"])
    # a row that repeats an id with another text is not the one that was asked for
    return rows.mapInArrow(run, "cls bigint, name bigint, tokens binary").where(F.col("name") == F.col("cls")).drop("name")


# Rows of a narrow table that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1 << 20


def _checked(narrow: DataFrame) -> DataFrame:
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def _filtered(num: int, den: int):
    """What the other orders ask of a pair that reaches the similarity.

    Tokens that both sets share and that a prefix lacks are the last of the shared ones under its
    order, for either set. So two prefixes share all but as many as the longer remainder holds.
    Keys are cut to 31 bits; what fell together inside one prefix is allowed for.
    """
    shared = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    beyond = F.greatest(F.col("na") - F.size("seconda"), F.col("nb") - F.size("secondb"))
    fallen = F.size("seconda") - F.size(F.array_distinct("seconda"))
    return (F.arrays_overlap("thirda", "thirdb")
            & (F.size(F.array_intersect("seconda", "secondb")) >= shared - beyond - fallen))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                  for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(shared, pa.int64())],
            names=["a", "b", "na", "nb", "shared"])


def _forest(pairs: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs connect: one fewer than members, per component."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _overlaps(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Number of shared tokens of each pair of sets; ``n`` holds their sizes."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    # only tokens of several members add to an overlap
    met = times[column] > 1
    row, column = row[met], np.cumsum(times > 1)[column[met]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _compare_blocks(num: int, den: int):
    """Grouped function: links between the members of two blocks of a list, as a spanning forest."""
    def run(group: pa.Table) -> pa.Table:
        cls, root, block = (group.column(c).to_numpy() for c in ("cls", "root", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        shared = _overlaps(sets, n)
        linked = shared * den >= (n[:, None] + n[None, :] - shared) * num
        linked &= root[:, None] != root[None, :]
        if block.min() != block.max():
            # pairs inside one block are compared where it meets itself
            linked &= block[:, None] != block[None, :]
        found = _forest(np.argwhere(np.triu(linked, 1)), len(sets))
        return pa.table({"a": pa.array([min(int(cls[x]), int(cls[y])) for x, y in found], pa.int64()),
                         "b": pa.array([max(int(cls[x]), int(cls[y])) for x, y in found], pa.int64())})
    return run


def _degrees(num: int, den: int):
    """Grouped function: documents that the members of two blocks of a component are linked with, for each member."""
    def run(group: pa.Table) -> pa.Table:
        cls, times, block = (group.column(c).to_numpy() for c in ("cls", "times", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        shared = _overlaps(sets, n)
        linked = shared * den >= (n[:, None] + n[None, :] - shared) * num
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            # pairs inside one block are counted where it meets itself
            linked &= block[:, None] != block[None, :]
        return pa.table({"of": pa.array(cls, pa.int64()), "links": pa.array(linked @ times.astype(np.int64), pa.int64())})
    return run


def _link_counts(found: DataFrame, sets_of, folder: str, num: int, den: int) -> DataFrame:
    """``of`` and ``links``: how many documents of other classes link with those of each class.

    Linked classes are in one component, so the members of each component are compared with
    each other, block against block, and every pair in one group only.
    """
    members = written(found.where(F.col("n") > 0).groupBy("root", "cls").agg(
        F.count(F.lit(1)).alias("times"), F.first("n").alias("n")), folder, "members")
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens")).where(
        F.col("m") > 1).select("root", F.greatest(
            F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("blocks"))
    open_ = written(members.join(several, "root"), folder, "counted")
    spread = (open_.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
              .select("root", "cls", "times", "block",
                      F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
              .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other"))
    part = spread.join(sets_of(open_.select("cls"), "counted"), "cls").select(
        "root", "i", "j", "cls", "times", "block", "tokens").groupBy("root", "i", "j").applyInArrow(
            _degrees(num, den), "of bigint, links bigint")
    return written(part.groupBy("of").agg(F.sum("links").alias("links")), folder, "degrees")


def _joined(docs: DataFrame, n: int, num: int, den: int, leader_rounds: int, id_col: str, text_col: str,
            with_links: bool) -> DataFrame:
    """One row per input row: ``id``, ``n``, ``cls``, ``component_id``, ``class_id`` and, if asked for, ``links``."""
    spark = docs.sparkSession
    folder = workspace(spark)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    weights = _weights(rows, n)
    firsts = written(_prefixes(rows, n, num, den, weights), folder, "prefixes")
    classes = written(firsts.where(F.col("n") > 0).groupBy("cls").agg(F.min("id").alias("rep")), folder, "classes")
    postings = firsts.select("cls", "n", F.explode("first").alias("token"))
    met = postings.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1).select("token")
    lists = written(postings.join(met, "token", "left_semi").distinct(), folder, "lists")

    seen: list[DataFrame] = []

    def members(classes_of: DataFrame, label: str) -> DataFrame:
        """Classes and their representatives, for a join with the documents."""
        ids = classes_of.distinct().join(classes, "cls")
        return _checked(written(ids.select(F.col("cls").alias("of"), "rep"), folder, label))

    def sets_of(classes_of: DataFrame, name: str) -> DataFrame:
        asked = rows.join(members(classes_of, f"fetched-{name}"), F.col("id").eqNullSafe(F.col("rep"))).select(
            F.col("of").alias("cls"), "text")
        return written(_sets(asked, n), folder, f"sets-{name}")

    def within_long_lists(open_lists: DataFrame) -> DataFrame:
        """Links inside lists longer than ``SHORT_LIST`` between members that are still apart."""
        sets = sets_of(open_lists.select("cls"), "long")
        spread = (open_lists.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
                  .select("token", "cls", "root", "block",
                          F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
                  .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other"))
        links = spread.join(sets, "cls").select("token", "i", "j", "cls", "root", "block", "tokens").groupBy(
            "token", "i", "j").applyInArrow(_compare_blocks(num, den), "a bigint, b bigint")
        links = written(links.distinct(), folder, "links-long")
        discard(spark, folder, "long", "sets-long", "fetched-long")
        return links

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Linked pairs among ``pairs`` (``a``, ``b``, ``na``, ``nb``), by the other orders' filters, then by their sets."""
        pairs = pairs.distinct()
        for done in seen:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, folder, f"pairs-{name}")
        seen.append(pairs.select("a", "b"))

        picked = members(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")), f"asked-{name}")
        filters = written(firsts.join(picked, (F.col("cls") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep"))).select(
            "cls", "second", "third"), folder, f"filters-{name}")
        a, b = (filters.select(F.col("cls").alias(s), F.col("second").alias(f"second{s}"), F.col("third").alias(f"third{s}"))
                for s in "ab")
        near = written(pairs.join(a, "a").join(b, "b").where(_filtered(num, den))
            .select("a", "b", "na", "nb").distinct(), folder, f"near-{name}")
        sets = sets_of(near.select(F.col("a").alias("cls")).union(near.select("b")), name)
        x, y = (sets.select(F.col("cls").alias(s), F.col("tokens").alias(t)) for s, t in (("a", "x"), ("b", "y")))
        sized = near.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(
            _compare, "a bigint, b bigint, na bigint, nb bigint, shared bigint")
        linked = sized.where(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num)
        linked = written(linked.select("a", "b").distinct(), folder, f"links-{name}")
        discard(spark, folder, *(f"{made}-{name}" for made in ("asked", "filters", "near", "fetched", "sets")))
        return linked

    def labelled(links: DataFrame, name: str) -> DataFrame:
        """The lists that still hold several components."""
        roots = written(components(links, folder, f"stars-{name}"), folder, f"roots-{name}")
        marked = lists.join(roots, F.col("cls") == F.col("node"), "left").select(
            "token", "cls", "n", F.coalesce("root", "cls").alias("root"))
        apart = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
            F.col("low") != F.col("high")).select("token")
        return written(marked.join(apart, "token", "left_semi"), folder, f"open-{name}")

    similar = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    links, still = None, lists.withColumn("root", F.col("cls"))
    for turn in range(leader_rounds + 1):
        if turn < leader_rounds:
            rank = F.xxhash64(F.lit(turn), F.col("cls")) if turn else F.col("cls")
            lead = still.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "cls", "n", "root")).alias("l")).select(
                "token", F.col("l.cls").alias("a"), F.col("l.n").alias("na"), F.col("l.root").alias("ra"))
        else:
            counts = still.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
            long = counts.where(F.col("m") > SHORT_LIST).select("token", F.greatest(
                F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("blocks"))
            inside = within_long_lists(written(still.join(long, "token"), folder, "long"))
            links = inside if links is None else links.union(inside)
            still = still.join(long, "token", "left_anti")
            lead = still.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
        member = still.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
        order = F.col("a") != F.col("b") if turn < leader_rounds else F.col("a") < F.col("b")
        pairs = lead.join(member, "token").where(order & (F.col("ra") != F.col("rb")) & similar).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        new = compared(pairs, str(turn))
        links = new if links is None else links.union(new)
        if turn < leader_rounds:
            still = labelled(links, str(turn))
            if turn:
                discard(spark, folder, f"open-{turn - 1}")
    discard(spark, folder, "lists", f"open-{leader_rounds - 1}", *(f"pairs-{turn}" for turn in range(leader_rounds + 1)))
    links = links.distinct()
    roots = written(components(links, folder, "stars"), folder, "roots")

    full = (classes.join(roots, F.col("cls") == F.col("node"), "left")
            .select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    smallest = full.groupBy("root").agg(F.min("rep").alias("least"))
    table = written(full.join(smallest, "root").select("cls", "rep", "root", "least"), folder, "components")
    found = firsts.select("id", "n", "cls").join(table, "cls", "left")
    out = ["id", "n", "cls", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
           F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("class_id")]
    if not with_links:
        return found.select(*out)
    sizes = firsts.where(F.col("n") > 0).groupBy("cls").agg(F.count(F.lit(1)).alias("times"))
    degrees = _link_counts(found, sets_of, folder, num, den)
    counted = sizes.join(degrees, F.col("cls") == F.col("of"), "left").select(
        F.col("cls").alias("of"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return found.join(counted, F.col("cls") == F.col("of"), "left").select(*out, F.coalesce("links", F.lit(0)).alias("links"))


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, leader_rounds: int = LEADER_ROUNDS,
               id_col: str = "doc_id", text_col: str = "text", with_links: bool = True) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``class_id``, ``links``.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of distinct
    ``n``-word shingles. ``component_id`` is the smallest id reachable by links, itself
    included; ``class_id`` the smallest id with the same set; ``links`` the number of other rows
    that the row links with, equal sets included. It compares all pairs inside a component;
    without ``with_links`` the column and its work are left out. A text with fewer than ``n`` words has its whole sequence as
    one shingle; null or empty text has none and is linked with nothing. Null ids take part
    and never are the smallest; rows that repeat an id are rows of their own. An empty table
    gives no rows.
    """
    found = _joined(docs, n, num, den, leader_rounds, id_col, text_col, with_links)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_id",
                        *["links"] * with_links)


def one_per_component(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, leader_rounds: int = LEADER_ROUNDS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked ones, that of the smallest id; columns as they were.

    A row goes when its own component has a smaller id; another row of its id with another text
    may stay. Rows with a null id stay, since no id of theirs says which of them to drop; so do
    rows that repeat the id that stays.
    """
    found = _joined(docs, n, num, den, leader_rounds, id_col, text_col, False)
    away = F.coalesce(F.col("component_id") < F.col("id"), F.lit(False))
    dropped = found.where(away).select(F.col("id").alias(id_col), F.col("cls").alias("__cls")).distinct()
    ids = dropped.select(id_col).distinct()
    kept = docs.join(ids, id_col, "left_anti").select(docs.columns)
    # ids of which one row goes and another stays
    mixed = written(ids.join(found.where(~away).select(F.col("id").alias(id_col)), id_col, "left_semi"),
                    workspace(docs.sparkSession), "mixed")
    if mixed.isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(text_col))
            names = pa.array([set_name(shingles(t, n)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "__cls"])
    rows = docs.join(mixed, id_col, "left_semi").select(docs.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("__cls", T.LongType())])
    return kept.union(rows.mapInArrow(run, schema).join(dropped, [id_col, "__cls"], "left_anti").select(docs.columns))

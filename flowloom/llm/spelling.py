"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is described by its length and by how many of its letters fall into each of a few groups.
One inserted letter adds one to one count, one replaced letter takes one from a count and adds one to
another, so two near words differ by a surplus and a deficit of at most one each. The trie arranges words by
length, then by the counts of successive groups. A depth-first search walks down from the root,
spends its budget of one surplus and one deficit where a branch departs from the sought counts,
and compares letters only at the leaves it reaches.

The upper levels of the trie are cells: a word stands in the cell of its own first counts and is sought in
those that the budget reaches. Each task reads sorted cells one by one, builds the lower levels
of one and searches it; a cell that is still large is dealt in blocks, each searched for all words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import partitions, whole, workspace, written

# Words, and the share of (document, word) pairs that lose a letter.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, DROP = 5, 3, 97
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Frequent letters have a group of their own and come first, where they part most words.
GROUPS = ["e", "t", "a", "n", "i", "o", "r", "s", "h", "l", "d", "u", "m", "c", "g", "b", "p", "f", "w", "v", "jkqxyz"]
OTHER = len(GROUPS)
GROUP_OF = {letter: g for g, letters in enumerate(GROUPS) for letter in letters}
# Words that a cell should hold, how many levels its name has at most, vectors of a leaf, and words of one row.
CELL, MAX_DEPTH, LEAF, LIST = 8192, 8, 16, 256
FOUND_SCHEMA = "word string, n bigint, near string, near_n bigint"


def variant_words(docs: DataFrame, id_col: str, text_col: str, drop: int | None = DROP) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters and how often they occur, each counted where it stands.

    With ``drop``, a run whose checksum with its document's id (null: empty) is a multiple of it loses one letter.
    """
    lowered = F.translate(whole(text_col), CAPITALS, SMALL)
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(
        F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= MIN_LENGTH)
    if drop:
        runs = runs.select("run", F.crc32(F.concat_ws(":", F.coalesce("id", F.lit("")), "run").cast("binary")).alias("h"))
        at = F.col("h") % F.length("run")
        runs = runs.select(F.when(F.col("h") % drop == 0, F.concat(
            F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run"))))
            .otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def vector(word: str) -> bytes:
    """Letter-group counts. Counts stop at 255, which brings two vectors no further apart."""
    counts = [0] * (OTHER + 1)
    for letter in word:
        counts[GROUP_OF.get(letter, OTHER)] += 1
    return bytes(min(count, 255) for count in counts)


def reach(length: int, vec: bytes, depth: int) -> Iterator[bytes]:
    """Cells in which near words of the same length, or of one letter more, may stand."""
    upper = vec[:depth]
    for size in (cell(length, b""), cell(length + 1, b"")):
        yield size + upper
        for up in range(depth):
            if upper[up] < 255:
                yield size + upper[:up] + bytes((upper[up] + 1,)) + upper[up + 1:]
    size = cell(length, b"")
    for down in range(depth):
        if upper[down]:
            less = upper[:down] + bytes((upper[down] - 1,)) + upper[down + 1:]
            yield size + less
            for up in range(depth):
                if up != down and upper[up] < 255:
                    yield size + less[:up] + bytes((less[up] + 1,)) + less[up + 1:]


def cell(length: int, upper: bytes) -> bytes:
    return length.to_bytes(4, "big") + upper


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by one replaced letter or, where b is longer by one, by one inserted letter?"""
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    else:
        return len(b) == len(a) + 1
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def differences(surplus: int, deficit: int) -> frozenset[int]:
    """What vectors, read as numbers of base 256, may differ by within the budget; unlike vectors may collide."""
    steps = [1 << 8 * g for g in range(OTHER + 1)]
    return frozenset([0, *(steps if surplus else []), *([-d for d in steps] if deficit else []),
                      *([u - d for u in steps for d in steps] if surplus and deficit else [])])


ALLOWED = {(u, d): differences(u, d) for u in (0, 1) for d in (0, 1)}


def grow(words: dict[bytes, list], level: int) -> dict | list:
    """The trie from a level on: maps by the count of that group; few vectors make a leaf, which lists them with their words."""
    if len(words) <= LEAF or level > OTHER:
        return [(int.from_bytes(vec, "big"), named) for vec, named in words.items()]
    parted: dict[int, dict] = {}
    for vec, named in words.items():
        parted.setdefault(vec[level], {})[vec] = named
    return {count: grow(part, level + 1) for count, part in parted.items()}


def leaves(node: dict | list, vec: bytes, number: int, surplus: int, deficit: int, level: int) -> Iterator[list]:
    """Depth-first search for the words of vectors that exceed and miss the sought counts within the budget."""
    if isinstance(node, list):
        allowed = ALLOWED[surplus, deficit]
        for other, named in node:
            if other - number in allowed:
                yield named
        return
    own = vec[level]
    if own in node:
        yield from leaves(node[own], vec, number, surplus, deficit, level + 1)
    if surplus and own + 1 in node:
        yield from leaves(node[own + 1], vec, number + (1 << 8 * (OTHER - level)), 0, deficit, level + 1)
    if deficit and own - 1 in node:
        yield from leaves(node[own - 1], vec, number - (1 << 8 * (OTHER - level)), surplus, 0, level + 1)


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [vector(word) for word in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(vecs, pa.binary()), *batch.columns], names=["vec", *batch.schema.names])


PLACED = [("cell", pa.binary()), ("sought", pa.bool_()), ("vec", pa.binary()), ("words", pa.list_(pa.string())),
          ("ns", pa.list_(pa.int64()))]


def placed(depth: int):
    """Rows sorted by vector to lists of words of one vector and length, each once in its own cell (``sought`` false)
    and once in every cell that its search reaches (true)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, ns, rows = None, [], [], []
        for batch in batches:
            for vec, word, n in zip(*(batch.column(c).to_pylist() for c in ("vec", "word", "n"))):
                if (vec, len(word)) != key or len(words) == LIST:
                    rows.extend(lists(key, words, ns))
                    key, words, ns = (vec, len(word)), [], []
                words.append(word)
                ns.append(n)
                if len(rows) > 4000:
                    yield packed(rows)
                    rows = []
        rows.extend(lists(key, words, ns))
        if rows:
            yield packed(rows)

    def lists(key: tuple[bytes, int] | None, words: list, ns: list) -> Iterator[tuple]:
        if key:
            vec, length = key
            yield cell(length, vec[:depth]), False, vec, words, ns
            for place in reach(length, vec, depth):
                yield place, True, vec, words, ns

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), PLACED)], names=[c for c, _ in PLACED])
    return run


def verified(words: list, ns: list, reached: list[list], longer: bool) -> Iterator[tuple]:
    """Pairs one edit apart between ``words`` and the words reached; an edit leaves the first or the second half as it is."""
    half = len(words[0]) // 2
    starts: dict[str, list] = {}
    ends: dict[str, list] = {}
    rest = len(words[0]) - half
    for named in reached:
        for pair in named:
            starts.setdefault(pair[0][:half], []).append(pair)
            ends.setdefault(pair[0][-rest:], []).append(pair)
    for word, n in zip(words, ns):
        start, end = word[:half], word[half:]
        for other, m in starts.get(start, ()):
            # words of one length meet from both sides
            if (longer or other > word) and one_edit(word, other):
                yield word, n, other, m
        for other, m in ends.get(end, ()):
            if (longer or other > word) and other[:half] != start and one_edit(word, other):
                yield word, n, other, m


def searched(depth: int):
    """Near words of the rows of a partition, sorted by cell, block, ``sought``; holds one block's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, entries, trie, out = None, {}, None, []
        for batch in batches:
            ends = batch.column("words").offsets.to_pylist()
            all_words, all_ns = (batch.column(c).values.to_pylist() for c in ("words", "ns"))
            for at, block, sought, vec, lo, hi in zip(*(
                    batch.column(c).to_pylist() for c in ("cell", "block", "sought", "vec")), ends, ends[1:]):
                words, ns = all_words[lo:hi], all_ns[lo:hi]
                if (at, block) != place:
                    place, entries, trie = (at, block), {}, None
                if not sought:
                    entries.setdefault(vec, []).extend(zip(words, ns))
                    continue
                if not entries:
                    continue
                if trie is None:
                    trie = grow(entries, depth)
                more = int.from_bytes(at[:4], "big") - len(words[0])
                spent = [u - v for u, v in zip(at[4:], vec)]
                surplus, deficit = 1 - spent.count(1), 1 - more - spent.count(-1)
                if surplus < 0 or deficit < 0:
                    continue
                number = int.from_bytes(at[4:] + vec[depth:], "big")
                for word, n, other, m in verified(words, ns, list(leaves(trie, vec, number, surplus, deficit, depth)), more > 0):
                    out.append((word, n, other, m))
                    out.append((other, m, word, n))
                if len(out) > 20_000:
                    yield found(out)
                    out = []
        if out:
            yield found(out)

    def found(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])
    return run


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """``(word, n, near, near_n)`` for all ordered pairs of words (``word``, ``n``; distinct) that one edit parts."""
    spark = words.sparkSession
    # a level parts words about threefold
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log(max(1.0, words.count() / CELL), 3))))
    sorted_words = words.select("word", "n").mapInArrow(described, "vec binary, word string, n bigint").repartition(
        partitions(spark), "vec").sortWithinPartitions("vec", F.length("word"), "word")
    rows = written(sorted_words.mapInArrow(placed(depth), "cell binary, sought boolean, vec binary, words array<string>, ns array<bigint>"),
                   folder, "placed")
    sizes = rows.where("not sought").groupBy("cell").agg(
        F.ceil(F.sum(F.size("words")) / CELL).cast("int").alias("blocks"))
    rows = rows.join(sizes, "cell").select(
        "cell", "sought", "vec", "words", "ns",
        F.explode(F.when(F.col("sought"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64(F.col("words")[0]), F.col("blocks")).cast("int")))).alias("block"))
    dealt = rows.repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "sought")
    return written(dealt.mapInArrow(searched(depth), FOUND_SCHEMA), folder, "near")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """``(word, root)`` for every word of ``forms`` (``word``, ``form``), following forms to their end.

    Each turn doubles the steps taken. A form is at least twice as frequent as its word, so there are
    no circles, and no more turns than the logarithm of the number of doublings.
    """
    now, turn = forms.select("word", F.col("form").alias("root")), 0
    while True:
        now = written(now, folder, f"roots-{turn}")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(further, "root", "left_semi").head(1):
            return now
        now = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        turn += 1


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int | None = DROP) -> DataFrame:
    """One row per word of at least 5 letters and 3 occurrences: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are maximal runs of Latin letters of whole texts, of which only A-Z are lower-cased; null text has
    none, a null id counts as the empty one. ``form`` is the most frequent word one edit away (of equally frequent ones the
    first in code-point order) if it occurs at least twice as often, ``root`` the end of the chain of forms. Repeated
    rows count again. An empty table gives no rows. Only the two columns are read.
    """
    folder = workspace(docs.sparkSession)
    counted = variant_words(docs, id_col, text_col, drop).where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH))
    words = written(counted, folder, "words")
    near = near_words(words, folder)
    best = near.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    best = written(best.select("word", "n_near", *[F.when(-F.col("best.less") >= 2 * F.col("n"), c).alias(name) for c, name in (
        (F.col("best.near"), "form"), (-F.col("best.less"), "form_n"))]), folder, "forms")
    ends = roots(best.where("form is not null"), folder)
    return words.join(best, "word", "left").join(ends, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n",
        F.coalesce("root", "word").alias("root"))

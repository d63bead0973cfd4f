"""Language-model scores from a hierarchical Pitman-Yor model.

Every word has a restaurant for the words that follow it. All of them stand on one restaurant of
words: a table that a word opens behind another is a customer there. A word that opens a table
in the restaurant of words is spelled byte by byte, each byte in the restaurant of its two
predecessors, whose parent is that of the last byte, whose parent is that of no context, whose base
is uniform. Seats are sampled by Gibbs sweeps from the top down and from the bottom up: all
customers of a dish are seated anew given the tables of their restaurant and the
probabilities of its parent, and the tables that this opens are the parent's customers. The
probability of a word behind another is the mean of its predictive probabilities over the sweeps.

Documents are gathered into blocks (``word_blocks``). Words and pairs of words are counted inside a block and
meet the counts of other blocks in ranges of 64-bit hashes, as sorted, packed arrays; a hot
context is spread over all ranges by its followers. Vocabulary, pairs and seats are tables that grow with the
corpus; only counts of byte triples, bounded by the alphabet (258 * 258 * 257), come to the
driver and go out with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import word_blocks as wb
from flowloom.llm.common import discard, workspace, written

BLOCK_TOKENS = 1 << 19
# Sweeps over the restaurants of contexts, all averaged.
SWEEPS = 2
CONTEXT_STRENGTH = 2.0
WORD_STRENGTH = 50.0
BYTE_DISCOUNT, BYTE_STRENGTH = 0.5, 2.0
# Customers seated one by one; above, a sixteenth of those present is seated at once.
SINGLE = 64

END, START, SYMBOLS = 256, 257, 257


# --- seating -----------------------------------------------------------------------------

def _chance(names: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers that depend on the name of a dish and the step only, not on its place."""
    return (wb.mix(names + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) * 2.0 ** -53


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, names: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after seating ``customers`` of each dish by the Chinese restaurant process.

    ``fresh`` is (strength + discount * tables of the restaurant) * parent probability. The
    first customer opens a table; the next ones open another with the odds of ``fresh`` against
    the customers present less the discount of their tables. Beyond ``SINGLE`` customers whole
    blocks are seated by their expected number of new tables, rounded at random.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    live, k, step = np.flatnonzero(customers > 1), 1, sweep << 20
    # dishes that still have customers to seat, side by side
    c, f, t, name = customers[live], fresh[live], tables[live], names[live]
    while len(live):
        block = 1 if k < SINGLE else k // 16
        size = np.minimum(block, c - k)
        odds = f / (f + k - discount * t)
        t += np.floor(size * odds + _chance(name, step))
        k, step = k + block, step + 1
        more = c > k
        if not more.all():
            tables[live[~more]] = t[~more]
            live, c, f, t, name = (x[more] for x in (live, c, f, t, name))
    return np.minimum(tables, customers)


class ByteModel:
    """Restaurants of bytes for contexts of two, one and no bytes, seated for one sweep."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, sweep: int, previous: ByteModel | None = None):
        d, s = BYTE_DISCOUNT, BYTE_STRENGTH
        order = np.argsort(keys)
        keys, c2 = keys[order], customers[order].astype(np.float64)
        ctx, sym = keys >> 9, keys & 511
        # parents' probabilities as the last sweep left them
        parent = previous.one(ctx & 511, sym) if previous else np.full(len(keys), 1.0 / SYMBOLS)
        self.ctx2, where = np.unique(ctx, return_inverse=True)
        load = np.bincount(where, minlength=len(self.ctx2)).astype(np.float64)
        t2 = seat(c2, (s + d * load[where]) * parent, d, keys.astype(np.uint64), sweep)
        full2, all2 = (np.bincount(where, t2, len(self.ctx2)), np.bincount(where, c2, len(self.ctx2)))

        keys1, up = np.unique((ctx & 511) << 9 | sym, return_inverse=True)
        c1 = np.bincount(up, t2, len(keys1)) if len(up) else np.zeros(0)
        ctx1, sym1 = keys1 >> 9, keys1 & 511
        parent1 = previous.p0[sym1] if previous else np.full(len(keys1), 1.0 / SYMBOLS)
        load1 = np.bincount(ctx1, minlength=512).astype(np.float64)
        t1 = seat(c1, (s + d * load1[ctx1]) * parent1, d, (keys1 | 1 << 40).astype(np.uint64), sweep)
        full1, all1 = np.bincount(ctx1, t1, 512), np.bincount(ctx1, c1, 512)

        c0 = np.bincount(sym1, t1, SYMBOLS)
        t0 = seat(c0, np.full(SYMBOLS, (s + d * np.count_nonzero(c0)) / SYMBOLS), d,
                  (np.arange(SYMBOLS) | 1 << 41).astype(np.uint64), sweep)
        self.p0 = (c0 - d * t0 + (s + d * t0.sum()) / SYMBOLS) / (s + c0.sum())
        self.back1 = (s + d * full1) / (s + all1)
        self.keys1 = keys1
        self.p1 = (c1 - d * t1) / (s + all1[ctx1]) + self.back1[ctx1] * self.p0[sym1]
        self.back2 = (s + d * full2) / (s + all2)
        self.keys2 = keys
        self.p2 = (c2 - d * t2) / (s + all2[where]) + self.back2[where] * self.one(ctx & 511, sym)

    def __getstate__(self) -> dict:
        """Without the dense tables, which each process makes for itself."""
        return {k: v for k, v in vars(self).items() if k not in ("dense1", "dense_back2")}

    @cached_property
    def dense1(self) -> np.ndarray:
        """Probabilities behind one byte, by context and symbol: 512 * 512, whatever the corpus."""
        out = np.zeros((512, 512))
        out[:, :SYMBOLS] = self.back1[:, None] * self.p0
        out = out.ravel()
        out[self.keys1] = self.p1
        return out

    @cached_property
    def dense_back2(self) -> np.ndarray:
        """What contexts of two bytes leave to their parents; all of it where the context is unknown."""
        out = np.ones(512 * 512)
        out[self.ctx2] = self.back2
        return out

    def one(self, ctx1: np.ndarray, sym: np.ndarray) -> np.ndarray:
        return self.dense1[ctx1 << 9 | sym]

    def two(self, ctx2: np.ndarray, sym: np.ndarray) -> np.ndarray:
        out = self.one(ctx2 & 511, sym) * self.dense_back2[ctx2]
        if len(self.keys2):
            wanted = ctx2 << 9 | sym
            at = np.minimum(np.searchsorted(self.keys2, wanted), len(self.keys2) - 1)
            known = self.keys2[at] == wanted
            out[known] = self.p2[at[known]]
        return out


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and symbols of all words, where each word starts, and a number that names each word."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = wb.flat(words).astype(np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    sym = np.full(len(data) + len(lengths), END, np.int64)
    last = starts + lengths
    inner = np.ones(len(sym), bool)
    inner[last] = False
    sym[inner] = data
    one = np.r_[START, sym[:-1]]
    one[starts] = START
    two = np.r_[START, one[:-1]]
    two[starts] = START
    place = np.arange(len(sym)) - np.repeat(starts, lengths + 1)
    names = np.add.reduceat(wb.mix((sym + 1) * 1_000_003 + place * 0x5851F42D4C957F2D), starts)
    return two << 9 | one, sym, starts, wb.mix(names)


class WordModel:
    """The restaurant of words over one spelling model: seats and predictive probabilities."""

    def __init__(self, spelling: ByteModel, discount: float, customers: float, tables: float, sweep: int):
        self.spelling, self.discount, self.customers, self.tables, self.sweep = (
            spelling, discount, customers, tables, sweep)

    def spelled(self, ctx, sym, starts) -> np.ndarray:
        return np.exp(np.add.reduceat(np.log(self.spelling.two(ctx, sym)), starts))

    def seats(self, counts, spelled, names) -> np.ndarray:
        return seat(counts, (WORD_STRENGTH + self.discount * self.tables) * spelled, self.discount, names, self.sweep)

    def probability(self, counts, tables, spelled, all_tables) -> np.ndarray:
        return (counts - self.discount * tables + (WORD_STRENGTH + self.discount * all_tables) * spelled) / (
            WORD_STRENGTH + self.customers)


# --- sampling ----------------------------------------------------------------------------

def _customers(vocabulary: DataFrame, model: WordModel | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Customers of the byte restaurants and tables of the word restaurant, one table a word without a model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(counts):
                continue
            ctx, sym, starts, names = spell(batch.column("word"))
            tables = np.ones(len(counts)) if model is None else model.seats(
                counts, model.spelled(ctx, sym, starts), names)
            sizes = np.diff(np.r_[starts, len(sym)])
            keys, at = np.unique(ctx << 9 | sym, return_inverse=True)
            n = np.bincount(at, np.repeat(tables, sizes), len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[keys, -1], pa.int64()), pa.array(np.r_[n, tables.sum()], pa.float64())],
                names=["key", "n"])
    sums = vocabulary.where(F.col("c") > 0).select("word", "c").mapInArrow(run, "key bigint, n double")
    # bounded by the alphabet: at most 258 * 258 * 257 byte triples and one total
    table = sums.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    return keys[keys >= 0], n[keys >= 0], float(n[keys < 0].sum())


class Words:
    """The restaurant of words and its spelling, one sweep at a time over the customers of the day."""

    def __init__(self, vocabulary: DataFrame):
        once, twice = vocabulary.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
        self.discount = discount_of(once, twice)
        keys, n, self.tables = _customers(vocabulary, None)
        self.spelling, self.number = ByteModel(keys, n, 0), 0

    def sweep(self, vocabulary: DataFrame, customers: int) -> tuple:
        """Seats all customers anew; the model, its tables and the spelling after the sweep."""
        self.number += 1
        model = WordModel(self.spelling, self.discount, float(customers), self.tables, self.number)
        keys, n, self.tables = _customers(vocabulary, model)
        self.spelling = ByteModel(keys, n, self.number, self.spelling)
        return model, self.tables, self.spelling


def discount_of(once: int, twice: int) -> float:
    """The discount that counts of ones and twos suggest."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def predict(words: pa.Array, counts: np.ndarray, state: tuple) -> np.ndarray:
    """Predictive probabilities of the restaurant of words after one sweep."""
    model, tables, spelling = state
    if not len(counts):
        return np.zeros(0)
    counts = counts.astype(np.float64)
    ctx, sym, starts, names = spell(words)
    seats = model.seats(counts, model.spelled(ctx, sym, starts), names)
    after = np.exp(np.add.reduceat(np.log(spelling.two(ctx, sym)), starts))
    return np.maximum(model.probability(counts, seats, after, tables), 1e-300)


def unknown(vocabulary: DataFrame, state: tuple) -> float:
    """Probability of any word that training never met: what the spelling leaves to others."""
    model, tables, spelling = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ctx, sym, starts, _ = spell(batch.column("word"))
                known = float(np.exp(np.add.reduceat(np.log(spelling.two(ctx, sym)), starts)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([known], pa.float64())], names=["known"])
    known = vocabulary.where(F.col("c") > 0).select("word").mapInArrow(run, "known double").agg(F.sum("known")).first()[0]
    return (WORD_STRENGTH + model.discount * tables) / (WORD_STRENGTH + model.customers) * max(0.0, 1.0 - (known or 0.0))


# --- contexts ----------------------------------------------------------------------------

def following(c, t, tables, customers, parent, discount):
    """Predictive probability in the restaurant of a context: ``c`` customers at ``t`` tables of the dish, all
    ``tables`` and ``customers`` of the restaurant, the parent's probability."""
    return (c - discount * t + (CONTEXT_STRENGTH + discount * tables) * parent) / (CONTEXT_STRENGTH + customers)


def _first_seats(block: pa.Table, messages: pa.Table) -> pa.Table:
    """One table for every pair: keeps what the ranges told of a block, and sends the sums of its own pairs.

    ``held`` has the counts for scoring. ``open`` has the pairs with several customers, whose tables are
    sampled, and the sums of all others, whose single customer opens the only table.
    """
    out = wb.Messages()
    for row in block.to_pylist():
        pairs, told = wb.Pairs(row), wb.by_kind(messages)
        c, own = pairs.from_names(wb.joined(told["total"], "a")), pairs.from_names(wb.joined(told["total"], "b"))
        at, counts = wb.joined(told["at"], "a"), wb.joined(told["at"], "b")
        ranges, sizes = wb.layout(told["at"], "a")
        many, one, mine = c > 1, own & (c == 1), own & (c > 0)
        out.add("held", block=row["block"], a=wb.pack(c), b=wb.pack(counts), n1=int(one.sum()), n2=int((own & (c == 2)).sum()))
        out.add("open", block=row["block"], a=wb.pack_sorted(pairs.keys[many]), b=wb.pack(c[many]), c=wb.pack(own[many]),
                d=wb.pack(wb.counted(pairs.u[one], len(at))), e=wb.pack(wb.counted(pairs.w[one], len(at))), f=wb.pack(at))
        wb.send_sums(out, row["block"], wb.counted(pairs.u[mine], len(at)), wb.counted(pairs.w[mine], len(at)),
                     at, ranges, sizes)
    return out.table()


def _sampled(discount: float, sweep: int):
    """Seats the followers of all words of a block anew; rows ``seats`` and sums of the block's own pairs."""
    def run(messages: pa.Table) -> pa.Table:
        out, told = wb.Messages(), wb.by_kind(messages)
        row = wb.only(told["open"])
        u, w = wb.halves(wb.unpack_sorted(row["a"]))
        c, own, load, customers, at = (wb.unpack(row[x]) for x in "bcdef")
        ranges, sizes = wb.layout(told["answer"], "b")
        p, tables = wb.joined(told["answer"], "a").astype(np.float64), wb.joined(told["answer"], "b")
        # numbers that name a word in all blocks
        names = (np.repeat(ranges, sizes) << 32 | at).astype(np.uint64)
        t = seat(c.astype(np.float64), (CONTEXT_STRENGTH + discount * tables[u]) * p[w], discount,
                 wb.mix(wb.mix(names[u]) + names[w]), 1000 + sweep).astype(np.int64)
        out.add("seats", range=sweep, block=row["block"], a=wb.pack(t))
        wb.send_sums(out, row["block"], load + wb.counted(u[own], len(at), t[own]),
                     customers + wb.counted(w[own], len(at), t[own]), at, ranges, sizes)
        return out.table()
    return run


def _answers(state: tuple, sweep: int):
    """What a block needs of a range: probabilities and tables of its words after the sweep."""
    def run(messages: pa.Table) -> pa.Table:
        told, out = wb.by_kind(messages), wb.Messages()
        row, slices = wb.only(told["words"]), told["at"]
        p = predict(wb.word_array(wb.unpack_words(row["words"])), wb.unpack(row["c"]), state).astype(np.float32)
        load, at = wb.unpack(row["b"]), wb.joined(slices, "a")
        out.cut("answer", row["range"], slices["block"].to_numpy(), wb.ends_of(slices, "a"), n1=sweep, a=p[at], b=load[at])
        return out.table()
    return run


def _scored(discount: float, unknowns: list[float], total: int, distinct: int, id_type: pa.DataType):
    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        told = wb.by_kind(messages)
        row = block.to_pylist()[0]
        held, seats = wb.only(told["held"]), {m["range"]: m["a"] for m in told["seats"].select(["range", "a"]).to_pylist()}
        pairs, (c, counts) = wb.Pairs(row, named=False), (wb.unpack(held[x]) for x in "ab")
        ids, at, u, w = pairs.ids, pairs.places(), pairs.u, pairs.w
        mean, closed = np.zeros(len(u)), np.zeros(len(u))
        known, customers, many = counts > 0, counts[u], c > 1
        for sweep, other in enumerate(unknowns, 1):
            # seats of this sweep; the parent as it was left behind them
            t = np.minimum(c, 1)
            t[many] = wb.unpack(seats[sweep])
            later = told["answer"].filter(pc.equal(told["answer"]["n1"], sweep + 1))
            p, tables = wb.joined(later, "a").astype(np.float64), wb.joined(later, "b")[u]
            mean += following(c, t, tables, customers, p[w], discount)
            closed += following(c, t, tables, customers, np.where(known, p, other)[w], discount)
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        lengths = pairs.lengths
        starts = np.r_[0, np.cumsum(lengths)[:-1]]

        def text(x):
            logs = np.log10(np.maximum(x / len(unknowns), 1e-300))
            return pa.array(np.add.reduceat(logs[at], starts), pa.float64())
        return pa.table({
            "id": pa.array(row["doc_ids"], id_type), "held_out": pa.array(row["held_out"], pa.bool_()),
            "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known[ids], starts, dtype=np.int64), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[ids], starts), pa.float64()),
            "score": text(closed), "spelled_score": text(mean)})
    return run


def lm_scores(docs: DataFrame, sweeps: int = SWEEPS, block_tokens: int = BLOCK_TOKENS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``spelled_score``.

    Scores are log10 probabilities of the whole text with its end, each word given the word before it
    (the first one: given an end); 10 ** (-score / n_tokens) is its perplexity. As in the base score, the outcomes
    of ``score`` are the training words and one for all others; ``spelled_score`` also spells the words that
    training never met. Null text is empty and scores its end only. Rows that repeat count and score each by itself;
    a null id trains. Without training documents all words have the base probability. An empty table gives no rows.
    Words and pairs are told apart by 64-bit hashes.
    """
    folder = workspace(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(wb.blocks(named, block_tokens), folder, "blocks")
    tokens = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    bits = wb.range_bits(tokens)

    def at_blocks(left: DataFrame, messages: DataFrame, run, schema: str = wb.MESSAGE) -> DataFrame:
        return left.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, schema)

    lexicon = written(wb.word_slices(blocks, bits).groupBy("range").applyInArrow(wb.lexicon, wb.MESSAGE), folder, "lexicon")
    words, slices = lexicon.where("kind = 'words'"), lexicon.where("kind = 'at'")
    # tables of what later steps read, so that the rest can go
    texts = written(blocks.select("block", "doc_ids", "held_out", "lengths", "ids", "names"), folder, "texts")
    discard(docs.sparkSession, folder, "blocks")
    totals = written(wb.pair_slices(texts, bits).groupBy("range").applyInArrow(wb.totals, wb.MESSAGE), folder, "totals")
    first = written(at_blocks(texts, totals.unionByName(slices), _first_seats), folder, "seats-0")
    slim = written(texts.drop("names"), folder, "slim")
    discard(docs.sparkSession, folder, "totals", "texts")
    held, opened = written(first.where("kind = 'held'"), folder, "held"), first.where("kind = 'open'")
    discount = discount_of(*[x or 0 for x in held.agg(F.sum("n1"), F.sum("n2")).first()])
    total, distinct = (x or 0 for x in words.agg(F.sum("n1"), F.sum("n2")).first())

    sums, told, unknowns, model = first.where("kind = 'sum'"), held, [], None
    for sweep in range(1, sweeps + 2):
        state = written(words.unionByName(sums).groupBy("range").applyInArrow(wb.customers, wb.MESSAGE),
                        folder, f"words-{sweep}")
        vocabulary = wb.vocabulary(state)
        model = model or Words(vocabulary)
        after = model.sweep(vocabulary, state.agg(F.sum("n1")).first()[0] or 0)
        answers = state.unionByName(slices).groupBy("range").applyInArrow(_answers(after, sweep), wb.MESSAGE)
        if sweep > 1:
            unknowns.append(unknown(vocabulary, after))
            answers = written(answers, folder, f"answers-{sweep}")
            told = told.unionByName(answers)
        if sweep <= sweeps:
            seated = written(opened.unionByName(answers).groupBy("block").applyInArrow(_sampled(discount, sweep), wb.MESSAGE),
                             folder, f"seats-{sweep}")
            sums, told = seated.where("kind = 'sum'"), told.unionByName(seated.where("kind = 'seats'"))
        discard(docs.sparkSession, folder, f"words-{sweep}")
    discard(docs.sparkSession, folder, "lexicon", "seats-0")

    kind = slim.schema["doc_ids"].dataType.elementType
    out = at_blocks(slim, told, _scored(discount, unknowns, total, distinct, wb.arrow_type(kind)),
                    f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
                    "score double, spelled_score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                      F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score", "spelled_score")

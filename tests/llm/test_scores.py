"""Chat formats, mixing, quality and language-model scores against brute force."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import pitman_yor, quality_rules as rules
from flowloom.llm.chat_format import chat_round_trip, format_chats, format_turn, parse, read_chats
from flowloom.llm.common import CLEANUP, workspace, written
from flowloom.llm.cotraining import fit, quality_scores, with_quality
from flowloom.llm.mixing import fit_counts, mix_sources, mixed
from flowloom.llm.quality_rules import quality_rules
from flowloom.session import checkpoint_root
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


# --- chats --------------------------------------------------------------------------------

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]", "]", "\\", " ", "a", "\n", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x] y", "\\"]),
                          st.lists(st.sampled_from(BITS), max_size=6).map("".join)), max_size=4))
def test_turns_parse_back(turns):
    made = [format_turn(r, t) for r, t in turns]
    got = parse("".join(m[0] for m in made))
    assert [(r, t) for r, t, _, _ in got] == turns


def test_plain_turns_are_not_escaped():
    assert format_turn("user", "hello there")[0] == "[INST] hello there [/INST]"
    assert [format_turn("assistant", t)[3] for t in ("plain", "a</s>b", "back\\slash")] == [0, 1, 2]


def test_chats_with_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> x"), (1, 2, None, None), (2, 5, "assistant", "b"), (2, 3, "assistant", "a"),
            (None, 1, "assistant", "n"), (None, None, "user", "first"), (3, 1, "user", None), (3, 1, "user", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment int, id string")
    got = {r.conv_id: r for r in chat_round_trip(df).collect()}
    assert set(got) == {1, 2, 3, None}

    def turns(items):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in items).encode()).hexdigest()
    assert got[1].turns_sha256 == turns([("user", "hi"), ("assistant", "</s> x"), ("", "")]) and got[1].n_turns == 3
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, hashlib.sha256(b"</s> x").hexdigest())
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, hashlib.sha256(b"ab").hexdigest())
    assert got[None].turns_sha256 == turns([("user", "first"), ("assistant", "n")])
    assert got[3].n_turns == 2 and got[3].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].formatted_chars == sum(len(format_turn(r, t)[0]) for r, t in [("user", "hi"), ("assistant", "</s> x"), ("", "")])
    assert read_chats(format_chats(df.limit(0))).count() == 0


# --- mixing --------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_exact_on_small_budgets(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 12), 3))
    counts = [rng.randrange(1, 4) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for budget in range(-1, total + 2):
        taken = fit_counts(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts))
        made = sum(n * k for n, k in zip(lengths, taken))
        best = min(abs(sum(n * k for n, k in zip(lengths, ks)) - max(0, budget))
                   for ks in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(made - max(0, budget)) == best


def test_knapsack_of_a_large_budget():
    lengths, counts = list(range(1, 400)), [50] * 399
    taken = fit_counts(lengths, counts, 1_234_567)
    assert sum(n * k for n, k in zip(lengths, taken)) == 1_234_567


def test_mix_of_odd_rows(docs, nothing):
    got = mix_sources(docs).collect()
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t in TEXTS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    # weights go by code point, null last
    weights = dict(zip(sorted(s for s in by if s is not None) + [None] * (None in by), itertools.cycle((5, 2, 1))))
    sizes = {s: sum(r.size for r in rows) for s, rows in by.items()}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in free) if free else 0
        full = {s for s in free if 3 * sizes[s] <= weights[s] * level}
        if not full:
            break
        for s in full:
            target[s], left = 3 * sizes[s], left - 3 * sizes[s]
        free -= full
    target |= {s: weights[s] * level for s in free}
    for s, rows in by.items():
        assert rows[0].source_size == sizes[s] and rows[0].target == pytest.approx(target[s])
        assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs).collect()), key=str)
    assert mix_sources(nothing).count() == 0 and mixed(nothing).count() == 0


def test_mixed_rows_repeat(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = {r.doc_id: r.copies for r in mix_sources(df).collect()}
    got = collections.Counter(r.doc_id for r in mixed(df).collect())
    assert got == {i: c for i, c in plan.items() if c} and max(plan.values()) >= 1


# --- quality ---------------------------------------------------------------------------------

def plain_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(inside), failed)


def test_rules_of_odd_rows(spark, docs, nothing):
    extra = spark.createDataFrame([(50, "same line here\n" * 30 + "same line here"), (51, "# a | b\n \n# a | b\nx"), (52, "q " * 49 + "q")],
                                  "doc_id bigint, text string")
    both = docs.select("doc_id", "text", F.col("size").alias("n_words")).unionByName(extra, allowMissingColumns=True)
    labels = spark.createDataFrame([(6, 1), (7, 0)], "doc_id bigint, quality int")
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = quality_rules(both, labels).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in got) == sorted((i or 0, *plain_counts(t)) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules(nothing, labels).count() == 0
    assert all(r.llr == 0 for r in quality_rules(docs, labels.limit(0)).collect())


def test_rules_use_no_python_and_keep_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made = quality_rules(docs, labels)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    good = made.join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert good.where("not kept").count() == 0


def test_ratio_is_the_mean_of_bucket_weights(spark):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "x#"] if i % 2 else ["alpha", "beta", "gamma"], k=60)))
            for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30, 2)], "doc_id bigint, quality int")
    got = {r.doc_id: r.llr for r in quality_rules(docs, labels).collect()}
    counts = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in rows:
        w = t.split()
        for part, features in enumerate((w, list(zip(w, [*w[1:], ""])))):
            counts[0][part].update(features)
            if i % 2 == 0:
                counts[1][part].update(features)

    def weight(part, f):
        raw, good = counts[0][part], counts[1][part]
        share, pseudo = sum(good.values()) / sum(raw.values()), sum(good.values()) / rules.BUCKETS
        return math.log(good[f] + pseudo) - math.log(raw[f] * share + pseudo)
    for i, t in rows:
        w = t.split()
        want = sum(weight(0, x) for x in w) + sum(weight(1, x) for x in zip(w, [*w[1:], ""]))
        assert got[i] == pytest.approx(want / (2 * len(w)), abs=1e-9)


@pytest.mark.parametrize("broadcast", [1 << 18, 0])
def test_every_trusted_document_counts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", broadcast)
    # more labelled documents than any fixed number of them that was counted before
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    one, two = rules.feature_weights(docs, labels, "doc_id", "text")
    assert set(one) == {0.0} and set(two) == {0.0}
    assert all(r.llr == 0 for r in rules.quality_rules(docs, labels).select("llr").distinct().collect())


@pytest.mark.parametrize("times", [2, 10])
def test_verdicts_do_not_depend_on_the_size_of_the_tables(spark, times):
    """All rows and labels taken several times: every copy is judged as the row was."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))

    def several(df):
        return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(
            "doc_id", F.col("doc_id") + F.col("copy") * 1_000_000).drop("copy")
    once = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    many = quality_rules(several(docs), several(labels)).collect()
    assert len(many) == times * len(once)
    for r in many:
        one = once[r.doc_id % 1_000_000]
        assert r.kept == one.kept and r.llr == pytest.approx(one.llr, abs=1e-9)


def test_co_training_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learnt, apart = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = fit(docs, learnt)
    rows = with_quality(docs, model).select("doc_id", "quality_view.*").join(apart, "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.95
    assert sum(r.quality == 1 and not r.keep for r in rows) <= 0.02 * len(rows)


def test_classifier_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 1), (9, 0), (10, 0), (6, 1), (12, 0), (None, 1)], "doc_id bigint, quality int")
    assert quality_scores(docs, labels).count() == len(TEXTS)
    assert all(r.keep for r in quality_scores(docs, labels.limit(0)).collect())
    assert quality_scores(nothing, labels).count() == 0


# --- language model ----------------------------------------------------------------------------

def test_base_scores_of_odd_rows(docs, nothing):
    got = pitman_yor.lm_scores(docs, block_tokens=500).collect()
    counts = collections.Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in TEXTS]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in TEXTS}
    for i, words in tokens:
        if not held[i]:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((i or 0, held[i], len(w), sum(counts[x] > 0 for x in w), total,
                   round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for i, w in tokens)
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.spelled_score <= 0 for r in got)
    assert pitman_yor.lm_scores(nothing).count() == 0


def test_scores_leave_only_what_the_result_reads(docs, spark):
    root = pathlib.Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.glob("llm-*"))
    got = pitman_yor.lm_scores(docs, block_tokens=500)
    made, = set(root.glob("llm-*")) - before
    assert {x.name for x in made.iterdir()} == {"slim", "held", "seats-1", "seats-2", "answers-2", "answers-3"}
    assert got.count() == len(TEXTS)


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [pathlib.Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {x for d in folders for x in d.rglob("shuffle_*.data")}
    before, set_before = files(), spark.conf.get(CLEANUP)
    table = written(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count(), workspace(spark), "groups")
    for _ in range(50):  # the files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == set_before
    assert table.count() == 97


def test_outcomes_add_up_to_one(spark):
    words = [(w.encode(), c) for w, c in (("the", 40), ("then", 7), ("cat", 3), ("cab", 1), ("", 9), ("dog", 1))]
    vocabulary = spark.createDataFrame(words, "word binary, c bigint")
    model = pitman_yor.Words(vocabulary)
    for _ in range(2):
        state = model.sweep(vocabulary, 61)
    names, counts = pa.array([w for w, _ in words], pa.binary()), np.array([c for _, c in words])
    known, other = pitman_yor.predict(names, counts, state), pitman_yor.unknown(vocabulary, state)
    assert known.sum() + other == pytest.approx(1, abs=1e-9)
    for ctx in (pitman_yor.START << 9 | pitman_yor.START, ord("t") << 9 | ord("h"), 0):
        assert state[2].two(np.full(257, ctx), np.arange(257)).sum() == pytest.approx(1, abs=1e-9)
    # and behind a word: its followers, all other words, and those that training never met
    c, d = np.array([5, 0, 2, 1, 1, 0]), 0.6
    t = np.where(c > 0, pitman_yor.seat(np.maximum(c, 1).astype(float), np.full(6, 0.7), d, np.arange(6), 1), 0)
    outcomes = [*pitman_yor.following(c, t, t.sum(), c.sum(), known, d), pitman_yor.following(0, 0, t.sum(), c.sum(), other, d)]
    assert sum(outcomes) == pytest.approx(1, abs=1e-9)


def test_scores_by_brute_force(spark):
    """Where every pair of training words occurs once, all seats behind words are known without sampling."""
    texts = ["a b c d e", "b d a e c", "c a d b", "e b a f", "f g ab cab", "g a zz b h", "A q"]
    ids = [i for i in range(1, 60) if not pitman_yor.wb.held_out(i)][:6] + [i for i in range(1, 60) if pitman_yor.wb.held_out(i)][:1]
    apart = {ids[-1]}
    tokens = {i: (t.lower() + " ").split(" ") for i, t in zip(ids, texts)}
    pairs, customers, words, load = (collections.Counter() for _ in range(4))
    for i, ws in tokens.items():
        if i not in apart:
            pairs.update(zip([""] + ws, ws))
            words.update(ws)
    # a pair that returned would be seated at random
    assert max(pairs.values()) == 1
    for u, w in pairs:
        customers[w] += 1
        load[u] += 1
    vocabulary = spark.createDataFrame([(w.encode(), n) for w, n in customers.items()], "word binary, c bigint")
    model, p, others = pitman_yor.Words(vocabulary), [], []
    every = sorted({w for ws in tokens.values() for w in ws})
    for sweep in range(3):
        state = model.sweep(vocabulary, sum(customers.values()))
        if sweep:
            got = pitman_yor.predict(pa.array([w.encode() for w in every], pa.binary()),
                                     np.array([customers[w] for w in every]), state)
            p.append(dict(zip(every, got)))
            others.append(pitman_yor.unknown(vocabulary, state))
    discount = pitman_yor.discount_of(len(pairs), 0)
    want = {}
    for i, ws in tokens.items():
        want[i] = sum(math.log10(sum(pitman_yor.following(
            pairs[u, w], pairs[u, w], load[u], words[u], q[w] if words[w] else o, discount)
            for q, o in zip(p, others)) / 2) for u, w in zip([""] + ws, ws))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id int, text string").repartition(3)
    for size in (3, 1000):
        got = {r.doc_id: r.score for r in pitman_yor.lm_scores(docs, block_tokens=size).collect()}
        assert got == pytest.approx(want, abs=1e-4)


def test_order_of_words_counts_and_blocks_do_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    turned = docs.withColumn("text", F.array_join(F.reverse(F.split("text", r"[\x20\x09-\x0D]+")), " "))
    few = docs.where("doc_id < 300").unionByName(turned.where("doc_id < 300 and doc_id % 10 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    got = {r.doc_id: r for r in pitman_yor.lm_scores(few).collect()}
    small = {r.doc_id: r for r in pitman_yor.lm_scores(few.repartition(7), block_tokens=2000).collect()}
    assert {i: r.score for i, r in small.items()} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-6)
    # the same words the other way round, of documents that trained; the copies are held out
    moved = [i for i in got if i > 1_000_000 and got[i].held_out and not got[i - 1_000_000].held_out and got[i].n_tokens > 20]
    assert moved and all(got[i].score < got[i - 1_000_000].score - 1 for i in moved)


def test_arrays_travel_whole():
    for a in (np.zeros(0, np.int64), np.array([0, 5, 5, 2**40]), np.array([True, False]), np.float32([0.5, 1e-9])):
        back = pitman_yor.wb.unpack(pitman_yor.wb.pack(a))
        assert back.dtype == a.dtype and (back == a).all()
    names = np.sort(pitman_yor.wb.mix(np.arange(1000)))
    assert (pitman_yor.wb.unpack_sorted(pitman_yor.wb.pack_sorted(names)) == names).all()
    assert [x[0] for x in pitman_yor.wb.cut(names, 3)] == list(range(8)) and list(pitman_yor.wb.cut(names[:0], 3)) == []


def test_slices_cost_no_work_each(monkeypatch):
    """There are blocks times ranges of them, so a range reads its slices as one array and cuts its answers out of one."""
    wb, packed = pitman_yor.wb, []
    plain = wb.pack
    monkeypatch.setattr(wb, "pack", lambda a: packed.append(len(a)) or plain(a))
    rng, n = np.random.default_rng(1), 300
    names = [np.sort(rng.integers(0, 500, size, np.uint64)) for size in rng.integers(1, 40, n)]
    names = [np.unique(x) for x in names]
    # slices of other widths: many blocks count to 255, some further
    counts = [rng.integers(0, 70_000 if k % 50 == 0 else 200, len(x)) for k, x in enumerate(names)]
    out = wb.Messages()
    for k, (x, c) in reversed(list(enumerate(zip(names, counts)))):
        words = b"".join(b"w%d " % name for name in x)
        words = np.frombuffer(words, np.uint8)
        out.cut("slice", np.array([3]), k, np.array([0, len(x)]), words=(words, np.array([0, len(words)])), a=wb.low(x, 8), b=c)
    want = collections.Counter()
    for x, c in zip(names, counts):
        want.update(dict(zip(x.tolist(), c.tolist())))
    told = wb.by_kind(wb.totals(out.table()))["total"]
    assert told["block"].to_pylist() == list(range(n)) and (wb.layout(told, "a")[1] == [len(x) for x in names]).all()
    assert wb.joined(told, "a").tolist() == [want[i] for x in names for i in x.tolist()]
    assert wb.joined(told, "b").sum() == len(want) and not packed
    told = wb.by_kind(wb.lexicon(out.table()))
    row, at = wb.only(told["words"]), told["at"]
    every = wb.word_array(wb.unpack_words(row["words"])).to_pylist()
    assert every == [b"w%d" % i for i in sorted(want)] and wb.unpack(row["a"]).tolist() == [want[i] for i in sorted(want)]
    assert [every[i] for i in wb.joined(at, "a")] == [b"w%d" % i for x in names for i in x]
    assert wb.joined(at, "b").tolist() == [want[i] for x in names for i in x.tolist()] and len(packed) == 1


def test_words_are_those_of_bytes(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", " a", "b ", *["".join(rng.choices(" \t\n\x0b\x0c\raAZ\u00e9\u00c4\x1c\x85\u3000\x00\u4e2d", k=rng.randrange(40)))
                                    for _ in range(500)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    for size in (1 << 20, 50):
        monkeypatch.setattr(pitman_yor.wb, "SPLIT_BYTES", size)
        got = [x for _, words in pitman_yor.wb._split(batch) for x in words.to_pylist()]
        assert [[w.encode() for w in x] for x in got] == [t.encode().lower().split() + [b""] for t in texts]


def test_seats_follow_the_restaurant():
    """One dish alone: tables and odds of new ones as the process seats customers one by one."""
    n, d, fresh = 60, 0.5, 3.0
    names = np.arange(20_000, dtype=np.uint64) * np.uint64(7919)
    tables = pitman_yor.seat(np.full(20_000, n), np.full(20_000, fresh), d, names, 1)
    spread = {1: 1.0}
    for k in range(1, n):
        after = collections.defaultdict(float)
        for t, p in spread.items():
            odds = fresh / (fresh + k - d * t)
            after[t + 1] += p * odds
            after[t] += p * (1 - odds)
        spread = after
    mean = sum(t * p for t, p in spread.items())
    assert tables.mean() == pytest.approx(mean, rel=0.02)
    many = pitman_yor.seat(np.full(2000, 100_000), np.full(2000, fresh), d, names[:2000], 2)
    assert many.min() >= 1 and many.max() < 200


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = pitman_yor.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b

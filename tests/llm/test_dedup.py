"""Exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm.common import workspace
from flowloom.llm.components import components
from flowloom.llm.exact_dedup import deduplicated, exact_dedup
from flowloom.llm import ngram_join as module
from flowloom.llm.ngram_join import ngram_join, one_per_component
from tests.llm.conftest import TEXTS


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for text, members in groups.items():
        keep = min((m for m in members if m is not None), default=None)
        first = True
        for m in sorted(members, key=lambda m: (m is None, m or 0)):
            out.append((m or 0, keep or 0, len(members), m == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and m != keep
    return sorted(out)


def exact_rows(df):
    return sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_dedup_of_odd_rows(docs):
    assert exact_rows(exact_dedup(docs)) == brute_exact(TEXTS)


@pytest.mark.parametrize("bucket_keys", [1, 4, 256])
def test_hot_groups_are_salted(spark, bucket_keys):
    rng = random.Random(3)
    rows = [(i, "copy of a very common page" if i % 3 == 0 else f"page {rng.randrange(60)}") for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert exact_rows(exact_dedup(df, bucket_keys=bucket_keys)) == brute_exact(rows)


def test_dedup_uses_no_python(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_deduplicated_keeps_columns(docs):
    got = deduplicated(docs)
    assert got.columns == docs.columns
    assert got.count() == len({normal(t) for _, t in TEXTS})


def shingle_set(text, n):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i or 0, len(sets[k]), least.get(find(k), 0) or 0) for k, (i, _) in enumerate(rows))


def join_rows(df):
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in df.collect())


def test_join_of_odd_rows(docs):
    assert join_rows(ngram_join(docs)) == brute_components(TEXTS, 4, 85, 100)


@pytest.mark.parametrize("n,num,rounds,short", [(4, 85, 2, 64), (5, 80, 1, 2), (2, 70, 0, 2), (3, 60, 1, 10)])
def test_join_of_edited_groups(spark, monkeypatch, n, num, rounds, short):
    # short lists and small blocks, so that long lists are cut
    monkeypatch.setattr(module, "SHORT_LIST", short)
    monkeypatch.setattr(module, "BLOCK_MEMBERS", 7)
    rng = random.Random(n)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([12, 40, 90]))]
        common = ["shared", "passage", "that", "many", "documents", "hold"] * 2
        for _ in range(rng.choice([2, 15, 40])):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(own + (common if base % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join(df, n=n, num=num, leader_rounds=rounds)
    assert join_rows(got) == brute_components(rows, n, num, 100)


@pytest.mark.parametrize("block", [4, 256])
def test_links_count_every_linked_row(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_MEMBERS", block)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, "another text of no one"), (2, "another text of no one"), (3, None)]
    for i in range(4, 34):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    sets = [shingle_set(t, 4) for _, t in rows]
    want = {i: sum(bool(sets[a]) and a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
                   for b in range(len(rows))) for a, (i, _) in enumerate(rows)}
    got = {r.doc_id: r.links for r in ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and want[1] == 1 and max(want.values()) > 3


def test_one_per_component_keeps_columns(docs):
    got = one_per_component(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert 1 in kept and 5 not in kept and 11 not in kept and 6 in kept and 7 not in kept and 2 in kept and None in kept


def test_one_per_component_drops_rows_not_ids(spark):
    rows = [(3, "one text that two rows hold"), (7, "one text that two rows hold"), (7, "something else of no other row")]
    got = one_per_component(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 100), (400, 400)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges, workspace(spark), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_empty_tables(nothing):
    assert exact_dedup(nothing).count() == 0
    assert ngram_join(nothing).count() == 0
    assert one_per_component(nothing).count() == 0


def test_null_text_links_with_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, " ")], "doc_id bigint, text string")
    assert join_rows(ngram_join(df)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert ngram_join(df).where(F.col("links") > 0).count() == 0


def test_workers_of_the_join_keep_little(spark):
    module._HASHES.clear()
    for k in range(10):
        module.shingles(" ".join(f"w{i}" for i in range(k * 20_000, (k + 1) * 20_000)), 4)
    assert len(module._HASHES) <= (1 << 16) + 1
    # one byte a cell travels with the tasks, and frequent tokens still come last
    rows = spark.createDataFrame([(i, "a b c d") for i in range(9)] + [(9, "e f g h")], "id int, text string").coalesce(1)
    weights = module._weights(rows, 4)
    assert weights.nbytes == 1 << module.CELL_BITS
    both = np.concatenate([module.shingles(t, 4) for t in ("a b c d", "e f g h")])
    keys = module.prefix(both, weights, None, 85, 100, 2)
    assert [int(k >> np.uint64(56)) for k in keys] == [4, 0]

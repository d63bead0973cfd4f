"""Near-duplicate vectors against all pairs of a small table."""

import math

import numpy as np
import pytest

from flowloom.llm import embedding_neardup as module
from flowloom.llm.embedding_neardup import index_shape, near_vectors, same_interval

SCHEMA = "vec_id bigint, embedding array<double>, label int, cls string, bucket int"


def brute(rows, cosine=0.98):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, u, p, *_), (_, v, q, *_) = rows[a], rows[b]
            if p == q and fine(u, p) and fine(v, q) and len(u) == len(v):
                x, y = np.array(u, float) / np.abs(u).max(), np.array(v, float) / np.abs(v).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        seen, queue = {a}, [a]
        while queue:
            for b in links[queue.pop()] - seen:
                seen.add(b)
                queue.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def groups(rng, dim, sizes, noise):
    out = []
    for size in sizes:
        center = rng.standard_normal(dim)
        center /= np.linalg.norm(center)
        for _ in range(size):
            v = center + rng.standard_normal(dim) * noise / math.sqrt(dim)
            out.append((len(out), [float(x) for x in v * rng.uniform(0.1, 9)], len(out) % 2, "x", 1))
    return out


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1),
            (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.01], 1), (None, [-1.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1e300, 1e298], 1), (13, [1e-300, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(near_vectors(df)) == brute(rows)


@pytest.mark.parametrize("block,small", [(512, 24), (8, 24), (8, 2)])
def test_groups_cut_into_blocks(spark, monkeypatch, block, small):
    # the limits are set where the tasks run, too: workers of a local session are forked or given the closure
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "SMALL", small)
    rng = np.random.default_rng(block + small)
    rows = groups(rng, 24, [1] * 40 + [2, 3, 5, 60, 90], 0.12)
    rows += [(1000 + i, rows[-1][1], rows[-1][2], "x", 1) for i in range(30)]
    want = brute(rows)
    assert max(n for _, n, *_ in want) > 40
    assert found(near_vectors(spark.createDataFrame(rows, SCHEMA))) == want


def test_index_misses_little(spark):
    rng = np.random.default_rng(7)
    k, tables = index_shape(5000)
    assert math.log(1 - same_interval(0.2) ** k) * tables <= math.log(module.MISS)
    # pairs at the threshold: measured recall against all pairs
    hits = 0
    for _ in range(300):
        u, e = module.unit(rng.standard_normal((1, 64)))[0], rng.standard_normal(64)
        e = module.unit((e - (e @ u) * u)[None])[0]
        v = 0.98 * u + math.sqrt(1 - 0.98 ** 2) * e
        a, b = module.codes(np.array([u, v]), k, tables)
        hits += bool((a == b).any())
    assert hits >= 299


def test_one_label_and_repeats_grow_no_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, "x", 1) for i in range(400)] + [(400 + i, [float(i), 1.0, -2.0], 1, "x", 1) for i in range(9)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7].n_links == 399 and got[7].component_id == 0 and not got[7].kept and got[0].kept


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0

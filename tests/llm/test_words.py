"""Spelling variants and the filter audit against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from flowloom.llm import filter_audit as audit_module, spelling as module
from flowloom.llm.filter_audit import filter_audit
from flowloom.llm.spelling import leaves, grow, near_words, one_edit, spelling_variants, vector
from flowloom.llm.common import workspace, written
from tests.llm.conftest import TEXTS

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def edits(a, b):
    """Is b one inserted, deleted or replaced code point away? By trying all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if x != w and edits(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) if x else None for w, x in near.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else 0, root(w)) for w in n)


def word_rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def misspelt(rng, n_docs, words):
    out = []
    for i in range(n_docs):
        text = []
        for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=200):
            at = rng.randrange(len(w))
            text.append(rng.choice([w, w, w, w.upper(), w[:at] + w[at + 1:], w[:at] + rng.choice("aeézÿÀ") + w[at:],
                                    w[:at] + rng.choice("aeéz") + w[at + 1:]]))
        out.append((i, rng.choice([" ", "-", "1"]).join(text)))
    return out


@pytest.mark.parametrize("cell", [512, 3])
def test_variants_of_misspelt_words(spark, monkeypatch, cell):
    # small cells: deep names, and cells cut into blocks
    monkeypatch.setattr(module, "CELL", cell)
    rng = random.Random(cell)
    words = ["".join(rng.choices("etaniorsé", k=rng.randrange(4, 10))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    long = "ab" * 300
    rows = misspelt(rng, 60, words) + [(70, f"{long} {long}a {long[1:]} {long[1:]}c " * 3), (None, "aaaaa aaaab " * 3), (5, None), (5, "aaaab"), (6, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    want = brute_words(rows)
    assert sum(bool(w[3]) for w in want) > 50
    assert word_rows(spelling_variants(df)) == want


def test_all_pairs_of_short_alphabet(spark):
    words = ["".join(p) for k in (5, 6) for p in set(permutations("aaabbc", k))]
    df = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(words)], "word string, n bigint")
    got = sorted((r.word, r.near) for r in near_words(df, workspace(spark)).collect())
    assert got == sorted((a, b) for a in words for b in words if a != b and edits(a, b))


def test_trie_search_keeps_to_the_budget(monkeypatch):
    rng = random.Random(1)
    words = {}
    for _ in range(300):
        word = "".join(rng.choices("etanio", k=rng.randrange(5, 8)))
        words.setdefault(vector(word), []).append((word, 3))
    for leaf in (1, 16, 10_000):
        monkeypatch.setattr(module, "LEAF", leaf)
        trie = grow(words, 0)
        for vec in list(words)[:40]:
            reached = [named for named in leaves(trie, vec, int.from_bytes(vec, "big"), 1, 1, 0)]
            for other, named in words.items():
                over = [x - y for x, y in zip(other, vec)]
                fits = sum(d for d in over if d > 0) <= 1 and -sum(d for d in over if d < 0) <= 1
                assert (named in reached) == fits


@pytest.mark.parametrize("a,b,near", [("abcde", "abcde", False), ("abcde", "abcdf", True), ("abcde", "abcdef", True),
                                      ("abcde", "xabcde", True), ("abcde", "abxcde", True), ("abcde", "badce", False),
                                      ("abcde", "abcdefg", False), ("aaaaa", "aaaaaa", True)])
def test_one_edit(a, b, near):
    assert one_edit(a, b) == near == edits(a, b)


def test_words_of_odd_rows(docs, nothing):
    assert word_rows(spelling_variants(docs)) == brute_words(TEXTS)
    assert spelling_variants(nothing).count() == 0


def brute_audit(rows, labels):
    """rows: (id, text, part)"""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    fails, parts = [], sorted({p or "" for *_, p in rows})
    for i, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        fails.append((p or "", i in good, i in toxic, "".join(c for c, f in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), first is not None and (i is None or i > first))) if f)))
    out, removed = [], defaultdict(int)
    for part in parts:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order):
                before = set(order[:step])
                gone = [f for f in own if c in f[3] and not before & set(f[3])]
                removed[part, c] += len(gone)
                out.append([part, order, step + 1, sum(not (before | {c}) & set(f[3]) for f in own), len(gone),
                            sum(c in f[3] and bool(before & set(f[3])) for f in own), sum(f[3] == c for f in own),
                            sum(f[1] for f in gone), sum(f[2] for f in gone)])
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows(df):
    return sorted(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley").collect()))


def test_audit(spark, docs):
    rng = random.Random(2)
    rows = [(i, t, "en" if i and i % 2 else None) for i, t in TEXTS]
    for i in range(100, 400):
        words = [rng.choice(["Word", "word", "OTHER", "more", "x%", "y"]) + str(rng.randrange(rng.choice([9, 900])))
                 for _ in range(rng.choice([40, 99, 100, 150]))]
        rows.append((i, " ".join(words) if i % 3 else "one hot text # of many rows", rng.choice(["de", "en", "", None])))
    rows += [(None, rows[-1][1], "en"), (399, rows[-1][1], "en"), (None, "A", "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(100, 300)] + [(100, 1, 1), (None, 1, 1), (101, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, lang string, row int, good string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert audit_rows(filter_audit(df, known)) == brute_audit(rows, labels)


def test_audit_broadcasts_no_rows(docs, spark, monkeypatch):
    """However small Spark takes tables of ids for, they do not go through the driver."""
    plans = []

    def seen(df, folder, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, folder, name)
    monkeypatch.setattr(audit_module, "written", seen)
    known = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert filter_audit(docs, known).count() == 2 * 600
    met = [line for plan in plans for line in plan.splitlines() if "Join [row" in line or "Join [id" in line]
    assert len(met) > 30 and not [line for line in met if "BroadcastHashJoin" in line]


def test_audit_of_empty_tables(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit(nothing, none).count() == 0
    got = filter_audit(docs, none)
    assert got.count() == 2 * 600 and got.where("good_lost + toxic_lost > 0").count() == 0

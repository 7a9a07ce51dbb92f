import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import neardup, queries
from tallyforge.llm.common import shared_dir
from tallyforge.llm.components import connected


def plain_sets(rows, size=2):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    return out


def brute(rows, size=2):
    sets = plain_sets(rows, size)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def variants(rng, n, length, change):
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in range(length):
            if rng.random() < change:
                words[k] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_registers_agree_like_jaccard():
    rng = np.random.default_rng(3)
    for n in (4, 40, 4000):
        hits, want = [], []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            both = rng.integers(1, n)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            want.append(both / (2 * n - both))
            hits.append(neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(np.array(hits) - want)) < 0.02


def test_register_order():
    x = np.sort(np.random.default_rng(1).integers(0, 2**56, 1000, dtype=np.uint64))
    r = neardup._register(x)
    zeros, mantissa = r >> 10, r & 1023
    order = list(zip((-zeros.astype(int)).tolist(), mantissa.tolist()))
    assert order == sorted(order)
    assert neardup._register(np.array([0, 1, 2**55], np.uint64)).tolist() == [56 << 10, 55 << 10, 0]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 9)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)]])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, {a}).update([b])
            root.setdefault(b, {b}).update([a])
    changed = True
    while changed:
        changed = False
        for a in root:
            more = set().union(*(root[x] for x in root[a]))
            if more != root[a]:
                root[a], changed = more, True
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, connected(df, shared_dir(spark)).collect())) == sorted((a, min(s)) for a, s in root.items())


def test_rows_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", "One", "one", "ONE two", "one two", "é x", "É x"]
    texts += variants(rng, 60, 60, 0.02) + variants(rng, 60, 60, 0.06) + variants(rng, 40, 8, 0.05) + variants(rng, 3, 5000, 0.01)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(50)] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS rep", "0 AS n", "1 AS key")
    got = sorted(map(tuple, neardup.groups(df).collect()))
    assert got == brute(rows)
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [i for i, _, _, kept in got if kept]
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    assert sorted(map(tuple, neardup.groups(df, shingle=3).collect())) == brute(rows, 3)
    assert neardup.groups(df.limit(0)).count() == 0
    twice = neardup.groups(df.limit(20).union(df.limit(20))).collect()
    assert len(twice) == 40


def test_all_texts_of_a_document_are_linked(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    for order in (1, -1):
        rows = [(1, a), (1, b), (5, a + " tail"), (6, b + " tail"), (7, c), (8, c + " tail"), (7, c), (2, a), (None, b)][::order]
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(1, 1, True), (5, 1, False), (6, 1, False), (2, 1, False), (7, 7, True), (8, 7, False), (None, 1, True)}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two three", 5), (2, "one two three", 6)], "doc_id long, text string, kept int").selectExpr("*", "0 AS kept_", "1 AS __kept")
    assert [r.kept for r in neardup.keep_one(df).collect()] == [5]


def test_op2_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op2_near_duplicates"](spark, sf).collect())) == brute(rows)

import re

import numpy as np
import pytest

from tallyforge.llm import mixing, queries


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1025])
def test_permutation(n):
    key = mixing._key(1, 2, 3)
    p = mixing.permute(np.arange(n), n, key)
    assert sorted(p) == list(range(n))
    assert (mixing.permute(p, n, key, inverse=True) == np.arange(n)).all()


def test_targets():
    assert mixing.targets([10, 10, 10]) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    t = mixing.targets([1000, 1, 50, 3])
    assert sum(t) == pytest.approx(1.5 * 1054) and all(x <= 2 * s for x, s in zip(t, [1000, 1, 50, 3]))


def test_shards_sum():
    c = mixing.shard_counts([10, 0, 500, 3], 7, 5)
    assert c.sum(axis=0).tolist() == [10, 0, 500, 3] and c.sum(axis=1).max() - c.sum(axis=1).min() <= 1
    assert mixing.shard_counts([0, 0], 3, 1).sum() == 0


def checked(rows, docs, loose=1):
    by = {}
    for i, text, source in docs:
        by.setdefault(source, 0)
        by[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(by, key=lambda s: (s is None, s))
    want = dict(zip(order, mixing.targets([by[s] for s in order])))
    source = {i: s for i, _, s in docs}
    took = dict.fromkeys(order, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    for s in order:
        assert abs(took[s] - want[s]) <= loose


def test_small_tables(spark):
    docs = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "q " * 5000, None), (5, "a\x0bb c", "é"), (6, "a " * 700, "y"), (7, "b", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'z' AS src")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    checked(rows, docs)
    assert sorted(rows) == sorted(mixing.mix(df.repartition(3)).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df.selectExpr("*", "1 AS __uses", "2 AS uses", "3 AS nth", "4 AS H")).columns[-4:] == ["__uses", "uses", "nth", "H"]
    twice = spark.createDataFrame([(1, "a b c", "x")] * 4, "doc_id long, text string, source string")
    assert len(mixing.mix(twice).collect()) == 4


def test_small_blocks(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for block in (16, 100_000):
        checked(mixing.mix(df, block=block).collect(), docs)


def test_op4_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    checked(queries.QUERIES["op4_source_mix"](spark, sf).collect(), docs)


def plain_targets(sizes):
    """Shares by weight, full sources taken out one after the other, the fullest first."""
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    out, open_, left = {}, set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        total = sum(weight[k] for k in open_)
        k = min(open_, key=lambda k: (sizes[k] / weight[k], k))
        if left * weight[k] / total < 2 * sizes[k]:
            return [out[k] if k in out else left * weight[k] / total for k in range(len(sizes))]
        out[k] = 2 * sizes[k]
        left -= out[k]
        open_.remove(k)
    return [out[k] for k in range(len(sizes))]


def test_targets_by_another_way():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 9):
        for _ in range(50):
            sizes = rng.integers(0, 1000, n).tolist()
            assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))


def test_one_task_a_run(spark):
    s = mixing._plan("sa", 0, 10**7, 10**7, 64, 1)
    assert mixing.slot_blocks(spark, [s], 64, 4, 1).rdd.getNumPartitions() >= -(-s.slots // mixing.RUN)


def test_blocks_are_taken_evenly(spark):
    """Each block of a source as often as its slots' epochs say, by counting in Python."""
    s = mixing._plan("sa", 3, 1000, 1700, 64, 1)
    want = [int(mixing.permute(np.array([j % s.blocks]), s.blocks, mixing._key(1, 0, j // s.blocks))[0]) for j in range(s.slots)]
    got = mixing.slot_blocks(spark, [s], 64, 4, 1).collect()
    assert sorted(r.block for r in got) == sorted(want) and max(want.count(b) for b in want) <= 2
    assert sorted(r.words for r in got).count(64) >= s.slots - 1


def test_slots_are_blocks(spark):
    sources = [mixing._plan("sa", 0, 1000, 1300, 64, 1), mixing._plan("sb", 1, 10, 20, 64, 1)]
    rows = mixing.slot_blocks(spark, sources, 64, 4, 1).collect()
    assert len(rows) == sum(s.slots for s in sources) and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_copies():
    text = " a  b c\nd e "
    assert mixing.copies(text, [(0, 5, 1)]) == [text]
    assert mixing.copies(text, [(0, 3, 2), (3, 5, 2)]) == [text, text]
    assert mixing.copies(text, [(0, 2, 2), (2, 2, 9), (2, 4, 1), (4, 5, 0)]) == ["a  b c\nd", "a  b"]
    assert mixing.copies(text, [(0, 1, 1), (1, 4, 0), (4, 5, 1)]) == ["a e"]
    assert mixing.copies("", []) == []


def test_mixed_documents_hold_what_is_taken(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS size", "2 AS h")
    extra = spark.createDataFrame([(10**6, None, "en", "src1", 0, 1, 2), (10**6 + 1, "", "en", None, 0, 1, 2)] + [(10**6 + 2, "same words " * 200, "en", "src2", 1, 1, 2)] * 3, df.schema)
    df = df.union(extra)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for block in (16, 256):
        rows = mixing.mixed_documents(df, block=block).collect()
        assert mixing.mixed_documents(df, block=block).schema == df.schema
        words, want = {}, {}
        for r in rows:
            words[r.doc_id] = words.get(r.doc_id, 0) + count(r.text)
            assert r.n_chars == len(r.text)
        for r in mixing.mix(df, block=block).collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
        assert words == {i: n for i, n in want.items() if n}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_draws_are_multinomial():
    """The first shard's counts over many seeds: chi-square against multinomial shares, and their covariance."""
    slots = [50_000, 20_000, 10_000]
    drawn = np.array([mixing.shard_counts(slots, 80, seed)[0] for seed in range(300)])
    n, p = int(drawn[0].sum()), np.array(slots) / sum(slots)
    chi = ((drawn - n * p) ** 2 / (n * p)).sum(axis=1)
    assert abs(chi.mean() - 2) < 0.5  # two degrees of freedom
    cov = np.cov(drawn.T) / n
    assert np.abs(cov - (np.diag(p) - np.outer(p, p))).max() < 0.05
    assert (mixing.shard_counts(slots, 80, 1).sum(axis=0) == slots).all()


def test_shards_hold_the_mix(spark):
    docs = [(k, " ".join(f"w{k}_{j}" for j in range(k % 37)), "ab"[k % 5 == 0]) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix(df, block=16, shards=5, seed=3).collect()}
    assert all(sum(u.words for u in r.uses) == r.taken for r in rows.values())
    segments = mixing.shard_segments(df, block=16, shards=5, seed=3).collect()
    by: dict = {}
    for s in segments:
        assert 0 <= s.first < s.last <= rows[s.doc_id].size
        key = (s.doc_id, s.shard, s.block)
        by[key] = by.get(key, 0) + s.last - s.first
    assert by == {(i, u.shard, u.block): u.words for i, r in rows.items() for u in r.uses}
    assert len({s.shard for s in segments}) == 5
    slots: dict = {}
    for s in sorted(segments, key=lambda s: (s.shard, s.slot, s.start)):
        assert s.start == slots.get((s.shard, s.slot), 0)  # a slot's pieces follow each other without a gap
        slots[s.shard, s.slot] = s.start + s.last - s.first
    sources = mixing.plan_sources(mixing._sized(df, "doc_id", "text", "source"), 16, 3)
    counts = mixing.shard_counts([s.slots for s in sources], 5, 3)
    assert [len({k for k in slots if k[0] == n}) for n in range(5)] == counts.sum(axis=1).tolist()
    other = {r.doc_id: r for r in mixing.mix(df, block=16, shards=5, seed=4).collect()}
    assert any(rows[i].uses != other[i].uses for i in rows)


def test_shards_by_size():
    source = mixing.Source("s", 1, 1.0, 1, 3 * mixing.SHARD_SLOTS + 1, 0)
    assert mixing.shards_for([source]) == 4 and mixing.shards_for([]) == 1 and mixing.shards_for([source], 9) == 9

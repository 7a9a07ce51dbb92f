import math
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import pieces, queries


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.model_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from([" ", "  ", "▁", "▁▁ ", "\n", "the ", "😀", "日本"])), max_size=6).map("".join), st.integers(-(2**63), 2**63 - 1))
def test_lossless_and_reproducible(v, text, key):
    one = pieces.sample_segmentations([text], [key], v)[0]
    assert pieces.decode(one, v) == text
    many = pieces.sample_segmentations(["other words", text, "the the"], [1, key, 2], v)[1]
    assert one.tolist() == many.tolist()


def all_paths(v, word):
    names = {s.decode(): i for i, s in enumerate(v.spelled) if s and len(s.decode(errors="ignore")) and i not in set(v.bytes_id.tolist())}

    def walk(at):
        if at == len(word):
            yield (), 0.0
        for n in range(1, v.longest + 1):
            if (i := names.get(word[at : at + n])) is not None and at + n <= len(word):
                for rest, w in walk(at + n):
                    yield (i, *rest), w + v.weight[i]

    return dict(walk(0))


def test_samples_follow_the_lattice(v):
    paths = all_paths(v, " there")
    total = sum(map(math.exp, paths.values()))
    n = 20000
    drawn = Counter(map(tuple, (x.tolist() for x in pieces.sample_segmentations(["there"] * n, list(range(n)), v))))
    assert set(drawn) <= set(paths)
    for p, w in paths.items():
        share = math.exp(w) / total
        assert abs(drawn[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3
    lattice = pieces.Lattice(v, [" there", " a"])
    assert lattice.alpha[lattice.layer[6]] == pytest.approx(math.log(total), abs=1e-4)


def test_long_words_follow_the_lattice(v):
    rng = np.random.default_rng(6)
    for word in (" there", " " + "".join(rng.choice(list("abcdeé日▁😀\n "), 400)), "   " + "ab" * 300):
        lattice, long = pieces.Lattice(v, [word]), pieces.LongWord(v, word)
        alpha = [math.log(s) - lift * math.log(pieces._LIFT) for s, lift in zip(long.sums.tolist(), long.lifts.tolist())]
        assert np.allclose(alpha, [lattice.alpha[lattice.layer[i]] for i in range(len(word) + 1)], atol=1e-3, rtol=1e-5)
    seeds = rng.integers(0, 2**63, 300).astype(np.uint64)
    lattice, long = pieces.Lattice(v, [" thereafter"]), pieces.LongWord(v, " thereafter")
    end, count, piece = lattice.sample(np.zeros(300, np.int64), seeds)
    same = [long.sample(int(s)).tolist() == piece[e - n : e].tolist() for s, e, n in zip(seeds.tolist(), end.tolist(), count.tolist())]
    assert np.mean(same) > 0.99


def test_parts_change_nothing(v, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcde "), n)) for n in rng.integers(0, 12, 400)]
    texts = [" ".join(words), "", "x" * 5000 + " " + " ".join(words[:50]) + " " + "日本" * 3000, " ".join(words[::-1])]
    want = [x.tolist() for x in pieces.sample_segmentations(texts, [1, 2, 3, 4], v)]
    monkeypatch.setattr(pieces, "BATCH_CHARS", 100)
    assert [x.tolist() for x in pieces.sample_segmentations(texts, [1, 2, 3, 4], v)] == want
    assert [pieces.decode(x, v) for x in want] == texts


def test_long_texts_without_spaces(v):
    text = "".join(map(chr, np.random.default_rng(1).integers(33, 127, 300_000)))
    began = time.process_time()
    assert pieces.decode(pieces.sample_segmentations([text], [1], v)[0], v) == text
    assert time.process_time() - began < 20


def test_rows(spark, v):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 20000 + " y" * 20000), (None, "q")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string")
    got = pieces.decode_rows(pieces.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert [r.ids for r in got if r.doc_id == 1] == [None] and [r.ids for r in got if r.doc_id == 2] == [[]]
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert pieces.decode_rows(pieces.encode(df.limit(0))).count() == 0


def test_op10_query(spark, sf):
    got = queries.QUERIES["op10_piece_sampling"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.lossless for r in got)
    assert all(r.n_pieces == len(r.ids) for r in got)
    assert len(np.unique([r.ids_crc32 for r in got])) > 100

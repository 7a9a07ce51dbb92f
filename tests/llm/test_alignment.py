"""Alignment against both libraries on whole texts and a plain walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import alignment

ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \nb", "a\n\n  b \t c", "\x1c a\x1f b", "can't  won't", "x ▁ y", "▁", "tab\tend ", "日本語 テキスト だ", "é   z", "<|endoftext|> <s> </s> <unk>",
    "\x00 nul", "🙂 🙂🏽 ok", "1234567 8,90", "a" * 3000, "word " * 500 + "end", "\r\n a", "　 b c", "same text", "same text",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.model_path())


def plainly(libraries, texts):
    """Rows of the contract, token by token."""
    a, b = libraries
    letters = alignment.byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}
    groups = []
    for text in texts:
        groups.append([])
        if not text:
            continue
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            continue
        ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        x = y = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            nx, ny = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups[-1].append((ids_a[x:nx], ids_b[y:ny], end))
            x, y = nx, ny
    count = Counter((g[0][-1], g[1][-1]) for gs in groups for g in gs)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for k, gs in enumerate(groups):
        links = [(g[0][-1], g[1][-1]) for g in gs]
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in gs)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if gs else ""
        out.append((k, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out, groups


def test_against_whole_texts(spark, libraries):
    rng = random.Random(5)
    letters = ["a", "b ", " ", "\n", "the ", "  ", "é", "日", "\t", "'s ", "1", ".", " ", "▁", "\x1d", "🙂"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("pairs", F.lit(1))
    want, groups = plainly(libraries, texts)
    assert sorted(map(tuple, alignment.align(df).collect())) == want
    got = {r.doc_id: [(x.a, x.b, x.end) for x in r.groups] for r in alignment.token_groups(df).collect()}
    assert [got[k] for k in range(len(texts))] == groups
    assert sum(bool(g) for g in groups) > 150


def test_whole_documents(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, _ = plainly(libraries, [t for _, t in rows])
    got = sorted(map(tuple, alignment.align(docs).collect()))
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == [i for i, _ in rows]


def test_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df).collect() == [] and alignment.token_groups(df).collect() == []
    df = spark.createDataFrame([(None, "one two"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_links) for r in alignment.align(df).collect()) == [(True, 0), (True, 2)]


def test_small_bundles_give_the_same(spark, libraries):
    by = alignment.Aligner(alignment.tokenizer_path(), alignment.model_path())
    texts = [f"word{k % 7} other {k}" for k in range(50)]
    together = by(texts)
    alone = [by([t]) for t in texts]
    assert together["facts"].tolist() == [f for x in alone for f in x["facts"].tolist()]
    assert together["digests"] == [x["digests"][0] for x in alone]
    by.forget()
    again = by(texts)
    assert (again["pairs"] == together["pairs"]).all() and (again["links"] == together["links"]).all()


def test_intervals():
    first, last, boundary = alignment.aligned(np.array([2, 5, 6, 9]), np.array([1, 5, 7, 9]))
    assert first.tolist() == [0, 1, 2, 2] and last.tolist() == [1, 1, 2, 3] and boundary.tolist() == [False, True, False, True]

"""Block naming against plain grouping of whole texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyforge.llm import blocknames


def plainly(rows):
    groups = {}
    for place, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, place))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            alike = m[:3] == first[:3]
            out.append((None if m[1] else m[2], None if first[1] else first[2], len(members), alike, hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("name", F.lit("clash")).withColumn("row", F.lit(1))
    got = [tuple(r) for r in blocknames.duplicates(df, **more).collect()]
    want = plainly(rows)
    assert sorted((g[:3] + g[4:] for g in got), key=str) == sorted((w[:3] + w[4:] for w in want), key=str)
    assert sum(g[3] for g in got) == len({w[4] for w in want})  # one row of each group stays, one of those that may
    assert {(g[0], g[4]) for g in got if g[3]} <= {(w[0], w[4]) for w in want if w[3]}


def test_odd_rows(spark):
    rows = [
        (5, "a b"), (3, "ab"), (4, "a  b"), (9, " a\tb\r\n\v\f"), (1, None), (2, ""), (6, " \n"), (7, "a b"), (8, "a  b"), (None, "ab"), (None, "a       b"), (10, "\x00"), (11, "\x00\x00"), (12, "é"), (13, "é"),
        (3, "ab"), (3, "a b c"), (14, "x" * 100_000), (15, "x" * 100_001), (16, "x " * 100_000),
    ]
    check(spark, rows)
    check(spark, rows, block=64)


def test_small_blocks_through_all_levels(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices("ab ", k=rng.randint(0, 14)))) for k in range(500)]
    for block in (1, 2, 3):
        check(spark, rows, block=block)


def test_keys_that_collide_are_taken_anew(spark):
    tried = []

    def weak(block, seed):
        tried.append(seed)
        a, b = blocknames.seeded(block, seed)
        return (F.pmod(a, F.lit(3)), F.lit(0)) if seed < 2 else (a, b)

    rng = random.Random(2)
    check(spark, [(k, "".join(rng.choices("abc", k=rng.randint(0, 9)))) for k in range(200)], block=4, key=weak)
    assert max(tried) == 2


def test_names_do_not_depend_on_partitions(spark, tmp_path):
    keys = spark.createDataFrame([(x % 7, -x) for x in range(100)], "a long, b long")
    got = [sorted(map(tuple, blocknames.named(keys.repartition(n), f"file://{tmp_path}/{n}", 10).collect())) for n in (1, 5)]
    assert got[0] == got[1] == [(a, b, 10 + k) for k, (a, b) in enumerate(sorted((x % 7, -x) for x in range(100)))]


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert blocknames.duplicates(df).collect() == []
    one = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b")], "doc_id long, text string")
    out = blocknames.duplicates(one)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    assert sorted(r.doc_id for r in blocknames.keep_one(one).collect()) == [2, 3]

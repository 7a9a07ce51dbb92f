"""Token ratios against plain loops."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import match


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for k, d in enumerate(y, 1):
            last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
    return row[-1]


def ratio(x, y):
    return 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0


def by_set(x, y):
    s, t = set(x.split()), set(y.split())
    if not s or not t:
        return 0.0
    both, one, two = (" ".join(sorted(w)) for w in (s & t, s - t, t - s))
    if both and (not one or not two):
        return 1.0
    first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
    distance = len(one) + len(two) - 2 * lcs(one, two)
    best = 1 - distance / (len(first) + len(second))
    return max(best, *(1 - (len(w) - len(both)) / (len(w) + len(both)) for w in (first, second))) if both else best


def test_ratios(spark):
    rng = random.Random(4)
    words = ["maize", "maizes", "dry", "red", "beans", "flour", "x", "é", "white", "a" * 40]
    texts = ["", " ", "maize flour", "x" * 70, "🙂 b"] + [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 12)] + [("y" * 600, "y" * 300 + "z"), ("ab" * 40, "ba" * 50)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", match.indel_ratio(a, b).alias("r"), match.token_sort_ratio(a, b).alias("s"), match.token_set_ratio(a, b).alias("t"), match.fuzzy_score(a, b).alias("f")).collect()
    assert len(got) == len(pairs)
    for r in got:
        r0, s0, t0 = ratio(r.a, r.b), ratio(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split()))), by_set(r.a, r.b)
        f0 = 0.0 if not r.a or not r.b else max(r0, s0, 0.95 * t0 if " " in r.a and " " in r.b else 0.0)
        assert all(abs(x - y) < 1e-9 for x, y in zip((r.r, r.s, r.t, r.f), (r0, s0, t0, f0), strict=True)), (tuple(r), r0, s0, t0, f0)

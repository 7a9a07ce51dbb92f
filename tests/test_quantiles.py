"""Quantiles of groups of any size against percentile."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import quantiles


def test_against_percentile(spark):
    rng = random.Random(2)
    rows = [("big", rng.lognormvariate(0, 6)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(900)] + [("flat", 7.0)] * 700 + [(None, rng.uniform(-1e308, 1e308)) for _ in range(800)]
    rows += [("tiny", rng.uniform(1, 1 + 1e-13)) for _ in range(600)] + [("small", rng.random()) for _ in range(20)] + [("one", 3.0), ("gap", None), ("nan", float("nan")), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    plain = df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    want = {r.g: (r.n, list(r.q)) for r in plain.collect()}
    for limit, few in ((100, 10), (100, 1), (10**6, 10)):
        got = {r.g: (r.n, list(r.q)) for r in quantiles.group_quantiles(df, ["g"], F.col("v"), shares, limit=limit, sorted_rows=few, bins=16).collect()}
        assert got == want
    assert quantiles.whole_quantiles(df.where("g = 'big'"), F.col("v"), limit=50, sorted_rows=5, bins=8)[0] == want["big"][1][2]
    assert quantiles.whole_quantiles(df.limit(0), F.col("v")) == [None]

"""Injected errors without copies of the table: the same shares as of copies, and rows written once."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, quantiles
from tallyforge.plans.views import records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Records of few markets and months, so that sets have several rows, with doubled rows, rows without a date, market or commodity, and other channels."""
    rec = records(spark, SF).withColumn("market", F.concat(F.lit("m"), F.col("k") % 3)).withColumn("date", F.trunc("date", "year")).withColumn("commodity", F.element_at(F.split("commodity", " "), 1))
    again = rec.where("k % 50 = 0")
    other = lambda c, to, by: F.when(F.col("k") % by == 1, F.lit(to)).otherwise(F.col(c)).alias(c)
    rec = rec.select(*(c for c in rec.columns if c not in ("date", "market", "commodity", "channel", "province", "price")), F.when(F.col("k") % 31 != 1, F.col("date")).alias("date"), other("market", "", 37), other("commodity", None, 41), other("channel", "export", 43), "province", F.when(F.col("k") % 47 == 1, 0.0).otherwise(F.col("price")).alias("price"))
    return rec.unionByName(rec.join(again.select("id"), "id", "left_semi")).localCheckpoint()


def _told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _of_copies(df, copies, one_in, model=None):
    rows = evaluate.rounds(df, copies, one_in).localCheckpoint()
    return evaluate.layer_recall(rows, evaluate.flags(rows, model).localCheckpoint())


def test_layers_as_of_copies(spark, odd):
    for df, copies, one_in in ((odd, 3, 4), (records(spark, SF), 2, 5)):
        want = _told(_of_copies(df, copies, one_in).where("layer <> 'forest'"))
        assert len(want) > 10 and _told(evaluate.layered(df, copies, one_in, with_forest=False)) == want


def test_no_copy_is_written(spark, monkeypatch):
    rows, plain = [], evaluate.written

    def counting(df):
        out = plain(df)
        rows.append(out.count())
        return out

    for module in (evaluate, evaluate.anomaly, evaluate.features, quantiles):
        monkeypatch.setattr(module, "written", counting)
    evaluate.layered(records(spark, SF), with_forest=False).collect()
    assert max(rows) < 2 * 6000  # records; eight copies have 48,000 rows, bins and figures of the peers of eight rounds fewer


def test_flowing_quantiles(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.exp(F.rand(5) * 20) - F.when(F.col("id") % 7 == 0, 5.0).otherwise(0.0)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(7, 2.0)] * 5 + [(8, 1.0), (9, 0.0), (9, 1e9)], "g long, v double")).localCheckpoint()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), (F.min("v") - 1).alias("lo"), (F.max("v") + 1).alias("hi"))
    shares = (0.0, 0.25, 0.5, 0.975)
    got = {r.g: (r.n, r.q) for r in quantiles.flowing_quantiles(rows, sizes, ["g"], shares).collect()}
    want = {r.g: (r.n, r.q) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want


def test_forest_as_of_copies(spark, odd):
    df = odd.where("k % 3 < 2")
    model = evaluate.forest.train(evaluate.features.price_features(df).localCheckpoint())
    want = _told(_of_copies(df, 2, 4, model))
    assert len(want) > 14 and _told(evaluate.layered(df, 2, 4)) == want

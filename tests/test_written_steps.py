"""Steps that once shuffled or read all rows where a few or none had to be."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, draft, forest, review
from tallyforge.plans.views import raw_records, records
from tallyforge.sources.files import written

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_suppliers_and_peers_are_sent_to_rows(spark):
    rec = records(spark, SF)
    assert "SortMergeJoin" not in _plan(rec)
    found = anomaly.price_outliers(written(rec))
    assert "SortMergeJoin" not in _plan(found) and "percentile" not in _plan(found)


def test_lineage_does_not_multiply_records(spark):
    rec = spark.createDataFrame([("a", 2.0, "M")], "id string, price double, market string")
    made = spark.createDataFrame([("a", 1, "corrected", "price", "5"), ("a", 2, "corrected", "market", "N"), ("a", 3, "corrected", "price", "7")], "id string, at int, status string, field string, suggestion string")
    _, lineage = review.resolved(rec, made)
    assert "Generate" not in _plan(lineage)
    assert sorted(map(tuple, lineage.select("field", "before", "after").collect())) == [("market", "M", "N"), ("price", "2.0", "5"), ("price", "5", "7")]


def test_cells_are_read_once_in_a_check(spark):
    made, found = draft.plain_check(raw_records(spark, SF))
    assert "regexp" not in _plan(made) and "regexp" not in _plan(found)


def test_rows_go_down_trees_as_one_by_one():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, len(forest.NAMES)))
    made = forest.fit(x, 10, 64)

    def depth(row, tree):
        feature, split, right, leaf = tree
        k = 0
        while feature[k] >= 0:
            k = right[k] if row[feature[k]] >= split[k] else k + 1
        return leaf[k]

    plain = [2.0 ** (-sum(depth(row, t) for t in made.trees) / len(made.trees) / forest.path_norm(made.sample)) for row in x[4000:4300]]
    assert np.array_equal(made.scores(x)[4000:4300], plain)


def test_scores_of_the_threshold_are_kept(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), *(F.rand(k).alias(n) for k, n in enumerate(forest.NAMES)))
    _, scored = forest.fitted(written(rows), 5, 16)
    assert "ArrowEvalPython" not in _plan(scored) and scored.count() == 300

"""What each row costs: methods that the JVM compiles, patterns by table, one join for each kind of name."""

import re

from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.functions.text import normalized, squeezed
from tallyforge.operators import anomaly, draft, features, forest, sieve, standardize
from tallyforge.plans.views import commodities, markets, raw_records, records
from tallyforge.sources.files import written

SF = "/root/testdata/sf0.001"


def test_raw_rows_are_spelled_in_methods_that_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = raw_records(spark, SF)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # HotSpot leaves longer ones to its interpreter


def test_folding_looks_letters_up_in_a_table(spark):
    odd = ["Hot  Bolt", "Supplier#000000001", "d'Or - x", "", "é ﬁ Ⅷ", "a_b", "--", "1,200 RWF", "n/a", "-12.50", "1-2"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for made, plain in ((normalized(F.col("x")), "[^a-z0-9']+"), (squeezed(F.col("x")), "[^a-z0-9]+")):
        assert "a-z" not in df.select(made)._jdf.queryExecution().analyzed().toString()
        ascii_only = df.where(F.length("x") == F.octet_length("x"))
        assert ascii_only.where(made != F.trim(F.regexp_replace(F.lower("x"), plain, " "))).isEmpty()
    assert [r[0] for r in df.select(parse.price(F.col("x"))).collect()] == [None, 1.0, None, None, None, None, None, 1200.0, None, -12.5, None]


def test_rows_are_joined_once_with_each_kind_of_name(spark):
    found = standardize.resolved(standardize.typed(raw_records(spark, SF)), commodities(spark, SF), markets(spark, SF))
    assert len(re.findall(r"\w*Join ", found._jdf.queryExecution().sparkPlan().toString())) == 2


def test_rows_that_meet_no_key_are_not_shuffled(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), F.col("id") % 40_000)).alias("key"), "id")
    keys = spark.range(0, 60_000, 50).select(F.concat(F.lit("k"), F.col("id")).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    told = sieve.told(rows, "key", sieve.marks(keys, "key"))
    assert told.where("__may").count() < 1.1 * rows.join(keys, "key", "left_semi").count() + 100
    for made, how in ((sieve.among, "left_semi"), (sieve.without, "left_anti")):
        got, want = made(rows, keys, "key"), rows.join(keys, "key", how)
        assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    none = keys.where("key = 'x'")
    assert sieve.without(rows, none, "key").count() == 50_000 and sieve.among(rows, none, "key").isEmpty()


def test_scores_are_written_without_features(spark):
    made = features.price_features(written(records(spark, SF)))
    _, scored = forest.fitted(written(made.limit(300)), 3, 16)
    assert not set(features.NAMES) & set(scored.columns) and {"id", "score", "signal", "peers", "median"} <= set(scored.columns)


def test_sets_of_one_row_are_counted_not_kept(spark):
    rows = [("2024-01-01", "m", "c", "retail", 2.0), ("2024-01-01", "m", "c", "farmgate", 1.0), (None, "m", "c", "retail", 3.0), ("2024-02-01", "n", "c", "retail", 3.0), ("2024-02-01", "", "c", "retail", 3.0), ("2024-02-01", "o", "c", "retail", 0.0)]
    df = spark.createDataFrame([(k, f"r{k}", *r) for k, r in enumerate(rows)], "seq long, id string, date string, market string, commodity string, channel string, price double")
    again, alone = anomaly.met_again(df)
    assert sorted(r.id for r in again.collect()) == ["r0", "r1"] and alone == 2 == anomaly.ladder(df).count() - 1


def test_untouched_rows_of_a_draft_stay_where_they_are(spark):
    raw = written(raw_records(spark, SF))
    first = draft.start(raw, draft.plain_check)
    edits = raw.where("k % 40 = 7").select("id", F.lit("raw_price").alias("field"), F.lit("1").alias("value"), F.lit(1).alias("at"), F.lit("manual").alias("via"))
    after = draft.apply(first, draft.plain_check, edits, raw.where("k % 101 = 0").select("id", F.lit(2).alias("at")))
    for df in (after.rows, after.records, after.issues):
        assert "__may" in df._jdf.queryExecution().analyzed().toString()
    gone = raw.where("k % 101 = 0").count()
    assert after.rows.count() == after.records.count() == raw.count() - gone

"""Profiles, coverage, quality score and counts of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a column: kind, missing, distinct, and range and mean of numbers, from one long pass."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for c in names))))
    long = long.withColumn("x", F.col("v").try_cast("double"))
    agg = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("v") == "").alias("missing"), F.countDistinct(F.nullif("v", F.lit(""))).alias("distinct"),
        F.count("x").alias("numbers"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"),
    )
    numeric = F.col("numbers") > 0.9 * (F.col("rows") - F.col("missing"))
    kind = F.when(numeric & (F.col("numbers") > 0), "numeric").when(F.lower("column").contains("date"), "date").otherwise("categorical")
    out = agg.withColumn("type", kind)
    only = lambda c: F.when(F.col("type") == "numeric", r4(F.col(c)))
    return out.select("column", "type", "missing", "distinct", only("lo").alias("min"), only("hi").alias("max"), only("mean").alias("mean"))


def dataset(df: DataFrame) -> DataFrame:
    """One row: sizes, distinct names, date range, rows that repeat an earlier key (case matters)."""
    key = F.concat_ws("|", F.col("date").cast("string"), "market", "commodity", "channel")
    channels = [F.count_if(F.col("channel") == c).alias(c) for c in ("farmgate", "wholesale", "retail")]
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct("commodity").alias("commodities"), F.countDistinct("market").alias("markets"), F.countDistinct("province").alias("provinces"),
        F.countDistinct("district").alias("districts"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days"),
        (F.count("*") - F.countDistinct(key)).alias("duplicate_rows"), *channels,
    )


def coverage(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Province: registered markets, those that report priced rows, observations, share."""
    seen = df.where("price IS NOT NULL").groupBy("market").agg(F.count("*").alias("n"))
    by = registry.join(seen, "market", "left").groupBy("province").agg(F.count("*").alias("markets"), F.count("n").alias("reporting"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"))
    return by.withColumn("share", r4(F.col("reporting") / F.col("markets")))


def _clamped(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def quality(rows: DataFrame, issues: DataFrame, cells: list[str]) -> DataFrame:
    """Five dimensions and their weighted total; only open findings lower it."""
    gaps = rows.agg(F.count("*").alias("n"), sum(F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "") for c in cells).alias("gaps"))
    of = lambda *types: F.count_if(F.col("type").isin(*types) & (F.col("status") == "open"))
    found = issues.agg(
        of("MISSING_VALUE").alias("missing"), of("LADDER_VIOLATION", "UNIT_INCONSISTENCY", "INVALID_DATE").alias("inconsistent"),
        of("EXACT_DUPLICATE", "PROBABLE_DUPLICATE", "POSSIBLE_DUPLICATE").alias("repeated"), of("INVALID_PRICE", "PRICE_ANOMALY", "UNKNOWN_ENTITY").alias("invalid"),
        of("ENTITY_MATCH").alias("match_open"), F.count_if((F.col("type") == "ENTITY_MATCH") & (F.col("status") != "open")).alias("match_done"),
    )
    n = F.greatest(F.col("n"), F.lit(1))
    both = gaps.crossJoin(found)
    both = both.select(
        _clamped(1 - F.col("gaps") / (n * max(1, len(cells))) - F.col("missing") / n / 4).alias("completeness"), _clamped(1 - F.col("inconsistent") / n).alias("consistency"),
        _clamped(1 - F.col("repeated") / n).alias("uniqueness"), _clamped(1 - 1.2 * F.col("invalid") / n).alias("validity"),
        F.when(F.col("match_open") + F.col("match_done") == 0, 0.95).otherwise(_clamped(0.95 - 2 * F.col("match_open") / n + F.col("match_done") / n)).alias("ai_confidence"),
    )
    total = F.floor(30 * F.col("completeness") + 20 * F.col("consistency") + 20 * F.col("uniqueness") + 20 * F.col("validity") + 10 * F.col("ai_confidence") + 0.5)
    return both.select(*(r4(F.col(c)).alias(c) for c in both.columns), total.cast("long").alias("total"))


def issue_counts(issues: DataFrame) -> DataFrame:
    opened = F.col("status") == "open"
    return issues.agg(
        F.count("*").alias("total"), F.count_if(opened).alias("open"), F.count_if(~opened).alias("resolved"), *(F.count_if(opened & (F.col("severity") == s)).alias(s) for s in ("critical", "high", "medium", "low")),
        *(F.count_if(opened & (F.col("category") == c)).alias(c) for c in ("duplicate", "anomaly", "conflict")),
    )

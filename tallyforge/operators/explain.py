"""What is told about findings and rows: phrases, bands, counters and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE = 0.9


def usual_price(price: Column, median: Column) -> Column:
    """How a price stands to the usual one."""
    ratio = price / median
    per_cent = lambda x: F.floor(x * 100 + 0.5).cast("long").cast("string")
    times = (F.floor(ratio * 10 + 0.5) / 10).cast("string")
    return (
        F.when(ratio >= 2, F.concat(times, F.lit(" times the usual price"))).when(ratio > 1, F.concat(per_cent(ratio - 1), F.lit(" % over the usual price")))
        .when(ratio <= 0.5, F.concat(F.lit("no more than "), per_cent(ratio), F.lit(" % of the usual price"))).otherwise(F.concat(per_cent(1 - ratio), F.lit(" % under the usual price")))
    )


def likely_cause(price: Column, median: Column) -> Column:
    """extra_zero or missing_zero from seven times on, else rise or drop."""
    ratio = price / median
    return F.when(ratio >= 7, "extra_zero").when(ratio <= 1 / 7, "missing_zero").when(ratio > 1, "rise").otherwise("drop")


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("needs attention")


def edit_flags(original: Column, value: Column) -> tuple[Column, Column]:
    """Whether a value differs from the upload in letters or digits (cleaned), or in its form alone (reformatted)."""
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    cleaned = (original != "") & (value != "") & (bare(original) != bare(value))
    return cleaned, ~cleaned & (original != "") & (F.trim(original) != value)


def readiness(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: rows, those with a grave open finding, per cent that are ready, open findings sure enough to confirm at once."""
    grave = issues.where("status = 'open' AND severity IN ('critical', 'high')").select(F.col("record_id").alias("id")).distinct()
    errors = rows.select("id").join(grave, "id", "left_semi").agg(F.count("*").alias("errors"))
    sure = issues.where((F.col("status") == "open") & (F.col("confidence") >= SURE)).agg(F.count("*").alias("sure"))
    out = rows.agg(F.count("*").alias("rows")).crossJoin(errors).crossJoin(sure)
    ready = F.when(F.col("rows") > 0, F.floor((F.col("rows") - F.col("errors")) / F.col("rows") * 100 + 0.5)).otherwise(0)
    return out.select("rows", "errors", ready.cast("long").alias("ready"), "sure")


def attention(rows: DataFrame, states: DataFrame, show: str = "attention", search: str = "") -> DataFrame:
    """Rows by state (all, attention: whatever isn't valid, or one state), and by a text in names or date; a row without
    findings is valid."""
    out = rows.join(states.select(F.col("record_id").alias("id"), "state"), "id", "left").withColumn("state", F.coalesce("state", F.lit("valid")))
    if show != "all":
        out = out.where(F.col("state") != "valid" if show == "attention" else F.col("state") == show)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "market", "commodity", F.col("date").cast("string"))), F.lit(search.strip().lower()))) if search.strip() else out


def replaced(mine: DataFrame, theirs: DataFrame, owned: tuple[str, ...]) -> DataFrame:
    """Findings of two engines: the other one's, and of these those of types it doesn't own."""
    return mine.where(~F.col("type").isin(*owned)).unionByName(theirs)

"""Robust price outliers within peers, and rules across channels of a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4
from ..sources.files import written
from .sieve import among

PEERS = ["commodity", "channel"]
SET = ["date", "market", "commodity"]
LEAST_PEERS, Z_LIMIT, MARKUP_LIMIT = 5, 3.5, 3.0


def priced(df: DataFrame) -> DataFrame:
    """Rows with a positive price, a commodity and a channel."""
    return df.where("price > 0 AND coalesce(commodity, '') <> '' AND coalesce(channel, '') <> ''")


def robust_stats(df: DataFrame) -> DataFrame:
    """n, median, MAD, quartiles and fences of each peer group with enough rows. They are written, so that few groups are sent to
    the rows and no row is shuffled to its group; rows are read three times."""
    rows = priced(df)
    q = F.percentile("price", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    first = rows.groupBy(*PEERS).agg(F.count("*").alias("n"), q.alias("q")).where(F.col("n") >= LEAST_PEERS)
    first = first.select(*PEERS, "n", *(F.col("q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3"))))
    first = written(first)
    spread = rows.join(first.select(*PEERS, "median"), PEERS).groupBy(*PEERS).agg(F.percentile(F.abs(F.col("price") - F.col("median")), 0.5).alias("mad"))
    out = first.join(spread, PEERS).withColumn("iqr", F.col("q3") - F.col("q1"))
    return written(out.withColumns({"lower": F.col("q1") - 1.5 * F.col("iqr"), "upper": F.col("q3") + 1.5 * F.col("iqr")}))


def robust_z() -> Column:
    """Scaled by the MAD, else by the IQR, else by a twentieth of the median (1 at least)."""
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("iqr") > 0, 0.6745 * F.col("iqr") / 1.349).otherwise(0.6745 * F.greatest(0.05 * F.col("median"), F.lit(1.0)))
    return 0.6745 * (F.col("price") - F.col("median")) / scale


def price_outliers(df: DataFrame) -> DataFrame:
    """Rows beyond the fences or the z limit, with severity, confidence and the median as suggestion."""
    rows = priced(df).join(robust_stats(df), PEERS).withColumn("z", r4(robust_z()))
    outside = (F.col("price") < F.col("lower")) | (F.col("price") > F.col("upper"))
    z = F.abs("z")
    rows = rows.where((z >= Z_LIMIT) | outside)
    severity = F.when(z > 8, "critical").when(z > 5, "high").otherwise("medium")
    confidence = F.least(F.lit(0.99), 0.6 + F.least(z, F.lit(12.0)) / 20 + F.when(outside, 0.08).otherwise(0.0))
    return rows.select("id", "commodity", "channel", r4(F.col("price")).alias("price"), "z", severity.alias("severity"), r4(confidence).alias("confidence"), F.floor(F.col("median") + 0.5).cast("long").alias("suggestion"))


def ladder(df: DataFrame) -> DataFrame:
    """One row a set: the last price (and its record) of each channel."""
    rows = priced(df).where("coalesce(market, '') <> ''")
    channels = ("farmgate", "wholesale", "retail")
    last = rows.groupBy(*SET).agg(*(F.max(F.when(F.col("channel") == c, F.struct("seq", "id", "price"))).alias(f"last_{c}") for c in channels))
    return last.select(*SET, *(F.col(f"last_{c}.{what}").alias(name) for c in channels for what, name in (("price", c), ("id", f"{c}_id"))))


def met_again(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows for ladders whose set has several of them, and maybe a few others, and the number of sets that are left out: of these each has a single row."""
    rows = priced(df).where("coalesce(market, '') <> ''").withColumn("hash", F.xxhash64(*SET))
    sizes = rows.groupBy("hash").agg(F.count("*").alias("n")).select("hash", "n")
    few = written(sizes.where("n > 1").select("hash"))
    every = rows.count()
    rows = among(rows, few, "hash")
    return rows.drop("hash"), every - rows.count()


def several(df: DataFrame) -> DataFrame:
    """Rows of sets that have prices of several channels, and maybe a few others: only these have a ladder. Hashes of sets are counted first, which are
    far shorter than what a ladder holds of each row."""
    rows = priced(df).where("coalesce(market, '') <> ''").withColumn("hash", F.xxhash64(*SET))
    bit = F.when(F.col("channel") == "farmgate", 1).when(F.col("channel") == "wholesale", 2).when(F.col("channel") == "retail", 4).otherwise(0)
    sets = rows.groupBy("hash").agg(F.bit_or(bit).alias("channels")).where(F.bit_count("channels") > 1)
    return among(rows, written(sets.select("hash")), "hash").drop("hash")


def ladder_violations(df: DataFrame) -> DataFrame:
    """Sets in which a lower channel is dearer than a higher one; the record of the higher channel is blamed. ``df`` is read twice."""
    pairs = [("farmgate", "wholesale"), ("wholesale", "retail"), ("farmgate", "retail")]
    checks = F.array(*(F.struct(F.lit(f"{a}>{b}").alias("check"), F.col(a).alias("low"), F.col(b).alias("high"), F.col(f"{b}_id").alias("record_id")) for a, b in pairs))
    rows = ladder(several(df)).select(*SET, F.inline(checks)).where("low > high")
    gap = (F.col("low") - F.col("high")) / F.col("high") * 100
    severity = F.when(F.col("check") == "farmgate>retail", "critical").when(gap > 30, "high").otherwise("medium")
    return rows.select(*SET, "check", "record_id", r4(gap).alias("gap"), severity.alias("severity"), r4(F.least(F.lit(0.99), 0.75 + gap / 200)).alias("confidence"))


def markups(df: DataFrame) -> DataFrame:
    """Sets whose retail price is over three times the farm-gate price."""
    ratio = F.col("retail") / F.col("farmgate")
    return ladder(several(df)).where(ratio > MARKUP_LIMIT).select(*SET, F.col("retail_id").alias("record_id"), r4(ratio).alias("ratio"), r4(F.least(F.lit(0.99), 0.7 + (ratio - 3) / 10)).alias("confidence"))

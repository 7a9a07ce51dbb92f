"""Trusted data and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import r4
from ..sources.files import written
from .quantiles import joined, group_quantiles, median_of, whole_quantiles
from .sieve import without

LADDER = ("farmgate", "wholesale", "retail")


def trusted(df: DataFrame, issues: DataFrame, *, at_once: bool = False) -> DataFrame:
    """Priced records without an open critical or high finding, or one of a duplicate that was settled as corrected.

    ``at_once`` works the findings out and writes the ids that are blocked; then only rows that may be among them are shuffled."""
    grave = (F.col("status") == "open") & F.col("severity").isin("critical", "high")
    settled = (F.col("status") == "corrected") & (F.col("category") == "duplicate")
    blocked = issues.where(grave | settled).select(F.col("record_id").alias("id"))
    if at_once:
        return without(df.where("price IS NOT NULL"), written(blocked), "id")
    return df.where("price IS NOT NULL").join(blocked, "id", "left_anti")


def trend(df: DataFrame) -> DataFrame:
    """Date: median price of each channel, and markets that report."""
    medians = median_of(df.where(F.col("channel").isin(*LADDER)), ["date", "channel"], F.col("price"), "median")
    by = medians.groupBy("date").agg(*(r4(F.max(F.when(F.col("channel") == c, F.col("median")))).alias(c) for c in LADDER))
    return joined(df.groupBy("date").agg(F.countDistinct("market").alias("markets")), by, ["date"], "left").select("date", *LADDER, "markets")


def channel_ladder(df: DataFrame) -> DataFrame:
    """Commodity and channel: median, rise over the channel below in per cent, and whether it falls instead."""
    by = df.groupBy("commodity", "channel").agg(F.count("*").alias("n"), F.percentile("price", 0.5).alias("median"))
    step = F.when(F.col("channel") == "farmgate", 0).when(F.col("channel") == "wholesale", 1).otherwise(2)
    before = F.lag("median").over(Window.partitionBy("commodity").orderBy(step))
    return by.withColumn("before", before).select("commodity", "channel", "n", r4(F.col("median")).alias("median"), F.floor((F.col("median") - F.col("before")) / F.col("before") * 100 + 0.5).cast("long").alias("markup"), F.coalesce(F.col("median") < F.col("before"), F.lit(False)).alias("inverted"))


def margins(df: DataFrame) -> DataFrame:
    """Commodity: median farm-gate and retail price and the margin between them; both must be there."""
    median = lambda c: F.percentile(F.when(F.col("channel") == c, F.col("price")), 0.5).alias(c)
    by = df.groupBy("commodity").agg(median("farmgate"), median("retail")).where("farmgate IS NOT NULL AND retail IS NOT NULL")
    return by.select("commodity", r4(F.col("farmgate")).alias("farmgate"), r4(F.col("retail")).alias("retail"), F.floor((F.col("retail") - F.col("farmgate")) / F.col("farmgate") * 100 + 0.5).cast("long").alias("margin"))


def price_map(df: DataFrame) -> DataFrame:
    """Provinces and their markets: median, rows and commodities."""
    levels = []
    for keys in (["province"], ["province", "market"]):
        counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("commodity").alias("commodities"))
        level = joined(counts, median_of(df, keys, F.col("price"), "median"), keys, "left")
        market = F.col("market") if "market" in keys else F.lit(None).cast("string")
        levels.append(level.select("province", market.alias("market"), r4(F.col("median")).alias("median"), "n", "commodities"))
    return levels[0].unionByName(levels[1])


def channel_mix(df: DataFrame) -> DataFrame:
    by = df.groupBy("channel").agg(F.count("*").alias("n"))
    return by.withColumn("share", r4(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1)))))


def predicates(filters: dict) -> dict:
    """Named conditions of the explorer; a missing filter has none."""
    out = {}
    if filters.get("search"):
        out["search"] = F.contains(F.lower(F.concat_ws(" ", "commodity", "market", "district", "province")), F.lit(filters["search"].lower()))
    for name in ("province", "district", "market", "commodity", "channel", "unit"):
        if filters.get(name):
            out[name] = F.col(name) == filters[name]
    if filters.get("since"):
        out["since"] = F.col("date") >= F.lit(filters["since"]).cast("date")
    if filters.get("until"):
        out["until"] = F.col("date") <= F.lit(filters["until"]).cast("date")
    if filters.get("least") is not None:
        out["least"] = F.col("price") >= filters["least"]
    if filters.get("most") is not None:
        out["most"] = F.col("price") <= filters["most"]
    return out


def matching(df: DataFrame, filters: dict, skip: tuple[str, ...] = ()) -> DataFrame:
    for name, condition in predicates(filters).items():
        if name not in skip:
            df = df.where(condition)
    return df


def facets(df: DataFrame, filters: dict, dims: tuple[str, ...] = ("province", "channel", "commodity")) -> DataFrame:
    """Counts of each value of a dimension under all filters but its own."""
    out = None
    for d in dims:
        part = matching(df, filters, (d,)).groupBy(F.col(d).alias("value")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "value", "n")
        out = part if out is None else out.union(part)
    return out


def pivoted(df: DataFrame) -> DataFrame:
    """One row a set with a cell for each channel: the first value, unless a corrected one follows."""
    order = F.struct(~F.col("corrected"), F.col("seq"), F.col("id"))
    cell = lambda c: r4(F.min_by("price", F.when(F.col("channel") == c, order))).alias(c)
    return df.groupBy("date", "province", "district", "market", "commodity", "unit").agg(*map(cell, LADDER), F.bool_or("corrected").alias("corrected"))


def highlights(df: DataFrame) -> DataFrame:
    """One row: range of province medians, cheapest and dearest market, median of market medians."""
    market = written(median_of(df, ["market"], F.col("price"), "median"))
    province = median_of(df, ["province"], F.col("price"), "median")
    a = province.agg(r4(F.min("median")).alias("least_province"), r4(F.max("median")).alias("most_province"))
    b = market.agg(F.min(F.struct("median", "market")).alias("lo"), F.max(F.struct("median", "market")).alias("hi"), F.lit(whole_quantiles(market, F.col("median"))[0]).alias("middle")).withColumn("middle", r4(F.col("middle")))
    return a.crossJoin(b.select(F.col("lo.market").alias("cheapest"), F.col("hi.market").alias("dearest"), "middle"))


def market_medians(df: DataFrame) -> DataFrame:
    """Market: rounded median of its prices, and how many there are."""
    by = group_quantiles(df.where("price > 0"), ["market"], F.col("price")).select("market", F.col("q")[0].alias("m"), "n")
    return by.select("market", F.floor(F.col("m") + 0.5).cast("long").alias("median"), "n")

"""Exact quantiles of many groups at once, of any size.

Groups of at most ``LIMIT`` rows are left to Spark's own ``percentile``, which holds a group's distinct values in one task. Larger
ones are narrowed down together, each for the rows at the places that it asks for: rows are counted in ``BINS`` bins between
the least and the greatest value that still count, which spreads a group over all tasks, and the bin that holds the place is taken
further, until it holds no more than ``SORTED`` rows or a single value. Those few are sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

LIMIT, BINS, SORTED = 1_000_000, 1024, 10_000


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by keys that may be null, which stay those of ``a``."""
    b = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    out = a.join(b, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), how)
    return out.drop(*(f"__{k}" for k in keys))


def group_quantiles(df: DataFrame, keys: list[str], value: Column, shares: tuple[float, ...] = (0.5,), limit: int = LIMIT, sorted_rows: int = SORTED, bins: int = BINS) -> DataFrame:
    """The keys, n (values of the group) and q, an array of its quantiles, interpolated as ``percentile`` does.

    Nulls and NaN don't count; a group without other values has no row. Null keys are a group."""
    v = value.cast("double")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = F.percentile("v", F.array(*map(F.lit, shares)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = written(sizes.where(F.col("n") > limit))
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), whole.alias("q"))
    rows = written(rows)
    small = joined(rows, large.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"), whole.alias("q"))
    at = [(F.col("n") - 1) * F.lit(p) for p in shares]
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))
    found = written(large.select(*keys, "lo", "hi", F.col("n").alias("rows"), F.lit(0).cast("long").alias("before"), F.explode(places).alias("k")))
    is_open = (F.col("rows") > sorted_rows) & (F.col("lo") < F.col("hi"))
    while not found.where(is_open).isEmpty():
        part = joined(rows, found.where(is_open), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))  # halves don't overflow
        counted = part.groupBy(*keys, "k", "before", place.alias("bin")).agg(F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        until = F.sum("rows").over(Window.partitionBy(*keys, "k").orderBy("bin"))
        ahead = counted.withColumn("before", F.col("before") + until - F.col("rows")).where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("rows")))
        found = written(found.where(~is_open).unionByName(ahead.drop("bin")))
    last = joined(rows, found.where("lo < hi"), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    turn = F.row_number().over(Window.partitionBy(*keys, "k").orderBy("v"))
    picked = last.withColumn("turn", turn).where(F.col("turn") == F.col("k") - F.col("before") + 1).select(*keys, "k", "v")
    picked = picked.unionByName(found.where("lo = hi").select(*keys, "k", F.col("lo").alias("v")))
    each = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))

    return small.unionByName(joined(large, each, keys).select(*keys, "n", F.array(*map(_between, at)).alias("q")))


def whole_quantiles(df: DataFrame, value: Column, shares: tuple[float, ...] = (0.5,), **more: int) -> list[float | None]:
    """Quantiles of all rows; nulls if there are none."""
    row = group_quantiles(df.select(value.cast("double").alias("v"), F.lit(0).alias("all")), ["all"], F.col("v"), shares, **more).first()
    return list(row.q) if row else [None] * len(shares)


def median_of(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The keys and each group's median."""
    return group_quantiles(df, keys, value).select(*keys, F.col("q")[0].alias(name))


def flowing_quantiles(rows: DataFrame, sizes: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5,), part: int = 40, least: int = 100, bins: int = 128) -> DataFrame:
    """The keys, n and q as ``group_quantiles`` has them, of rows that are too many to be written: they are made anew in every pass and
    only counts of bins are shuffled, and at last the rows of the few bins that hold the places.

    ``rows`` has the keys and v, all without nulls, v without NaN; ``sizes`` the keys, n, and bounds lo and hi of v, which need not be met. Bins widen with
    the distance from lo. A bin is taken further while it has more than one in ``part`` of the group's rows, and more than ``least``."""
    at = [(F.col("n") - 1) * F.lit(p) for p in shares]
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))
    sizes = written(sizes.select(*keys, "n", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))
    found = written(sizes.select("*", F.col("n").alias("rows"), F.lit(0).cast("long").alias("before"), places.alias("places"), F.lit(True).alias("first")))
    is_open = (F.col("lo") < F.col("hi")) & (F.col("first") | (F.col("rows") > F.greatest(F.lit(least), F.col("n") / part)))
    while not found.where(is_open).isEmpty():
        inside = rows.join(found.where(is_open), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        width = F.col("hi") / 2 - F.col("lo") / 2  # halves don't overflow
        place = F.floor(F.ln((F.col("v") / 2 - F.col("lo") / 2) / width * 1000 + 1) / math.log(1001) * bins)
        counted = inside.groupBy(*keys, "before", F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        until = F.sum("rows").over(Window.partitionBy(*keys, "before").orderBy("bin"))
        ahead = counted.withColumn("until", F.col("before") + until).withColumn("from", F.col("until") - F.col("rows"))
        ahead = ahead.join(found.where(is_open).select(*keys, "before", "n", "places").withColumnRenamed("before", "was"), keys).where("before = was")  # no arrays in the aggregate, which would sort all rows
        ahead = ahead.withColumn("places", F.filter("places", lambda k: (k >= F.col("from")) & (k < F.col("until")))).where(F.size("places") > 0)
        ahead = ahead.select(*keys, "n", "lo", "hi", "rows", F.col("from").alias("before"), "places", F.lit(False).alias("first"))
        found = written(found.where(~is_open).unionByName(ahead))
    last = rows.join(found.where("lo < hi"), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    turn = F.row_number().over(Window.partitionBy(*keys, "before").orderBy("v"))
    picked = last.select(*keys, "before", "places", "v").withColumn("k", F.col("before") + turn - 1).where(F.array_contains("places", F.col("k"))).select(*keys, "k", "v")
    picked = picked.unionByName(found.where("lo = hi").select(*keys, F.explode("places").alias("k"), F.col("lo").alias("v")))
    each = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))
    return sizes.join(each, keys).select(*keys, "n", F.array(*(_between(x) for x in at)).alias("q"))


def _between(x: Column) -> Column:
    """What ``values`` has at a place, interpolated between the places around it."""
    low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
    a, b = F.element_at("values", low), F.element_at("values", high)
    return F.when((low == high) | (a == b), a).otherwise((high - x) * a + (x - low) * b)

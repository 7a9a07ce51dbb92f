"""Price features for the forest: peers, market and province residuals, and the ladder of a set."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .anomaly import PEERS, SET, ladder, met_again, priced, robust_z
from .quantiles import median_of, whole_quantiles
from .sieve import marks, told

LEAST_PEERS, CLIP = 3, 8.0
#: Log ratios of retail/farm-gate, wholesale/farm-gate and retail/wholesale without any data.
TYPICAL = (1.3, 1.1, 1.1)
NAMES = ("ratio", "z", "market_residual", "province_residual", "channel_code", "retail_farm", "wholesale_farm", "retail_wholesale")
LADDER = (("retail_farm", "retail", "farmgate"), ("wholesale_farm", "wholesale", "farmgate"), ("retail_wholesale", "retail", "wholesale"))


def safe_ln(x):
    return F.ln(F.greatest(x, F.lit(1e-6)))


def peers(rows: DataFrame) -> DataFrame:
    """Median, MAD and IQR of each group of at least LEAST_PEERS rows."""
    q = rows.groupBy(*PEERS).agg(F.count("*").alias("peers"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).where(F.col("peers") >= LEAST_PEERS)
    q = written(q.select(*PEERS, "peers", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))
    mad = rows.join(q.select(*PEERS, "median"), PEERS).groupBy(*PEERS).agg(F.percentile(F.abs(F.col("price") - F.col("median")), 0.5).alias("mad"))
    return written(q.join(mad, PEERS))


def price_features(df: DataFrame) -> DataFrame:
    """Eight features of each priced row, and their signals: distances from what is typical, 0 where imputed.

    Peers and medians are written before they are joined: of a province there are few, and rows that were shuffled to their
    province would meet in one task. ``df`` is read several times."""
    rows = priced(df).select("seq", "id", *SET, "province", "channel", "price")
    base = rows.join(peers(rows), PEERS, "left").withColumn("r", F.coalesce(F.col("price") / F.col("median"), F.lit(1.0)))
    medians = {key: written(median_of(base, [key], F.col("r"), f"{key}_ratio")) for key in ("market", "province")}
    for key, found in medians.items():
        base = base.join(found, key, "left")
    again, alone = met_again(df)
    sets = written(ladder(again).select(*SET, "farmgate", "wholesale", "retail"))
    # a set of one row has no ratio, and counts with the least logarithm like all that lack a price
    ratios = sets.select(*(safe_ln(F.col(a) / F.col(b)).alias(n) for n, a, b in LADDER))
    ratios = ratios.unionByName(df.sparkSession.range(alone).select(*(F.ln(F.lit(1e-6)).alias(n) for n, _, _ in LADDER)))
    typical = [whole_quantiles(ratios, F.col(n))[0] for n, _, _ in LADDER]
    middle = {f"typical_{n}": F.lit(d if m is None else m).cast("double") for (n, _, _), m, d in zip(LADDER, typical, map(math.log, TYPICAL), strict=True)}
    several = sets.where(F.size(F.array_compact(F.array("farmgate", "wholesale", "retail"))) > 1)  # a row's own price is all that others know
    several = written(several.select("*", F.xxhash64(*SET).alias("hash")))
    base = told(base.withColumn("hash", F.xxhash64(*SET)), "hash", marks(several, "hash")).drop("hash")  # only rows that may be in such a set are shuffled to it
    laddered = base.where("__may").join(several.drop("hash"), SET, "left")
    lonely = base.where("NOT __may").withColumns({c: F.lit(None).cast("double") for c in ("farmgate", "wholesale", "retail")})
    base = vectors(laddered.unionByName(lonely).drop("__may").withColumns(middle))
    return base.select("id", "seq", "price", F.coalesce("peers", F.lit(0)).alias("peers"), "median", *NAMES, "signal")


def vectors(base: DataFrame) -> DataFrame:
    """Adds features and signals to rows that have r (the price by its peers' median), figures of their peers, medians of their market and province,
    last prices of their set and what is typical."""
    own = lambda c: F.when(F.col("channel") == c, F.col("price")).otherwise(F.col(c))
    code = F.when(F.col("channel") == "farmgate", 0.0).when(F.col("channel") == "wholesale", 1.0).otherwise(2.0)
    z = F.coalesce(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), robust_z())), F.lit(0.0))
    out = base.withColumns({"ratio": safe_ln(F.col("r")), "z": z, "market_residual": safe_ln(F.col("r") / F.col("market_ratio")), "province_residual": safe_ln(F.col("r") / F.col("province_ratio")), "channel_code": code})
    for name, a, b in LADDER:
        found = F.when(F.col("channel").isin(a, b), safe_ln(own(a) / own(b)))
        out = out.withColumns({f"found_{name}": found, name: F.coalesce(found, F.col(f"typical_{name}"))})
    signal = [F.abs("ratio"), F.abs("z") / 4, F.abs("market_residual"), F.abs("province_residual"), F.lit(0.0)]
    signal += [F.coalesce(F.abs(F.col(f"found_{n}") - F.col(f"typical_{n}")), F.lit(0.0)) for n, _, _ in LADDER]
    return out.withColumn("signal", F.array(*signal))

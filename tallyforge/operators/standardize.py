"""Raw cells to typed records, their lineage, and findings about single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import normalized, title
from ..sources.files import written
from . import match

#: Units that a catalog-free record may have.
UNITS = ("kg", "litre", "piece", "bunch", "bag")


def typed(raw: DataFrame) -> DataFrame:
    """Parsed columns beside the raw ones; names as folded forms."""
    return raw.withColumns({
        "date": parse.date(F.col("raw_date")), "price": parse.price(F.col("raw_price")), "channel": parse.channel(F.col("raw_channel")), "unit": parse.unit(F.col("raw_unit")),
        "commodity_form": normalized(F.col("raw_commodity")), "market_form": normalized(F.col("raw_market")),
    })


def resolved(rows: DataFrame, catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical commodity and market; districts and provinces come from the registry, else from the row where it has them;
    names that aren't accepted keep their text. Rows are written once, as their names are asked for before they are joined.

    What is known of a name is put together for distinct names and written: rows are joined once with each kind, by sending the names out where they are
    few, and never by what a name was matched to."""
    rows = written(rows)
    units = catalog.groupBy(F.col("commodity").alias("match")).agg(F.min("unit").alias("catalog_unit"))
    decided = match.decide(rows.select(F.col("commodity_form").alias("name")), catalog).select(F.col("name").alias("commodity_form"), "status", "match", "score")
    decided = written(decided.join(units, "match", "left"))
    known = registry.groupBy(F.col("market").alias("market_match")).agg(F.min(F.struct("district", "province")).alias("place"))
    markets = match.decide_markets(rows.select(F.col("market_form").alias("name")), registry).select(F.col("name").alias("market_form"), F.col("status").alias("market_status"), F.col("match").alias("market_match"), F.col("score").alias("market_score"))
    markets = written(markets.join(known, "market_match", "left"))
    out = rows.join(decided, "commodity_form", "left").join(markets, "market_form", "left")
    taken = F.col("market_status").isin("exact", "auto")
    raw = {c: F.nullif(F.trim(F.col(f"raw_{c}")), F.lit("")) if f"raw_{c}" in rows.columns else F.lit(None).cast("string") for c in ("district", "province")}
    commodity = F.coalesce(F.when(F.col("status").isin("exact", "auto", "archived"), F.col("match")), F.nullif(title(F.col("raw_commodity")), F.lit("")))
    return out.withColumns({
        "commodity": commodity, "market": F.coalesce(F.when(taken, F.col("market_match")), F.nullif(title(F.col("raw_market")), F.lit(""))),
        **{c: F.coalesce(F.when(taken, F.col(f"place.{c}")), title(raw[c])) for c in ("district", "province")},
    }).drop("place")


def missing(rows: DataFrame) -> DataFrame:
    """One finding a row that lists what it lacks; an unreadable date isn't missing."""
    lacks = F.array_compact(F.array(
        F.when(F.col("raw_date") == "", "date"), F.when(F.col("raw_commodity") == "", "commodity"), F.when(F.col("raw_market") == "", "market"),
        F.when(F.col("channel").isNull(), "channel"), F.when(F.col("price").isNull(), "price"),
    ))
    out = rows.withColumn("fields", F.array_join(lacks, ",")).where("fields <> ''")
    grave = F.col("price").isNull() | (F.col("raw_commodity") == "")
    return out.select("id", "fields", F.when(grave, "critical").otherwise("medium").alias("severity"))


def invalid_dates(rows: DataFrame) -> DataFrame:
    return rows.where("raw_date <> '' AND date IS NULL").select("id", "raw_date", F.lit("high").alias("severity"))


def invalid_prices(rows: DataFrame) -> DataFrame:
    return rows.where("price <= 0").select("id", "price", F.lit("critical").alias("severity"))


def unknown_units(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("unit").isNotNull() & ~F.col("unit").isin(*UNITS)).select("id", "unit", F.lit("medium").alias("severity"))


def unusual_units(rows: DataFrame) -> DataFrame:
    """Of resolved rows: valid units other than the catalog's."""
    return rows.where(F.col("unit").isin(*UNITS) & (F.col("unit") != F.col("catalog_unit")) & F.col("status").isin("exact", "auto")).select("id", "unit", F.col("catalog_unit").alias("suggestion"), F.lit("low").alias("severity"))


def entity_findings(rows: DataFrame) -> DataFrame:
    """Findings on commodity and market names that weren't simply accepted; ``entity`` tells which."""
    names = F.array(
        F.struct(F.lit("commodity").alias("entity"), F.col("status").alias("status"), F.col("match").alias("suggestion"), F.col("score").alias("score")),
        F.struct(F.lit("market").alias("entity"), F.col("market_status").alias("status"), F.col("market_match").alias("suggestion"), F.col("market_score").alias("score")),
    )
    kind = F.when(F.col("status") == "unknown", "UNKNOWN_ENTITY").otherwise("ENTITY_MATCH")
    likely = (F.col("entity") == "market") | (F.col("score") >= 0.78)
    severity = F.when(F.col("status") == "unknown", "high").when(F.col("status").isin("archived", "ambiguous"), "medium").when(likely, "low").otherwise("medium")
    found = rows.select("id", F.inline(names)).where(F.col("status").isin("unknown", "archived", "ambiguous", "review"))
    return found.select("id", "entity", "status", kind.alias("type"), severity.alias("severity"), "suggestion", "score")


def lineage(rows: DataFrame) -> DataFrame:
    """One row for each field that standardising changed."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f"raw_{f}")).alias("before"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("after")) for f in ("date", "channel", "unit")))
    out = rows.select("id", F.inline(fields)).where("before <> after")
    empty = lambda c: F.when(F.col(c) == "", "(empty)").otherwise(F.col(c)).alias(c)
    return out.select("id", "field", empty("before"), empty("after"))

"""The catalog that matching works against, built from product and market registries and farm-gate prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label, title
from ..sources.export import ambiguous_names, export_rows
from .quantiles import median_of

#: Units that are valid without any catalog.
BASE_UNITS = ("kg", "litre", "piece", "bunch")


def _text(x: Column) -> Column:
    return F.coalesce(label(x), F.lit(""))


def commodities(products: DataFrame, farmgate: DataFrame) -> DataFrame:
    """id, code, commodity, local, french, unit, archived, reference_farmgate, aliases of products (id, commodity_code, commodity_name,
    commodity_name_en, commodity_name_fr, commodity_unit, archived).

    The name is the English one, else the local one; gaps are empty, a unit that is missing is kg. The reference is the exact median of the
    product's farm-gate prices (id, price), null without any. Aliases are the other names that differ from it by more than case, local first."""
    middle = median_of(farmgate.where("price IS NOT NULL"), ["id"], F.col("price"), "reference_farmgate")
    local, french = _text(F.col("commodity_name")), _text(F.col("commodity_name_fr"))
    out = products.select(
        "id", F.coalesce(F.col("commodity_code").cast("string"), F.lit("")).alias("code"), F.coalesce(F.nullif(_text(F.col("commodity_name_en")), F.lit("")), local).alias("commodity"),
        local.alias("local"), french.alias("french"), F.lower(F.coalesce("commodity_unit", F.lit("kg"))).alias("unit"), F.coalesce("archived", F.lit(False)).alias("archived"),
    )
    others = F.array_distinct(F.filter(F.array("local", "french"), lambda s: (s != "") & (F.lower(s) != F.lower(F.col("commodity")))))
    return out.join(middle, "id", "left").withColumn("aliases", others)


def archived_names(catalog: DataFrame) -> DataFrame:
    """name (lower case), id, code, commodity: names by which discontinued products are known; of several the one of the largest id."""
    names = catalog.where("archived").select("id", "code", "commodity", F.explode(F.array_distinct(F.array(F.lower("commodity"), F.lower("french")))).alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.max_by(F.struct("id", "code", "commodity"), "id").alias("p")).select("name", "p.*")


def valid_units(catalog: DataFrame) -> DataFrame:
    """unit: those that are always valid and those of the catalog."""
    base = catalog.sparkSession.createDataFrame([(u,) for u in BASE_UNITS], "unit string")
    return base.union(catalog.where("unit <> ''").select("unit")).distinct()


def markets(registry: DataFrame, districts: DataFrame) -> DataFrame:
    """id, code, market, source, district, province, registry_province, shared, conflicts of registered markets (id, market_code, name, district,
    registry_province, linked_province).

    The label is the name in title case; if other markets have it, with the district behind it; if labels are still alike, with the code too. Two
    markets of one name, district and code keep one label. The province is that of the district (district, province) if that is known, else
    the registry's. shared: how many markets have the name. conflicts: provinces in the record that aren't the district's."""
    known = districts.select(F.lower(F.trim("district")).alias("key"), F.col("district").alias("known"), F.col("province").alias("its")).dropDuplicates(["key"])
    rows = registry.withColumns({"key": F.lower(F.trim("district")), "base": F.coalesce(title(F.col("name")), F.lit(""))}).join(known, "key", "left")
    rows = rows.withColumn("place", F.coalesce("known", title(F.col("district")), F.lit("")))
    alike = rows.groupBy("base").agg(F.count("*").alias("shared"))
    rows = rows.join(alike, "base").withColumn("label", F.when(F.col("shared") > 1, F.concat("base", F.lit(" ("), "place", F.lit(")"))).otherwise(F.col("base")))
    again = rows.groupBy("label").agg(F.count("*").alias("labels"))
    code = F.coalesce(F.col("market_code").cast("string"), F.lit(""))
    longer = F.concat(F.regexp_replace("label", r"\)$", ""), F.lit(", code "), code, F.lit(")"))
    said = F.array_distinct(F.filter(F.array("registry_province", "linked_province"), lambda p: p.isNotNull() & (p != "") & (p != F.col("its"))))
    return rows.join(again, "label").select(
        "id", code.alias("code"), F.when(F.col("labels") > 1, longer).otherwise(F.col("label")).alias("market"), F.col("name").alias("source"), F.col("place").alias("district"),
        F.coalesce("its", "registry_province", F.lit("")).alias("province"), "registry_province", "shared", F.when(F.col("its").isNotNull(), said).otherwise(F.array().cast("array<string>")).alias("conflicts"),
    )


def notes(labelled: DataFrame) -> DataFrame:
    """kind, subject, note: markets whose record names another province than their district's, how many these are, and names that several have."""
    odd = labelled.where(F.size("conflicts") > 0)
    one = odd.select(F.lit("province").alias("kind"), F.col("market").alias("subject"), F.concat("district", F.lit(" is in "), "province", F.lit(", the record says "), F.array_join("conflicts", " / ")).alias("note"))
    total = odd.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("provinces").alias("kind"), F.lit("").alias("subject"), F.concat("n", F.lit(" markets disagree with their district")).alias("note"))
    same = labelled.where("shared > 1").groupBy(title(F.col("source")).alias("subject")).agg(F.count("*").alias("n")).select(F.lit("name").alias("kind"), "subject", F.concat("n", F.lit(" markets have this name")).alias("note"))
    return one.unionByName(total).unionByName(same)


def build(products: DataFrame, registry: DataFrame, districts: DataFrame, farmgate: DataFrame, exports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a catalog and one price table out of the exports of each channel, to be saved as a version
    (``Snapshots.save``): commodities, ambiguous, archived, units, markets, notes, prices."""
    catalog, labelled = commodities(products, farmgate), markets(registry, districts)
    prices = None
    for channel, rows in exports.items():
        more = export_rows(rows, products, channel)
        prices = more if prices is None else prices.unionByName(more)
    out = {"commodities": catalog, "ambiguous": ambiguous_names(products), "archived": archived_names(catalog), "units": valid_units(catalog), "markets": labelled, "notes": notes(labelled)}
    return out if prices is None else out | {"prices": prices}

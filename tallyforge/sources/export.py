"""The nested price export: a list of prices, each with its market and product, as nine flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = ("date", "province", "district", "market", "commodity", "price_type", "unit", "price", "export_id")
#: Provinces by their number in the export.
PROVINCES = {1: "Southern Province", 2: "Western Province", 3: "Northern Province", 4: "Eastern Province", 5: "Kigali City"}


def _find(kind: T.StructType, base: Column | None, *path: str) -> tuple[T.DataType, Column] | None:
    """Type and column of a nested field, if the schema has it."""
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        base, kind = F.col(f"`{name}`") if base is None else base.getField(name), kind[name].dataType
    return kind, base


def _text(schema: T.StructType, *paths: tuple[str, ...]) -> Column:
    """The first of some fields that is there and not blank."""
    found = [f[1].cast("string") for p in paths if (f := _find(schema, None, *p)) and not isinstance(f[0], (T.StructType, T.ArrayType))]
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in found), F.lit(""))


def is_export(df: DataFrame) -> bool:
    """Whether a table has the export's fields: a price, a market and a product of some kind."""
    names = set(df.columns)
    return bool(names & {"average_price", "price_1"}) and bool(names & {"market_name", "market"}) and bool(names & {"commodity_code", "product"})


def row_price(schema: T.StructType) -> Column:
    """The average price, else the mean of the up to three prices that are there."""
    def number(name: str) -> Column:
        f = _find(schema, None, name)
        return f[1].cast("double") if f and isinstance(f[0], T.NumericType) else F.lit(None).cast("double")

    prices = F.filter(F.array(*map(number, ("price_1", "price_2", "price_3"))), lambda p: p.isNotNull())
    mean = F.aggregate(prices, F.lit(0.0), lambda a, p: a + p) / F.nullif(F.size(prices), F.lit(0))
    return F.coalesce(number("average_price"), mean)


def province_id(schema: T.StructType, field: str | None = None) -> Column:
    """The market's province: the number in the given field, else in one whose name ends in ``_province``; else in ``province``
    itself or the id within it."""
    market = _find(schema, None, "market")
    named = [n for n in market[0].names if n.endswith("_province")] if market and isinstance(market[0], T.StructType) else []
    found = []
    for path in (*((("market", field),) if field else ()), *(("market", n) for n in named), ("market", "province"), ("market", "province", "id")):
        f = _find(schema, None, *path)
        if f and isinstance(f[0], T.NumericType):
            found.append(f[1].cast("int"))
    return F.coalesce(*found, F.lit(None).cast("int"))


def label(x: Column) -> Column:
    """Single spaces, first letter upper."""
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.concat(F.upper(F.substring(one, 1, 1)), F.substring(one, 2, 1_000_000))


def ambiguous_names(products: DataFrame) -> DataFrame:
    """name: local names, in lower case, that more than one product has."""
    named = products.select(F.col("id"), F.lower(label(F.col("commodity_name"))).alias("name")).where("name <> ''").distinct()
    return named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")


def export_rows(df: DataFrame, products: DataFrame | None = None, channel: str | None = None, province_field: str | None = None) -> DataFrame:
    """The nine columns of each row, as strings, gaps empty.

    A product without details is looked up by its code in ``products`` (id, commodity_name, commodity_name_en,
    commodity_unit). A local name that several products share gives way to the English one. ``province_field`` names the
    market's field that has the number of its province, see ``province_id``."""
    kind = df.schema
    code = _text(kind, ("product", "id"), ("commodity_code",)).try_cast("long")
    own = {"local": _text(kind, ("product", "commodity_name"), ("commodity_name",)), "english": _text(kind, ("product", "commodity_name_en"), ("commodity_name_en",)), "unit": _text(kind, ("product", "commodity_unit"))}
    provinces = F.create_map(*(F.lit(x) for pair in PROVINCES.items() for x in pair))
    price = row_price(kind)
    rows = df.select(
        F.substring(_text(kind, ("created_on",), ("entry_date",)), 1, 10).alias("date"), F.coalesce(provinces[province_id(kind, province_field)], F.lit("")).alias("province"), _text(kind, ("market", "district")).alias("district"),
        _text(kind, ("market", "name"), ("market_name",)).alias("market"), *(c.alias(n) for n, c in own.items()), code.alias("code"),
        F.coalesce(F.nullif(_text(kind, ("price_type",)), F.lit("")), F.lit(channel or "")).alias("price_type"), F.coalesce(price.cast("string"), F.lit("")).alias("price"), _text(kind, ("id",)).alias("export_id"),
    )
    if products is not None:
        known = products.groupBy(F.col("id").cast("long").alias("code")).agg(F.first("commodity_name").alias("l"), F.first("commodity_name_en").alias("e"), F.first("commodity_unit").alias("u"))
        rows = rows.join(known, "code", "left")
        for n, c in (("local", "l"), ("english", "e"), ("unit", "u")):
            rows = rows.withColumn(n, F.coalesce(F.nullif(F.col(n), F.lit("")), F.col(c), F.lit("")))
        shared = ambiguous_names(products).select("name", F.lit(True).alias("shared"))
        rows = rows.withColumn("name", F.lower(label(F.col("local")))).join(shared, "name", "left")
    else:
        rows = rows.withColumn("shared", F.lit(False))
    english, local = label(F.col("english")), label(F.col("local"))
    commodity = F.when(F.coalesce("shared", F.lit(False)) & (english != ""), english).when(local != "", local).otherwise(english)
    return rows.withColumn("commodity", commodity).select(*HEADERS)

"""Price records over the driver's tables, clean and deterministically dirtied, in Spark and in DuckDB SQL.

``seq`` orders records as their source does; ``id`` breaks its ties. Both are plain expressions of a row, so that no
window over the whole table is needed to number it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import apart

#: Channels in ladder order, and how raw tables spell them.
CHANNELS = ("farmgate", "wholesale", "retail")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market registry: market, district, province."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("market_key"), F.col("s_name").alias("market"), F.col("n_name").alias("district"), F.col("r_name").alias("province"))


UNIT = "CASE p_type WHEN 'ECONOMY' THEN 'kg' WHEN 'SMALL' THEN 'piece' WHEN 'MEDIUM' THEN 'litre' WHEN 'PROMO' THEN 'kg' WHEN 'LARGE' THEN 'bag' ELSE 'bunch' END"


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog: commodity, its usual unit, whether it is archived."""
    p = table(spark, sf_dir, "part").withColumn("u", F.expr(UNIT))
    return p.groupBy(F.col("p_name").alias("commodity")).agg(F.min_by("u", "p_partkey").alias("unit")).withColumn("archived", F.col("commodity").endswith(" rod") & F.col("commodity").startswith("hot"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("commodity"), F.expr(UNIT).alias("unit"))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5)
    ident = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # suppliers by themselves, whose size is known, and places after them: joined before, they would be thought too many to be sent out
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s.select("s_suppkey", "s_nationkey", F.col("s_name").alias("market")), li.l_suppkey == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).withColumnsRenamed({"n_name": "district", "r_name": "province"})
    return rows.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), ident.alias("id"), F.trunc("l_shipdate", "month").alias("date"),
        "province", "district", "market", "commodity",
        F.when(F.col("l_returnflag") == "N", "farmgate").when(F.col("l_returnflag") == "A", "wholesale").otherwise("retail").alias("channel"),
        "unit", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")).alias("k"),
    )


_RECORDS_SQL = f"""rec AS (
  SELECT l_orderkey * 16 + l_linenumber AS seq,
    md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), CAST(floor(l_discount * 100 + 0.5) AS BIGINT), CAST(floor(l_tax * 100 + 0.5) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS id,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS date, r_name AS province, n_name AS district, s_name AS market, p_name AS commodity,
    CASE l_returnflag WHEN 'N' THEN 'farmgate' WHEN 'A' THEN 'wholesale' ELSE 'retail' END AS channel,
    {UNIT} AS unit, l_extendedprice / l_quantity AS price, l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Raw spellings as one expression per column; {{...}} marks where the engines differ.
_DIRTY = {
    "raw_date": "CASE k % 50 WHEN 0 THEN '' WHEN 1 THEN '30/02/2000' WHEN 6 THEN {long} WHEN 7 THEN {dow} WHEN 8 THEN {full} WHEN 9 THEN {my} WHEN 10 THEN 'Foo 3, 2001' WHEN 2 THEN {dmy} WHEN 3 THEN {dmy} WHEN 4 THEN {dmony} WHEN 5 THEN concat({ymd}, 'T10:00') ELSE {ymd} END",
    "raw_price": "CASE k % 40 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN concat('-', {whole}) WHEN 3 THEN '0' WHEN 4 THEN concat({whole}, ' RWF') WHEN 5 THEN concat('1,', lpad({whole}, 6, '0')) WHEN 6 THEN '1-2' ELSE concat({whole}, '.', lpad({cents}, 2, '0')) END",
    "raw_commodity": "CASE k % 30 WHEN 0 THEN upper(commodity) WHEN 1 THEN concat(commodity, ' x') WHEN 2 THEN concat('  ', commodity, ' ') WHEN 3 THEN {swapped} WHEN 4 THEN 'Mystery item' WHEN 5 THEN '' ELSE commodity END",
    "raw_market": "CASE k % 35 WHEN 0 THEN '' WHEN 1 THEN upper(market) WHEN 2 THEN concat(market, ' Market') WHEN 3 THEN concat(market, '0') ELSE market END",
    "raw_channel": "CASE WHEN k % 45 = 0 THEN 'unknown' WHEN k % 45 = 1 THEN CASE channel WHEN 'farmgate' THEN 'Farm' WHEN 'wholesale' THEN 'bulk' ELSE 'CONSUMER' END WHEN channel = 'farmgate' THEN CASE k % 3 WHEN 0 THEN 'Farm Gate' WHEN 1 THEN 'farm_gate' ELSE 'Producer price' END WHEN channel = 'wholesale' THEN CASE k % 2 WHEN 0 THEN 'Whole sale' ELSE 'WHOLESALE' END ELSE CASE k % 2 WHEN 0 THEN 'Retail' ELSE 'retailer' END END",
    "raw_unit": "CASE k % 25 WHEN 0 THEN 'crate' WHEN 1 THEN '' WHEN 2 THEN concat(upper(unit), 's') WHEN 3 THEN 'Kgs' WHEN 4 THEN 'liter' WHEN 5 THEN 'Lt' WHEN 6 THEN 'Units' WHEN 7 THEN 'Pcs' ELSE unit END",
}
_WHOLE, _CENTS = "CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) {div} 100 AS {text})", "CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) % 100 AS {text})"
_SPARK = {"long": "date_format(date, 'MMMM d, yyyy')", "dow": "date_format(date, 'EEE, MMM d, yyyy')", "full": "date_format(date, 'd MMMM yyyy')", "my": "date_format(date, 'MMM. yyyy')", "dmy": "date_format(date, 'dd/MM/yyyy')", "dmony": "date_format(date, 'd MMM yyyy')", "ymd": "date_format(date, 'yyyy-MM-dd')", "swapped": "concat(split_part(commodity, ' ', 2), ' ', split_part(commodity, ' ', 1))", "whole": _WHOLE.format(div="div", text="STRING"), "cents": _CENTS.format(text="STRING")}
_DUCK = {"long": "strftime(date, '%B %-d, %Y')", "dow": "strftime(date, '%a, %b %-d, %Y')", "full": "strftime(date, '%-d %B %Y')", "my": "strftime(date, '%b. %Y')", "dmy": "strftime(date, '%d/%m/%Y')", "dmony": "strftime(date, '%-d %b %Y')", "ymd": "strftime(date, '%Y-%m-%d')", "swapped": "concat(split_part(commodity, ' ', 2), ' ', split_part(commodity, ' ', 1))", "whole": _WHOLE.format(div="//", text="VARCHAR"), "cents": _CENTS.format(text="VARCHAR")}


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as an upload would spell them: all strings, with gaps, odd formats and misspellings.

    They are spelled in a step of their own: one method for the joins and all spellings would be too long for the JVM to compile."""
    rows = records(spark, sf_dir)
    return rows.select(*(apart(F.col(c)).alias(c) if c == "k" else c for c in rows.columns)).selectExpr("seq", "id", "k", *(f"{e.format(**_SPARK)} AS {c}" for c, e in _DIRTY.items()))


_RAW_SQL = "raw AS (SELECT seq, id, k, " + ", ".join(f"{e.format(**_DUCK)} AS {c}" for c, e in _DIRTY.items()) + " FROM rec)"
_FOLD = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
_STD_SQL = (
    """std AS (SELECT seq, id, k, raw_date, raw_price, raw_commodity, raw_market, raw_channel, raw_unit,
    CAST(coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%d/%m/%Y'), try_strptime(raw_date, '%-d %b %Y'), try_strptime(raw_date, '%-d %B %Y'), try_strptime(raw_date, '%B %-d, %Y'), try_strptime(raw_date, '%a, %b %-d, %Y'), try_strptime(concat('1 ', raw_date), '%-d %b. %Y'), try_strptime(regexp_extract(raw_date, '^(\\d{4}-\\d{1,2}-\\d{1,2})T', 1), '%Y-%m-%d')) AS DATE) AS date,
    TRY_CAST(nullif(regexp_replace(raw_price, '[^0-9.-]', '', 'g'), '') AS DOUBLE) AS price,
    CASE replace("""
    + _FOLD.format("raw_channel")
    + """, ' ', '') WHEN 'farmgate' THEN 'farmgate' WHEN 'farm' THEN 'farmgate' WHEN 'producer' THEN 'farmgate' WHEN 'producerprice' THEN 'farmgate' WHEN 'wholesale' THEN 'wholesale' WHEN 'wholesaler' THEN 'wholesale' WHEN 'bulk' THEN 'wholesale' WHEN 'retail' THEN 'retail' WHEN 'retailer' THEN 'retail' WHEN 'consumer' THEN 'retail' END AS channel,
    CASE regexp_replace(lower(trim(raw_unit)), 's$', '') WHEN 'kilogram' THEN 'kg' WHEN 'kilo' THEN 'kg' WHEN 'liter' THEN 'litre' WHEN 'lt' THEN 'litre' WHEN 'l' THEN 'litre' WHEN 'egg' THEN 'piece' WHEN 'unit' THEN 'piece' WHEN 'pc' THEN 'piece' ELSE nullif(regexp_replace(lower(trim(raw_unit)), 's$', ''), '') END AS unit,
    """
    + _FOLD.format("raw_commodity")
    + " AS commodity_form, "
    + _FOLD.format("raw_market")
    + """ AS market_form FROM raw),
  cat AS (SELECT p_name AS commodity, arg_min("""
    + UNIT
    + """, p_partkey) AS unit, p_name LIKE 'hot % rod' OR p_name = 'hot rod' AS archived FROM part GROUP BY p_name),
  reg AS (SELECT s_name AS market, n_name AS district, r_name AS province FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
)


def expanded(sql: str) -> str:
    """Oracle text: {rec}, {raw} and {std} at its start stand for the views' definitions and what they build on."""
    parts = {"{rec}": [_RECORDS_SQL], "{raw}": [_RECORDS_SQL, _RAW_SQL], "{std}": [_RECORDS_SQL, _RAW_SQL, _STD_SQL]}
    m = re.match(r"\s*(\{rec\}|\{raw\}|\{std\})(,?)", sql)
    if not m:
        return sql
    return "WITH " + ", ".join(parts[m[1]]) + m[2] + sql[m.end() :]

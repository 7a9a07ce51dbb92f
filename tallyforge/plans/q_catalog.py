"""The catalog build over registries that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4 as cut
from ..operators import catalog, match
from ..sources.export import ambiguous_names
from ..sources.files import scratch
from ..sources.snapshots import Snapshots
from .q_entities import FOLD
from .q_rules import r4
from .registry import query
from .views import UNIT, records, table

_PRODUCT = "CASE WHEN id % 9 <> 0 THEN concat(' ', replace(p_name, ' ', '   ')) END AS commodity_name_en, split_part(p_name, ' ', 2) AS commodity_name, concat(split_part(p_name, ' ', 2), '  ', split_part(p_name, ' ', 1)) AS commodity_name_fr, CASE WHEN id % 11 <> 0 THEN upper(u) END AS commodity_unit, p_name LIKE 'hot %' AS archived"
_REGISTRY = "concat(upper(r_name), ' market ', CAST(s_suppkey % 4 AS {0})) AS name, CASE WHEN s_suppkey % 10 <> 3 THEN lower(n_name) ELSE ' elsewhere ' END AS district, CASE WHEN s_suppkey % 7 <> 5 THEN r_name END AS registry_province, CASE WHEN s_suppkey % 6 = 1 THEN 'OTHER' WHEN s_suppkey % 6 = 2 THEN '' ELSE r_name END AS linked_province"


def products(spark, sf) -> DataFrame:
    """A product of each part name: local names that several share, gaps, odd spaces."""
    p = table(spark, sf, "part").withColumn("u", F.expr(UNIT)).groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min_by("u", "p_partkey").alias("u"))
    return p.selectExpr("id", "CAST(id AS STRING) AS commodity_code", "p_name", *_split(_PRODUCT))


def _split(listed: str) -> list[str]:
    """Expressions of a list that the twin selects as it is."""
    return [e.strip() for e in listed.replace(" AS commodity_name_en, ", " AS commodity_name_en;").replace(" AS commodity_name, ", " AS commodity_name;").replace(" AS commodity_name_fr, ", " AS commodity_name_fr;").replace(" AS commodity_unit, ", " AS commodity_unit;").split(";")]


def registry(spark, sf) -> DataFrame:
    """A market of each supplier: names that a region's markets share, unknown districts, provinces that disagree."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = _REGISTRY.format("STRING")
    for name in ("name", "district", "registry_province"):
        parts = parts.replace(f" AS {name}, ", f" AS {name};")
    return rows.selectExpr("s_suppkey AS id", "CAST(s_suppkey AS STRING) AS market_code", *parts.split(";"))


def districts(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("district"), F.col("r_name").alias("province"))


def farmgate(spark, sf) -> DataFrame:
    rows = records(spark, sf).where("channel = 'farmgate'").select("commodity", "price")
    return rows.join(products(spark, sf).select("id", F.col("p_name").alias("commodity")), "commodity").select("id", "price")


def built(spark, sf) -> DataFrame:
    return catalog.commodities(products(spark, sf), farmgate(spark, sf))


def labelled(spark, sf) -> DataFrame:
    return catalog.markets(registry(spark, sf), districts(spark, sf))


_CLEAN = "coalesce(upper(substr(c{0}, 1, 1)) || substr(c{0}, 2), '')"
_CATALOG = f"""{{rec}},
  prod AS (SELECT id, CAST(id AS VARCHAR) AS code, p_name, {_PRODUCT} FROM (SELECT p_name, min(p_partkey) AS id, arg_min({UNIT}, p_partkey) AS u FROM part GROUP BY p_name)),
  cl AS (SELECT *, trim(regexp_replace(commodity_name_en, '\\s+', ' ', 'g')) AS ce, trim(regexp_replace(commodity_name, '\\s+', ' ', 'g')) AS cn, trim(regexp_replace(commodity_name_fr, '\\s+', ' ', 'g')) AS cf FROM prod),
  fg AS (SELECT prod.id, quantile_cont(price, 0.5) AS m FROM rec JOIN prod ON commodity = p_name WHERE channel = 'farmgate' GROUP BY prod.id),
  built AS (SELECT *, list_distinct(list_filter([local, french], lambda s: s <> '' AND lower(s) <> lower(commodity))) AS al FROM (SELECT id, code, CASE WHEN coalesce(ce, '') <> '' THEN {_CLEAN.format('e')} ELSE {_CLEAN.format('n')} END AS commodity, {_CLEAN.format('n')} AS local, {_CLEAN.format('f')} AS french, lower(coalesce(commodity_unit, 'kg')) AS unit, archived, m FROM cl LEFT JOIN fg USING (id)))"""
_TITLE = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_LABELS = f"""WITH reg0 AS (SELECT s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS code, {_REGISTRY.format('VARCHAR')} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  reg1 AS (SELECT g.*, {_TITLE.format('name')} AS base, coalesce(n_name, {_TITLE.format('district')}) AS place, its FROM reg0 g LEFT JOIN (SELECT n_name, r_name AS its FROM nation JOIN region ON n_regionkey = r_regionkey) ON lower(n_name) = lower(trim(district))),
  reg2 AS (SELECT *, CASE WHEN shared > 1 THEN base || ' (' || place || ')' ELSE base END AS label FROM (SELECT *, count(*) OVER (PARTITION BY base) AS shared FROM reg1)),
  lab AS (SELECT id, code, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN regexp_replace(label, '\\)$', '') || ', code ' || code || ')' ELSE label END AS market, name AS source, base, place AS district, coalesce(its, registry_province, '') AS province, registry_province, shared,
    CASE WHEN its IS NULL THEN '' ELSE concat_ws(' / ', CASE WHEN registry_province NOT IN ('', its) THEN registry_province END, CASE WHEN linked_province NOT IN ('', its) AND linked_province IS DISTINCT FROM registry_province THEN linked_province END) END AS conflicts FROM reg2)"""


@query("s20_catalog", f"{_CATALOG} SELECT id, code, commodity, local, french, unit, archived, {r4('m')} AS reference_farmgate, array_to_string(list_sort(al), '|') AS aliases FROM built")
def s20_catalog(spark, sf):
    """Products with their median farm-gate price and their other names."""
    return built(spark, sf).withColumns({"reference_farmgate": cut(F.col("reference_farmgate")), "aliases": F.array_join(F.sort_array("aliases"), "|")})


@query("s20_lookups", f"""{_CATALOG} SELECT 'ambiguous' AS kind, lower(local) AS name, '' AS value FROM built GROUP BY lower(local) HAVING count(*) > 1 UNION ALL SELECT 'archived', name, max_by(code, id) FROM (SELECT id, code, lower(unnest([commodity, french])) AS name FROM built WHERE archived) WHERE name <> '' GROUP BY name
  UNION ALL SELECT DISTINCT 'unit', unit, '' FROM (SELECT unit FROM built UNION SELECT unnest(['kg', 'litre', 'piece', 'bunch']))""")
def s20_lookups(spark, sf):
    """Local names that several products share, names of discontinued products, valid units."""
    c = built(spark, sf)
    of = lambda kind, name, value: (F.lit(kind).alias("kind"), F.col(name).alias("name"), value.alias("value"))
    none = F.lit("")
    return ambiguous_names(products(spark, sf)).select(*of("ambiguous", "name", none)).union(catalog.archived_names(c).select(*of("archived", "name", F.col("code")))).union(catalog.valid_units(c).select(*of("unit", "unit", none)))


@query("s20_alias_owners", f"{_CATALOG} SELECT name, string_agg(DISTINCT owner, '|' ORDER BY owner) AS owners FROM (SELECT owner, {FOLD.format('n')} AS name FROM (SELECT commodity AS owner, unnest(list_append(al, commodity)) AS n FROM built)) WHERE name IN (SELECT {FOLD.format('commodity_name')} FROM prod) GROUP BY name")
def s20_alias_owners(spark, sf):
    """Owners of each local name, by the catalog's own aliases."""
    names = products(spark, sf).select(F.lower("commodity_name").alias("name"))
    return match.exact_owners(names.distinct(), match.forms(built(spark, sf))).select("name", F.array_join("owners", "|").alias("owners"))


@query("s21_market_labels", f"{_LABELS} SELECT id, code, market, source, district, province, registry_province, conflicts FROM lab")
def s21_market_labels(spark, sf):
    """Registered markets under labels of their own, with the provinces that disagree."""
    return labelled(spark, sf).withColumn("conflicts", F.array_join("conflicts", " / ")).drop("shared")


@query("s21_catalog_notes", f"{_LABELS} SELECT 'province' AS kind, market AS subject, district || ' is in ' || province || ', the record says ' || conflicts AS note FROM lab WHERE conflicts <> '' UNION ALL SELECT 'provinces', '', count(*) || ' markets disagree with their district' FROM lab WHERE conflicts <> '' HAVING count(*) > 0 UNION ALL SELECT 'name', base, count(*) || ' markets have this name' FROM lab WHERE shared > 1 GROUP BY base")
def s21_catalog_notes(spark, sf):
    return catalog.notes(labelled(spark, sf))


@query("s22_build", f"""{_CATALOG}, {_LABELS.removeprefix('WITH ')} SELECT 'commodities' AS "table", count(*) AS n FROM built UNION ALL SELECT 'ambiguous', count(*) FROM (SELECT lower(local) FROM built GROUP BY lower(local) HAVING count(*) > 1) UNION ALL SELECT 'archived', count(DISTINCT name) FROM (SELECT lower(unnest([commodity, french])) AS name FROM built WHERE archived)
  UNION ALL SELECT 'units', count(*) FROM (SELECT unit FROM built UNION SELECT unnest(['kg', 'litre', 'piece', 'bunch'])) UNION ALL SELECT 'markets', count(*) FROM lab UNION ALL SELECT 'prices', count(*) FROM rec
  UNION ALL SELECT 'notes', (SELECT count(*) FROM lab WHERE conflicts <> '') + (SELECT count(DISTINCT base) FROM lab WHERE shared > 1) + (SELECT CAST(count(*) > 0 AS INTEGER) FROM lab WHERE conflicts <> '')""")
def s22_build(spark, sf):
    """A catalog and the prices of three channels, saved as a version and loaded again: rows of each table."""
    rec = records(spark, sf).join(products(spark, sf).select(F.col("id").alias("pid"), F.col("p_name").alias("commodity")), "commodity")
    market = F.struct(F.col("market").alias("name"), F.col("district").alias("district"))
    rows = rec.select("channel", F.struct(F.col("pid").alias("id")).alias("product"), market.alias("market"), F.col("price").alias("average_price"), F.col("date").cast("string").alias("date"))
    exports = {c: rows.where(F.col("channel") == c).drop("channel") for c in ("farmgate", "wholesale", "retail")}
    tables = catalog.build(products(spark, sf), registry(spark, sf), districts(spark, sf), farmgate(spark, sf), exports)
    kept = Snapshots(spark, scratch(spark))
    kept.save(tables)
    out = None
    for name, saved in kept.load().items():
        n = saved.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out

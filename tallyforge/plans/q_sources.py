"""Sources, sinks, column mapping and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from ..sources import export, mapping, readers
from ..sources.files import scratch
from ..streaming import dedup
from .q_rules import LADDER, r4
from .registry import query
from .views import UNIT, raw_records, records, table

_CENTS = "CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT)"


@query("s02_csv_roundtrip", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, concat(s_name, ', \"', n_name, '\"') AS label, CAST({_CENTS} AS VARCHAR) AS cents FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s02(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat("s_name", F.lit(', "'), "n_name", F.lit('"')).alias("label"), F.floor(F.col("s_acctbal") * 100 + 0.5).cast("long").alias("cents"))
    where = scratch(spark)
    rows.write.csv(where, header=True, escape='"')
    return readers.read_delimited(spark, where)


@query("s05_json_roundtrip", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS \"user.type\", CAST(user_id AS VARCHAR) AS \"user.id\" FROM events")
def s05(spark, sf):
    where = scratch(spark)
    table(spark, sf, "events").select("event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("id")).alias("user")).write.json(where)
    return readers.read_json(spark, where)


@query("s06_json_explode", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def s06(spark, sf):
    e = table(spark, sf, "events").withColumn("props", F.from_json("props", "k long"))
    return readers.flattened(e.select("event_type", "props")).groupBy("event_type", F.col("`props.k`").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("s09_xml_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def s09(spark, sf):
    where = scratch(spark)
    table(spark, sf, "nation").write.format("xml").option("rootTag", "nations").option("rowTag", "nation").save(where)
    return readers.read_xml(spark, where, "nation")


@query("s03_sniff_delimiter", "SELECT d.name, d.sign AS found, (SELECT count(*) FROM customer) AS rows FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) d(name, sign)")
def s03(spark, sf):
    """Customers written with each delimiter; the one that is found in the file, and the rows that are read by it."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.format_string("%d,%d", "c_nationkey", "c_custkey").alias("pair"))
    parts = []
    for name, sign in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        where = scratch(spark)
        rows.write.csv(where, sep=sign, header=True, quote='"', escape='"')
        found = readers.sniff_delimiter([r.value for r in spark.read.text(where).limit(readers.HEAD_LINES).collect()])
        parts.append(readers.read_delimited(spark, where).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(found).alias("found"), "rows"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("p01_detect_columns", "{raw} SELECT 'date' AS field, 'Price date' AS header, count(*) FILTER (WHERE trim(raw_date) <> '') AS filled FROM raw UNION ALL SELECT 'market', 'Market_Name', count(*) FILTER (WHERE trim(raw_market) <> '') FROM raw UNION ALL SELECT 'commodity', 'Product', count(*) FILTER (WHERE trim(raw_commodity) <> '') FROM raw UNION ALL SELECT 'price_type', 'Price_Type', count(*) FILTER (WHERE trim(raw_channel) <> '') FROM raw UNION ALL SELECT 'unit', 'Unit', count(*) FILTER (WHERE trim(raw_unit) <> '') FROM raw UNION ALL SELECT 'price', 'Price_RWF', count(*) FILTER (WHERE trim(raw_price) <> '') FROM raw")
def p01(spark, sf):
    """An upload's file: which header is found for which field, and how many of its cells are filled."""
    names = {"raw_date": "Price date", "raw_market": "Market_Name", "raw_commodity": "Product", "raw_channel": "Price_Type", "raw_unit": "Unit", "raw_price": "Price_RWF"}
    where = scratch(spark)
    raw_records(spark, sf).select(*(F.col(c).alias(n) for c, n in names.items())).write.csv(where, header=True, quote='"', escape='"')
    read = readers.read_delimited(spark, where)
    found = {f: h for f, h in mapping.detect_columns(read.columns).items() if h}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(h).alias("header"), (F.col(f"`{h}`") != "").alias("there")) for f, h in found.items()))
    return read.select(F.inline(cells)).groupBy("field", "header").agg(F.sum(F.col("there").cast("long")).alias("filled"))


@query("p02_suggest_mapping")
def p02(spark, sf):
    raw = raw_records(spark, sf)
    upload = raw.select(*(F.col(c).alias(n) for c, n in (("raw_date", "Day"), ("raw_market", "Market name"), ("raw_commodity", "Products"), ("raw_channel", "Price type"), ("raw_unit", "Unit"), ("raw_price", "Price"))))
    return spark.createDataFrame(list(mapping.suggest_mapping(upload).items()), "field string, header string")


@query("p04_apply_mapping", "{raw} SELECT raw_market AS market, raw_commodity AS commodity, raw_price AS price, 'retail' AS price_type FROM raw")
def p04(spark, sf):
    return mapping.apply_mapping(raw_records(spark, sf), {"market": "raw_market", "commodity": "raw_commodity", "price": "raw_price"}, mapping.channel_from_name("prices_Retail_2026.csv"))


@query("p06_unpivot_channels", f"{{rec}}, {LADDER} SELECT date, market, commodity, price_type, {r4('price')} AS price FROM (SELECT date, market, commodity, 'farmgate' AS price_type, farmgate AS price FROM lad UNION ALL SELECT date, market, commodity, 'wholesale', wholesale FROM lad UNION ALL SELECT date, market, commodity, 'retail', retail FROM lad) WHERE price IS NOT NULL")
def p06(spark, sf):
    wide = anomaly.ladder(records(spark, sf)).select("date", "market", "commodity", F.col("farmgate").alias("Farm gate"), F.col("wholesale").alias("Wholesale"), F.col("retail").alias("Retail"))
    long = mapping.unpivot_channels(wide, {"farmgate": "Farm gate", "wholesale": "Wholesale", "retail": "Retail"})
    return long.withColumn("price", F.floor(F.col("price") * 1e4 + 0.5) / 1e4)


@query("u01_merge_tables", "SELECT n_name AS name, '' AS extra, 'nation' AS source_file FROM nation UNION ALL SELECT r_name, r_name, 'region' FROM region")
def u01(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("extra"))
    return readers.merged({"nation": n, "region": r})


@query("e01_stream_exact_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def e01(spark, sf):
    """Events sent twice, through a stream that lets each id through once."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    where = scratch(spark)
    e.union(e).write.parquet(where)
    stream = spark.readStream.schema(e.schema).parquet(where)
    return dedup.run_available(dedup.deduplicated(stream, "3650 days"), spark).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s14_nested_export", f"""WITH p AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS local, p_name AS english, {UNIT} AS unit FROM part), sh AS (SELECT local FROM p GROUP BY local HAVING count(DISTINCT id) > 1)
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, CASE CASE WHEN l_suppkey % 4 = 0 THEN n_regionkey ELSE (n_regionkey + 1) % 5 END WHEN 1 THEN 'Southern Province' WHEN 2 THEN 'Western Province' WHEN 3 THEN 'Northern Province' WHEN 4 THEN 'Eastern Province' ELSE '' END AS province, n_name AS district, s_name AS market,
  CASE WHEN p.local IN (SELECT local FROM sh) THEN upper(p.english[1]) || p.english[2:] ELSE upper(p.local[1]) || p.local[2:] END AS commodity, 'retail' AS price_type, p.unit AS unit,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE (l_quantity * 2 + l_linenumber) / 2 END AS DOUBLE) AS price, CAST(l_orderkey * 16 + l_linenumber AS VARCHAR) AS export_id
  FROM lineitem JOIN p ON l_partkey = p.id JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def s14(spark, sf):
    """Prices nested as in an export, written as JSON, read back and flattened; products are looked up by code."""
    li, s, n, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "part"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    turn = F.col("l_linenumber") % 3
    nested = rows.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("created_on"), F.col("l_partkey").alias("commodity_code"),
        F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("district"), F.when(F.col("l_suppkey") % 4 != 0, (F.col("n_regionkey") + 1) % 5).alias("held_in_province"), F.struct(F.col("n_regionkey").alias("id")).alias("province")).alias("market"),
        F.when(turn == 1, F.col("l_quantity").cast("double")).alias("average_price"), F.when(turn == 2, F.col("l_quantity").cast("double") * 2).alias("price_1"), F.when(turn == 2, F.col("l_linenumber").cast("double")).alias("price_2"),
    )
    where = scratch(spark)
    nested.write.json(where)
    read = spark.read.json(where)
    if not export.is_export(read):
        raise ValueError("not a nested export")
    products = p.select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("commodity_name"), F.col("p_name").alias("commodity_name_en"), F.expr(UNIT).alias("commodity_unit"))
    return export.export_rows(read, products, channel="retail", province_field="held_in_province").withColumn("price", F.nullif("price", F.lit("")).cast("double"))


@query("s16_bad_rows", """WITH l AS (SELECT l_orderkey * 16 + l_linenumber AS id, l_orderkey + l_linenumber AS k, l_quantity FROM lineitem)
  SELECT 'row' AS kind, CAST(id AS VARCHAR) AS id, CASE k % 5 WHEN 0 THEN concat('two', chr(10), 'lines, "', CAST(k AS VARCHAR), '"') ELSE concat('plain ', CAST(k AS VARCHAR)) END AS note, CASE WHEN k % 7 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS amount FROM l
  UNION ALL SELECT 'bad', CAST(id AS VARCHAR), 'width', CAST(CASE WHEN k % 7 = 0 THEN 2 ELSE 4 END AS VARCHAR) FROM l WHERE k % 7 = 0 OR k % 11 = 0""")
def s16_bad_rows(spark, sf):
    """One CSV file with quoted line breaks, short rows and long ones: its rows, and the list of those that aren't of the header's width."""
    k, n = F.col("k"), F.col("l_quantity").cast("long").cast("string")
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("string").alias("id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("k"), "l_quantity")
    note = F.when(k % 5 == 0, F.concat(F.lit('"two\nlines, ""'), k.cast("string"), F.lit('"""'))).otherwise(F.concat(F.lit("plain "), k.cast("string")))
    rest = F.when(k % 7 == 0, "").when(k % 11 == 0, F.concat(F.lit(","), n, F.lit(",more"))).otherwise(F.concat(F.lit(","), n))
    where = scratch(spark)
    made = li.select(F.concat("id", F.lit(","), note, rest).alias("value"))
    spark.createDataFrame([("made by a query",), ("id,note,amount",)], "value string").coalesce(1).union(made).coalesce(1).write.text(where)
    found = readers.delimited_table(spark, where)
    bad = found.bad.select(F.lit("bad").alias("kind"), F.split_part("text", F.lit(","), F.lit(1)).alias("id"), F.col("problem").alias("note"), F.col("cells").cast("string").alias("amount"))
    return found.rows.select(F.lit("row").alias("kind"), "id", "note", "amount").unionByName(bad)


@query("s13_read_export", """SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, CASE n_regionkey WHEN 1 THEN 'Southern Province' WHEN 2 THEN 'Western Province' WHEN 3 THEN 'Northern Province' WHEN 4 THEN 'Eastern Province' ELSE '' END AS province, n_name AS district, s_name AS market,
  upper(p_name[1]) || p_name[2:] AS commodity, 'retail' AS price_type, 'kg' AS unit, CAST(l_quantity AS DOUBLE) AS price, CAST(l_orderkey * 16 + l_linenumber AS VARCHAR) AS export_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def s13_read_export(spark, sf):
    """A nested export in JSON, which the reader of all formats finds to be one."""
    li, s, n, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "part"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
    nested = rows.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("created_on"), F.lit("retail").alias("price_type"), F.col("l_quantity").cast("double").alias("average_price"),
        F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("district"), F.col("n_regionkey").alias("province")).alias("market"),
        F.struct(F.col("l_partkey").alias("id"), F.col("p_name").alias("commodity_name"), F.lit("kg").alias("commodity_unit")).alias("product"),
    )
    where = f"{scratch(spark)}.json"
    nested.write.json(where)
    return readers.read_table(spark, where).withColumn("price", F.col("price").cast("double"))

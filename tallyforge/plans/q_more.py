"""Exports, explanations, counters and decisions after publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import r4 as cut
from ..operators import analytics, anomaly, explain, review
from ..sources import sinks
from ..sources.files import scratch, written
from . import q_analytics
from .q_analytics import ISSUES, TRUSTED
from .q_entities import std
from .q_rules import OUTLIERS, r4
from .registry import query
from .views import markets, records, table

_EXPORT = f"strftime(date, '%Y-%m-%d') AS date, province, district, market, commodity, channel, unit, {r4('price')} AS price, 'RWF' AS currency"


@query("k02_trusted_export", f"{{rec}}, {TRUSTED} SELECT {_EXPORT}, 'no' AS corrected FROM trusted")
def k02(spark, sf):
    """Trusted records written as CSV and read back."""
    where = scratch(spark)
    sinks.write_csv(q_analytics.trusted(spark, sf), where)
    return spark.read.csv(where, header=True, escape='"').withColumn("price", cut(F.col("price").cast("double")))


@query("k03_clean_export", f"{{rec}}, {TRUSTED} SELECT {_EXPORT}, false AS corrected FROM trusted WHERE price > 0")
def k03(spark, sf):
    """Clean records written as JSON and read back."""
    where = scratch(spark)
    sinks.write_json(sinks.clean(q_analytics.trusted(spark, sf)), where)
    kinds = "date string, province string, district string, market string, commodity string, channel string, unit string, price double, currency string, corrected boolean"
    return spark.read.schema(kinds).json(where).withColumn("price", cut(F.col("price")))


_RATIO = "(price / median)"
_USUAL = f"""CASE WHEN {_RATIO} >= 2 THEN concat(CAST(floor({_RATIO} * 10 + 0.5) / 10 AS VARCHAR), ' times the usual price') WHEN {_RATIO} > 1 THEN concat(CAST(CAST(floor(({_RATIO} - 1) * 100 + 0.5) AS BIGINT) AS VARCHAR), ' % over the usual price')
  WHEN {_RATIO} <= 0.5 THEN concat('no more than ', CAST(CAST(floor({_RATIO} * 100 + 0.5) AS BIGINT) AS VARCHAR), ' % of the usual price') ELSE concat(CAST(CAST(floor((1 - {_RATIO}) * 100 + 0.5) AS BIGINT) AS VARCHAR), ' % under the usual price') END"""


@query("f26_usual_price", f"{{rec}}, {OUTLIERS} SELECT id, {_USUAL} AS usual, CASE WHEN {_RATIO} >= 7 THEN 'extra_zero' WHEN {_RATIO} <= 1.0::DOUBLE / 7 THEN 'missing_zero' WHEN {_RATIO} > 1 THEN 'rise' ELSE 'drop' END AS cause FROM zz")
def f26(spark, sf):
    rec = written(records(spark, sf))
    rows = anomaly.priced(rec).join(anomaly.robust_stats(rec), anomaly.PEERS)
    return rows.select("id", explain.usual_price(F.col("price"), F.col("median")).alias("usual"), explain.likely_cause(F.col("price"), F.col("median")).alias("cause"))


@query("f29_score_band", "SELECT CASE WHEN l_quantity * 2 >= 90 THEN 'excellent' WHEN l_quantity * 2 >= 75 THEN 'good' WHEN l_quantity * 2 >= 60 THEN 'fair' ELSE 'needs attention' END AS band, count(*) AS n FROM lineitem GROUP BY band")
def f29(spark, sf):
    return table(spark, sf, "lineitem").groupBy(explain.score_band(F.col("l_quantity") * 2).alias("band")).agg(F.count("*").alias("n"))


_BARE = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_CLEANED = f"(raw_commodity <> '' AND commodity_form <> '' AND {_BARE.format('raw_commodity')} <> {_BARE.format('commodity_form')})"


@query("p16_edit_flags", f"{{std}} SELECT id, {_CLEANED} AS cleaned, NOT {_CLEANED} AND raw_commodity <> '' AND trim(raw_commodity) <> commodity_form AS reformatted FROM std")
def p16(spark, sf):
    cleaned, reformatted = explain.edit_flags(F.col("raw_commodity"), F.col("commodity_form"))
    return std(spark, sf).select("id", cleaned.alias("cleaned"), reformatted.alias("reformatted"))


@query("a27_readiness", f"{{rec}}, {ISSUES}, e AS (SELECT count(*) AS errors FROM rec WHERE id IN (SELECT record_id FROM iss WHERE status = 'open' AND severity IN ('critical', 'high'))) SELECT (SELECT count(*) FROM rec) AS rows, errors, CAST(floor(((SELECT count(*) FROM rec) - errors) / CAST((SELECT count(*) FROM rec) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS ready, (SELECT count(*) FROM iss WHERE status = 'open' AND confidence >= 0.9) AS sure FROM e")
def a27(spark, sf):
    rec = written(records(spark, sf))
    return explain.readiness(rec, written(q_analytics.issues(spark, sf, rec)))


@query("p13_attention", f"{{rec}}, {ISSUES}, st0 AS (SELECT record_id, CASE WHEN bool_or(status = 'open' AND severity IN ('critical', 'high')) THEN 'error' WHEN bool_or(status = 'open') THEN 'warning' ELSE 'valid' END AS state FROM iss GROUP BY record_id) SELECT id, state FROM rec JOIN st0 ON id = record_id WHERE state <> 'valid' AND contains(lower(concat_ws(' ', market, commodity, CAST(date AS VARCHAR))), 'red')")
def p13(spark, sf):
    rec = written(records(spark, sf))
    return explain.attention(rec, review.row_states(q_analytics.issues(spark, sf, rec)), search=" Red").select("id", "state")


@query("u07_replaced_findings", f"{{rec}}, {ISSUES} SELECT record_id, type, severity FROM iss WHERE type NOT IN ('PRICE_ANOMALY', 'LADDER_VIOLATION') UNION ALL SELECT id, 'PRICE_ANOMALY', severity FROM outliers")
def u07(spark, sf):
    rec = written(records(spark, sf))
    theirs = anomaly.price_outliers(rec).select(F.col("id").alias("record_id"), F.lit("PRICE_ANOMALY").alias("type"), "severity")
    return explain.replaced(q_analytics.issues(spark, sf, rec).select("record_id", "type", "severity"), theirs, ("PRICE_ANOMALY", "LADDER_VIOLATION"))


_DECISIONS = """fx AS (SELECT id, 1 AS ts, 'price' AS field, CAST(CAST(floor(median + 0.5) AS BIGINT) AS VARCHAR) AS v FROM outliers WHERE substr(id, 1, 1) IN ('a', 'b') UNION ALL SELECT id, 2, 'price', '120' FROM outliers WHERE substr(id, 1, 1) = 'b' UNION ALL SELECT id, 3, 'market', 'Moved' FROM outliers WHERE substr(id, 1, 1) = 'b')"""


def resolved(spark, sf):
    """Some outliers get the median, some of them 120 after that (mostly less than the median), and another market."""
    rec = written(records(spark, sf))
    first, found = F.substring("id", 1, 1), anomaly.price_outliers(rec)
    none = F.lit(None).cast("string")
    made = found.where(first.isin("a", "b")).select("id", F.lit(1).alias("at"), F.lit("corrected").alias("status"), none.alias("field"), F.col("suggestion").cast("string").alias("suggestion"), none.alias("override"))
    later = found.where(first == "b")
    made = made.union(later.select("id", F.lit(2), F.lit("corrected"), F.lit("price"), F.col("suggestion").cast("string"), F.lit("120")))
    made = made.union(later.select("id", F.lit(3), F.lit("corrected"), F.lit("market"), none, F.lit("Moved"))).union(later.select("id", F.lit(4), F.lit("accepted"), F.lit("price"), F.lit("7"), none))
    return review.resolved(rec, made)


@query("r09_resolved", f"{{rec}}, {OUTLIERS}, {_DECISIONS} SELECT id, {r4('coalesce(CAST(p.v AS DOUBLE), price)')} AS price, coalesce(m.v, market) AS market, p.v IS NOT NULL AS corrected FROM rec LEFT JOIN (SELECT id, max_by(v, ts) AS v FROM fx WHERE field = 'price' GROUP BY id) p USING (id) LEFT JOIN (SELECT id, v FROM fx WHERE field = 'market') m USING (id)")
def r09(spark, sf):
    out, _ = resolved(spark, sf)
    return out.select("id", cut(F.col("price")).alias("price"), "market", "corrected")


@query("r09_resolved_lineage", f"{{rec}}, {OUTLIERS}, {_DECISIONS} SELECT id, field, ts AS step, CASE WHEN ts = 3 THEN market WHEN ts = 2 THEN lag(v) OVER (PARTITION BY id, field ORDER BY ts) END AS before, v AS after FROM fx JOIN rec USING (id)")
def r09_lineage(spark, sf):
    """What each decision changed; a price's own value, which engines spell differently, is left out."""
    _, lineage = resolved(spark, sf)
    return lineage.select("id", "field", F.col("at").alias("step"), F.when(F.col("at") > 1, F.col("before")).alias("before"), "after")


@query("j17_market_medians", f"{{rec}} SELECT s_name AS market, n_name AS district, CAST(floor(median + 0.5) AS BIGINT) AS median, n FROM (SELECT market, quantile_cont(price, 0.5) AS median, count(*) AS n FROM rec WHERE price > 0 GROUP BY market) JOIN supplier ON lower(s_name) = lower(market) JOIN nation ON s_nationkey = n_nationkey")
def j17(spark, sf):
    known = markets(spark, sf).select(F.lower("market").alias("key"), F.col("market").alias("name"), F.col("district").alias("place"))
    return analytics.market_medians(records(spark, sf)).join(known, F.lower("market") == F.col("key")).select(F.col("name").alias("market"), F.col("place").alias("district"), "median", "n")

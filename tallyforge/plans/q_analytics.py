"""Profiles, scores and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import r4 as cut
from ..operators import analytics, anomaly, dedupe, profile, standardize
from ..operators.quantiles import median_of
from ..sources.files import written
from .q_entities import RES, res, std
from .q_rules import DUPES, LADDER, OUTLIERS, r4
from .registry import query
from .views import markets, raw_records, records, table

RAW = ["raw_date", "raw_price", "raw_commodity", "raw_market", "raw_channel", "raw_unit"]
_ROW_ISSUES = """SELECT id AS record_id, 'MISSING_VALUE' AS type, 'conflict' AS category, CASE WHEN price IS NULL OR raw_commodity = '' THEN 'critical' ELSE 'medium' END AS severity, 1.0::DOUBLE AS confidence FROM std WHERE raw_date = '' OR raw_commodity = '' OR raw_market = '' OR channel IS NULL OR price IS NULL
  UNION ALL SELECT id, 'INVALID_DATE', 'conflict', 'high', 1.0 FROM std WHERE raw_date <> '' AND date IS NULL UNION ALL SELECT id, 'INVALID_PRICE', 'conflict', 'critical', 1.0 FROM std WHERE price <= 0
  UNION ALL SELECT id, 'UNIT_INCONSISTENCY', 'conflict', 'medium', 0.85 FROM std WHERE unit NOT IN ('kg', 'litre', 'piece', 'bunch', 'bag')"""
ISSUES = f"""{OUTLIERS}, {LADDER}, {DUPES},
  iss0 AS (SELECT id AS record_id, 'PRICE_ANOMALY' AS type, 'anomaly' AS category, severity, least(0.99, 0.6 + least(abs(z), 12.0) / 20 + CASE WHEN outside THEN 0.08 ELSE 0.0 END) AS confidence FROM outliers
    UNION ALL SELECT record_id, 'LADDER_VIOLATION', 'conflict', CASE WHEN "check" = 'farmgate>retail' THEN 'critical' WHEN gap > 30 THEN 'high' ELSE 'medium' END, least(0.99, 0.75 + gap / 200) FROM viol
    UNION ALL SELECT id, CASE WHEN same THEN 'EXACT_DUPLICATE' ELSE 'PROBABLE_DUPLICATE' END, 'duplicate', CASE WHEN same THEN 'high' ELSE 'critical' END, CASE WHEN same THEN 0.99 ELSE 0.9 END FROM dup),
  iss AS (SELECT record_id, type, category, severity, {r4('confidence')} AS confidence, CASE WHEN substr(md5(concat(record_id, type)), 1, 1) IN ('0', '1', '2', '3') THEN 'accepted' ELSE 'open' END AS status FROM iss0)"""
TRUSTED = f"{ISSUES}, trusted AS (SELECT * FROM rec WHERE price IS NOT NULL AND id NOT IN (SELECT record_id FROM iss WHERE status = 'open' AND severity IN ('critical', 'high')))"


def with_status(found):
    """Findings with a decision: a quarter, by a hash, count as accepted."""
    return found.withColumn("status", F.when(F.substring(F.md5(F.concat("record_id", "type")), 1, 1).isin(*"0123"), "accepted").otherwise("open"))


def issues(spark, sf, rec=None):
    """Findings of all rules over the clean records, one stream after the other; records are read by every rule, so they
    are written once."""
    rec = written(records(spark, sf)) if rec is None else rec
    parts = [
        anomaly.price_outliers(rec).select(F.col("id").alias("record_id"), F.lit("PRICE_ANOMALY").alias("type"), F.lit("anomaly").alias("category"), "severity", "confidence"),
        anomaly.ladder_violations(rec).select("record_id", F.lit("LADDER_VIOLATION").alias("type"), F.lit("conflict").alias("category"), "severity", "confidence"),
        dedupe.exact_duplicates(rec).select(F.col("id").alias("record_id"), "type", F.lit("duplicate").alias("category"), "severity", "confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_status(out)


def trusted(spark, sf):
    rec = written(records(spark, sf))
    return analytics.trusted(rec, issues(spark, sf, rec), at_once=True)


@query("a05_column_profile", "{raw}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim({c}) AS v, TRY_CAST(trim({c}) AS DOUBLE) AS x FROM raw" for c in RAW) + f"""), p AS (SELECT "column", count(*) AS n, count(*) FILTER (WHERE v = '') AS missing, count(DISTINCT nullif(v, '')) AS "distinct", count(x) AS numbers, min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM long GROUP BY ALL),
  t AS (SELECT *, CASE WHEN numbers > 0.9 * (n - missing) AND numbers > 0 THEN 'numeric' WHEN contains("column", 'date') THEN 'date' ELSE 'categorical' END AS type FROM p) SELECT "column", type, missing, "distinct", CASE WHEN type = 'numeric' THEN {r4('lo')} END AS min, CASE WHEN type = 'numeric' THEN {r4('hi')} END AS max, CASE WHEN type = 'numeric' THEN {r4('mean')} END AS mean FROM t""")
def a05(spark, sf):
    return profile.columns(raw_records(spark, sf), RAW)


@query("a06_dataset_profile", "{rec} SELECT count(*) AS rows, count(DISTINCT commodity) AS commodities, count(DISTINCT market) AS markets, count(DISTINCT province) AS provinces, count(DISTINCT district) AS districts, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days, count(*) - count(DISTINCT concat_ws('|', CAST(date AS VARCHAR), market, commodity, channel)) AS duplicate_rows, count(*) FILTER (WHERE channel = 'farmgate') AS farmgate, count(*) FILTER (WHERE channel = 'wholesale') AS wholesale, count(*) FILTER (WHERE channel = 'retail') AS retail FROM rec")
def a06(spark, sf):
    return profile.dataset(records(spark, sf))


@query("a07_coverage", f"{{rec}} SELECT r_name AS province, count(*) AS markets, count(n) AS reporting, CAST(coalesce(sum(n), 0) AS BIGINT) AS observations, {r4('CAST(count(n) AS DOUBLE) / count(*)')} AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT market, count(*) AS n FROM rec GROUP BY market) ON market = s_name GROUP BY r_name")
def a07(spark, sf):
    return profile.coverage(records(spark, sf), markets(spark, sf))


@query("j16_reporting_markets", "{rec} SELECT s_name AS market FROM supplier WHERE s_name IN (SELECT market FROM rec)")
def j16(spark, sf):
    return markets(spark, sf).join(records(spark, sf).select("market"), "market", "left_semi").select("market")


_SCORE_SQL = f"""{{std}}, {RES}, i0 AS ({_ROW_ISSUES} UNION ALL SELECT id, CASE WHEN status = 'unknown' THEN 'UNKNOWN_ENTITY' ELSE 'ENTITY_MATCH' END, 'conflict', 'medium', score FROM res WHERE status IN ('unknown', 'archived', 'ambiguous', 'review')
    UNION ALL SELECT id, CASE WHEN market_status = 'unknown' THEN 'UNKNOWN_ENTITY' ELSE 'ENTITY_MATCH' END, 'conflict', 'medium', market_score FROM res WHERE market_status IN ('unknown', 'ambiguous', 'review')),
  ri AS (SELECT *, CASE WHEN substr(md5(concat(record_id, type)), 1, 1) IN ('0', '1', '2', '3') THEN 'accepted' ELSE 'open' END AS status FROM i0)"""


def row_issues(rows):
    """Findings about single raw rows, of resolved ones."""
    s = r = rows
    one = lambda df, kind, severity=None, confidence=1.0: df.select(F.col("id").alias("record_id"), F.lit(kind).alias("type"), F.lit("conflict").alias("category"), F.lit(severity).alias("severity") if severity else F.col("severity"), F.lit(confidence).alias("confidence"))
    entity = standardize.entity_findings(r).select(F.col("id").alias("record_id"), "type", F.lit("conflict").alias("category"), F.lit("medium").alias("severity"), F.col("score").alias("confidence"))
    parts = [one(standardize.missing(s), "MISSING_VALUE"), one(standardize.invalid_dates(s), "INVALID_DATE"), one(standardize.invalid_prices(s), "INVALID_PRICE"), one(standardize.unknown_units(s), "UNIT_INCONSISTENCY", None, 0.85), entity]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_status(out)


_GAPS = " + ".join(f"count_if(trim({c}) = '')" for c in RAW)


@query("a08_quality_score", f"""{_SCORE_SQL}, g AS (SELECT greatest(count(*), 1) AS n, {_GAPS} AS gaps FROM raw),
  f AS (SELECT count_if(type = 'MISSING_VALUE' AND status = 'open') AS m, count_if(type IN ('UNIT_INCONSISTENCY', 'INVALID_DATE') AND status = 'open') AS inc, count_if(type IN ('INVALID_PRICE', 'UNKNOWN_ENTITY') AND status = 'open') AS inv, count_if(type = 'ENTITY_MATCH' AND status = 'open') AS mo, count_if(type = 'ENTITY_MATCH' AND status <> 'open') AS md FROM ri),
  s AS (SELECT greatest(0.0, least(1.0, 1 - gaps / (n * 6.0::DOUBLE) - m / n::DOUBLE / 4)) AS c, greatest(0.0, least(1.0, 1 - inc / n::DOUBLE)) AS k, 1.0::DOUBLE AS u, greatest(0.0, least(1.0, 1 - 1.2::DOUBLE * inv / n)) AS v, CASE WHEN mo + md = 0 THEN 0.95 ELSE greatest(0.0, least(1.0, 0.95::DOUBLE - 2 * mo / n::DOUBLE + md / n::DOUBLE)) END AS a FROM g, f)
  SELECT {r4('c')} AS completeness, {r4('k')} AS consistency, u AS uniqueness, {r4('v')} AS validity, {r4('a')} AS ai_confidence, CAST(floor(30 * c + 20 * k + 20 * u + 20 * v + 10 * a + 0.5) AS BIGINT) AS total FROM s""")
def a08(spark, sf):
    rows = written(res(spark, sf))
    return profile.quality(rows, row_issues(rows), RAW)


_COUNTS = "count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status <> 'open') AS resolved, " + ", ".join(f"count(*) FILTER (WHERE status = 'open' AND severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + ", " + ", ".join(f"count(*) FILTER (WHERE status = 'open' AND category = '{c}') AS {c}" for c in ("duplicate", "anomaly", "conflict"))


@query("a09_issue_counts", f"{{rec}}, {ISSUES} SELECT {_COUNTS} FROM iss")
def a09(spark, sf):
    return profile.issue_counts(issues(spark, sf))


@query("q03_pending_types", f"{{rec}}, {ISSUES} SELECT type, count(*) AS n FROM iss WHERE status = 'open' GROUP BY type")
def q03(spark, sf):
    return issues(spark, sf).where("status = 'open'").groupBy("type").agg(F.count("*").alias("n"))


@query("u02_issue_union", f"{{rec}}, {ISSUES} SELECT record_id, type, category, severity, confidence, status FROM iss")
def u02(spark, sf):
    return issues(spark, sf)


@query("j15_trusted_antijoin", f"{{rec}}, {TRUSTED} SELECT id, commodity, market, channel FROM trusted")
def j15(spark, sf):
    return trusted(spark, sf).select("id", "commodity", "market", "channel")


@query("a20_dashboard_split", f"{{std}}, bl AS (SELECT DISTINCT record_id FROM ({_ROW_ISSUES}) WHERE severity IN ('critical', 'high')) SELECT count(*) FILTER (WHERE price > 0 AND record_id IS NULL) AS clean, count(*) FILTER (WHERE price > 0 AND record_id IS NOT NULL) AS held, count(*) FILTER (WHERE price IS NULL OR price <= 0) AS no_price FROM std LEFT JOIN bl ON id = record_id")
def a20(spark, sf):
    rows = written(res(spark, sf))
    blocked = row_issues(rows).where("severity IN ('critical', 'high')").select(F.col("record_id").alias("id"), F.lit(True).alias("blocked")).distinct()
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    return rows.join(blocked, "id", "left").agg(F.count_if(priced & F.col("blocked").isNull()).alias("clean"), F.count_if(priced & F.col("blocked").isNotNull()).alias("held"), F.count_if(~priced).alias("no_price"))


def _med(c):
    return r4(f"quantile_cont(price, 0.5) FILTER (WHERE channel = '{c}')")


@query("a10_trend", f"{{rec}} SELECT date, {_med('farmgate')} AS farmgate, {_med('wholesale')} AS wholesale, {_med('retail')} AS retail, count(DISTINCT market) AS markets FROM rec GROUP BY date")
def a10(spark, sf):
    return analytics.trend(records(spark, sf))


@query("a11_channel_ladder", f"{{rec}}, by0 AS (SELECT commodity, channel, count(*) AS n, quantile_cont(price, 0.5) AS median FROM rec GROUP BY ALL), b AS (SELECT *, lag(median) OVER (PARTITION BY commodity ORDER BY CASE channel WHEN 'farmgate' THEN 0 WHEN 'wholesale' THEN 1 ELSE 2 END) AS before FROM by0) SELECT commodity, channel, n, {r4('median')} AS median, CAST(floor((median - before) / before * 100 + 0.5) AS BIGINT) AS markup, coalesce(median < before, false) AS inverted FROM b")
def a11(spark, sf):
    return analytics.channel_ladder(records(spark, sf))


_MARGINS = f"m AS (SELECT commodity, quantile_cont(price, 0.5) FILTER (WHERE channel = 'farmgate') AS f, quantile_cont(price, 0.5) FILTER (WHERE channel = 'retail') AS r FROM rec GROUP BY commodity), mg AS (SELECT commodity, {r4('f')} AS farmgate, {r4('r')} AS retail, CAST(floor((r - f) / f * 100 + 0.5) AS BIGINT) AS margin FROM m WHERE f IS NOT NULL AND r IS NOT NULL)"


@query("a12_margins_top12", f"{{rec}}, {_MARGINS} SELECT * FROM mg ORDER BY margin DESC, commodity LIMIT 12")
def a12(spark, sf):
    return analytics.margins(records(spark, sf)).orderBy(F.desc("margin"), "commodity").limit(12)


@query("a13_price_map", f"{{rec}} SELECT province, market, {r4('quantile_cont(price, 0.5)')} AS median, count(*) AS n, count(DISTINCT commodity) AS commodities FROM rec GROUP BY GROUPING SETS ((province), (province, market))")
def a13(spark, sf):
    return analytics.price_map(records(spark, sf))


@query("a14_channel_mix", f"{{rec}} SELECT channel, count(*) AS n, {r4('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS share FROM rec GROUP BY channel")
def a14(spark, sf):
    return analytics.channel_mix(records(spark, sf))


FILTERS = {"search": "red", "since": "1996-01-01", "until": "2000-12-31", "channel": "retail", "province": "ASIA"}
_SEARCH = "contains(lower(concat_ws(' ', commodity, market, district, province)), 'red') AND date >= DATE '1996-01-01' AND date <= DATE '2000-12-31'"


@query("a15_facets", f"{{rec}} SELECT 'province' AS dimension, province AS value, count(*) AS n FROM rec WHERE {_SEARCH} AND channel = 'retail' GROUP BY province UNION ALL SELECT 'channel', channel, count(*) FROM rec WHERE {_SEARCH} AND province = 'ASIA' GROUP BY channel UNION ALL SELECT 'commodity', commodity, count(*) FROM rec WHERE {_SEARCH} AND province = 'ASIA' AND channel = 'retail' GROUP BY commodity")
def a15(spark, sf):
    return analytics.facets(records(spark, sf), FILTERS)


@query("p07_priced", "{std} SELECT id, price, channel FROM std WHERE price > 0 AND raw_commodity <> '' AND channel IS NOT NULL")
def p07(spark, sf):
    return anomaly.priced(std(spark, sf).withColumn("commodity", F.col("raw_commodity"))).select("id", "price", "channel")


@query("p08_record_filter", f"{{rec}} SELECT id, commodity, market, date FROM rec WHERE {_SEARCH} AND channel = 'retail' AND province = 'ASIA' AND price >= 500 AND price <= 3000")
def p08(spark, sf):
    return analytics.matching(records(spark, sf), FILTERS | {"least": 500, "most": 3000}).select("id", "commodity", "market", "date")


_CELL = ", ".join(f"{r4(f'''min_by(price, row(NOT corrected, seq, id)) FILTER (WHERE channel = '{c}')''')} AS {c}" for c in ("farmgate", "wholesale", "retail"))
_PIVOT = f"pv AS (SELECT date, province, district, market, commodity, unit, {_CELL}, bool_or(corrected) AS corrected FROM (SELECT *, k % 11 = 0 AS corrected FROM rec) GROUP BY ALL)"


def _pivot(spark, sf):
    return analytics.pivoted(records(spark, sf).withColumn("corrected", F.col("k") % 11 == 0))


@query("a16_trusted_pivot", f"{{rec}}, {_PIVOT} SELECT * FROM pv")
def a16(spark, sf):
    return _pivot(spark, sf)


@query("p09_group_filter", f"{{rec}}, {_PIVOT} SELECT * FROM pv WHERE corrected AND (farmgate BETWEEN 1000 AND 2000 OR wholesale BETWEEN 1000 AND 2000 OR retail BETWEEN 1000 AND 2000)")
def p09(spark, sf):
    return _pivot(spark, sf).where(F.col("corrected") & F.exists(F.array("farmgate", "wholesale", "retail"), lambda x: x.between(1000, 2000)))


@query("o04_page", f"{{rec}}, {_PIVOT} SELECT * FROM pv ORDER BY date DESC, commodity, market, unit LIMIT 50 OFFSET 50")
def o04(spark, sf):
    return _pivot(spark, sf).orderBy(F.desc("date"), "commodity", "market", "unit").offset(50).limit(50)


@query("o01_review_queue", f"{{rec}}, {ISSUES} SELECT record_id, type, severity, confidence FROM iss WHERE status = 'open' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence DESC, record_id, type LIMIT 200")
def o01(spark, sf):
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return issues(spark, sf).where("status = 'open'").orderBy(rank, F.desc("confidence"), "record_id", "type").limit(200).select("record_id", "type", "severity", "confidence")


@query("o06_commodity_frequency", "{rec} SELECT commodity, count(*) AS n, count(DISTINCT market) AS markets FROM rec GROUP BY commodity ORDER BY n DESC")
def o06(spark, sf):
    return records(spark, sf).groupBy("commodity").agg(F.count("*").alias("n"), F.countDistinct("market").alias("markets")).orderBy(F.desc("n"), "commodity")


@query("o12_province_order", f"{{rec}} SELECT province, {r4('quantile_cont(price, 0.5)')} AS median FROM rec GROUP BY province ORDER BY median DESC NULLS LAST")
def o12(spark, sf):
    return median_of(records(spark, sf), ["province"], F.col("price"), "m").select("province", cut(F.col("m")).alias("median")).orderBy(F.desc_nulls_last("median"))


@query("a23_highlights", f"{{rec}}, mm AS (SELECT market, quantile_cont(price, 0.5) AS median FROM rec GROUP BY market), pp AS (SELECT quantile_cont(price, 0.5) AS median FROM rec GROUP BY province) SELECT (SELECT {r4('min(median)')} FROM pp) AS least_province, (SELECT {r4('max(median)')} FROM pp) AS most_province, (SELECT min_by(market, row(median, market)) FROM mm) AS cheapest, (SELECT max_by(market, row(median, market)) FROM mm) AS dearest, (SELECT {r4('quantile_cont(median, 0.5)')} FROM mm) AS middle")
def a23(spark, sf):
    return analytics.highlights(records(spark, sf))


@query("a28_first_unit", "{rec} SELECT commodity, channel, min_by(unit, row(seq, id)) AS unit FROM rec GROUP BY ALL")
def a28(spark, sf):
    return records(spark, sf).groupBy("commodity", "channel").agg(F.min_by("unit", F.struct("seq", "id")).alias("unit"))


@query("a22_label_disambiguation", "SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY n_name) > 1 THEN concat(n_name, ' (', s_name, ')') ELSE n_name END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def a22(spark, sf):
    m = markets(spark, sf)
    shared = m.groupBy("district").agg(F.count("*").alias("n"))
    return m.join(shared, "district").select(F.col("market_key").alias("s_suppkey"), F.when(F.col("n") > 1, F.concat("district", F.lit(" ("), "market", F.lit(")"))).otherwise(F.col("district")).alias("label"))


@query("f20_cosine_topk", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL), cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label),
  s AS (SELECT e.label, vec_id, {r4('sum(v[i] * x) / any_value(n) / sqrt(sum(v[i] * v[i]))')} AS cosine FROM e JOIN c USING (label) JOIN cn USING (label) GROUP BY ALL) SELECT label, vec_id, cosine FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 3""")
def f20(spark, sf):
    """The three vectors of each label nearest to its centre."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    centre = e.groupBy("label", "i").agg(F.avg("x").alias("c"))
    s = e.join(centre, ["label", "i"]).groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("c")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    s = s.select("label", "vec_id", cut(F.col("dot") / F.sqrt("cc") / F.sqrt("xx")).alias("cosine"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id"))).where("n <= 3").drop("n")

"""Robust statistics, outliers, ladder rules and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import anomaly, dedupe
from ..sources.files import written
from .registry import query
from .views import records

STATS = """priced AS (SELECT * FROM rec WHERE price > 0),
  q AS (SELECT commodity, channel, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM priced GROUP BY ALL HAVING count(*) >= 5),
  st AS (SELECT q.*, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, mad FROM q JOIN (SELECT p.commodity, p.channel, quantile_cont(abs(p.price - q.median), 0.5) AS mad FROM priced p JOIN q USING (commodity, channel) GROUP BY ALL) USING (commodity, channel))"""
Z = "floor(0.6745 * (price - median) / (CASE WHEN mad > 0 THEN mad WHEN iqr > 0 THEN 0.6745 * iqr / 1.349 ELSE 0.6745 * greatest(0.05 * median, 1.0) END) * 1e4 + 0.5) / 1e4"
OUTLIERS = STATS + f""",
  zz AS (SELECT p.*, st.median, st.lower, st.upper, {Z} AS z FROM priced p JOIN st USING (commodity, channel)),
  outliers AS (SELECT id, seq, commodity, channel, market, date, price, z, median, (price < lower OR price > upper) AS outside,
    CASE WHEN abs(z) > 8 THEN 'critical' WHEN abs(z) > 5 THEN 'high' ELSE 'medium' END AS severity FROM zz WHERE abs(z) >= 3.5 OR price < lower OR price > upper)"""
LADDER = """lad AS (SELECT date, market, commodity,
    max_by(price, row(seq, id)) FILTER (WHERE channel = 'farmgate') AS farmgate, max_by(id, row(seq, id)) FILTER (WHERE channel = 'farmgate') AS farmgate_id,
    max_by(price, row(seq, id)) FILTER (WHERE channel = 'wholesale') AS wholesale, max_by(id, row(seq, id)) FILTER (WHERE channel = 'wholesale') AS wholesale_id,
    max_by(price, row(seq, id)) FILTER (WHERE channel = 'retail') AS retail, max_by(id, row(seq, id)) FILTER (WHERE channel = 'retail') AS retail_id
    FROM rec WHERE price > 0 GROUP BY ALL),
  viol AS (SELECT date, market, commodity, c AS "check", record_id, (lo - hi) / hi * 100 AS gap FROM (
    SELECT date, market, commodity, 'farmgate>wholesale' AS c, farmgate AS lo, wholesale AS hi, wholesale_id AS record_id FROM lad
    UNION ALL SELECT date, market, commodity, 'wholesale>retail', wholesale, retail, retail_id FROM lad
    UNION ALL SELECT date, market, commodity, 'farmgate>retail', farmgate, retail, retail_id FROM lad) WHERE lo > hi)"""
DUPES = """keyed AS (SELECT *, lower(concat_ws('|', CAST(date AS VARCHAR), market, commodity, channel)) AS key FROM rec),
  dup AS (SELECT k.id, f.id AS original_id, k.price IS NOT DISTINCT FROM f.price AS same FROM
    (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, id) AS n FROM keyed) k JOIN (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, id) = 1) f USING (key) WHERE k.n > 1)"""


def r4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


@query("a01_robust_stats", f"{{rec}}, {STATS} SELECT commodity, channel, n, {r4('median')} AS median, {r4('mad')} AS mad, {r4('q1')} AS q1, {r4('q3')} AS q3, {r4('iqr')} AS iqr, {r4('lower')} AS lower_fence, {r4('upper')} AS upper_fence FROM st")
def a01(spark, sf):
    s = anomaly.robust_stats(written(records(spark, sf)))
    return s.select("commodity", "channel", "n", *(text.r4(F.col(c)).alias(n) for c, n in (("median", "median"), ("mad", "mad"), ("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"), ("lower", "lower_fence"), ("upper", "upper_fence"))))


@query("d15_price_outliers", f"{{rec}}, {OUTLIERS} SELECT id, commodity, channel, {r4('price')} AS price, z, severity, {r4('least(0.99, 0.6 + least(abs(z), 12.0) / 20 + CASE WHEN outside THEN 0.08 ELSE 0.0 END)')} AS confidence, CAST(floor(median + 0.5) AS BIGINT) AS suggestion FROM outliers")
def d15(spark, sf):
    return anomaly.price_outliers(written(records(spark, sf)))


@query("a02_ladder_pivot", f"{{rec}}, {LADDER} SELECT date, market, commodity, {r4('farmgate')} AS farmgate, {r4('wholesale')} AS wholesale, {r4('retail')} AS retail FROM lad")
def a02(spark, sf):
    return anomaly.ladder(records(spark, sf)).select("date", "market", "commodity", *(text.r4(F.col(c)).alias(c) for c in ("farmgate", "wholesale", "retail")))


@query("d16_ladder_violations", f"{{rec}}, {LADDER} SELECT date, market, commodity, \"check\", record_id, {r4('gap')} AS gap, CASE WHEN \"check\" = 'farmgate>retail' THEN 'critical' WHEN gap > 30 THEN 'high' ELSE 'medium' END AS severity, {r4('least(0.99, 0.75 + gap / 200)')} AS confidence FROM viol")
def d16(spark, sf):
    return anomaly.ladder_violations(written(records(spark, sf)))


@query("d17_markup", f"{{rec}}, {LADDER} SELECT date, market, commodity, retail_id AS record_id, {r4('retail / farmgate')} AS ratio, {r4('least(0.99, 0.7 + (retail / farmgate - 3) / 10)')} AS confidence FROM lad WHERE retail / farmgate > 3")
def d17(spark, sf):
    return anomaly.markups(written(records(spark, sf)))


@query("d13_exact_duplicates", f"{{rec}}, {DUPES} SELECT id, original_id, CASE WHEN same THEN 'EXACT_DUPLICATE' ELSE 'PROBABLE_DUPLICATE' END AS type, CASE WHEN same THEN 'high' ELSE 'critical' END AS severity, CASE WHEN same THEN 0.99 ELSE 0.90 END::DOUBLE AS confidence FROM dup")
def d13(spark, sf):
    return dedupe.exact_duplicates(written(records(spark, sf)))


def sim(a: str, b: str) -> str:
    """Name similarity of folded texts in DuckDB."""
    x, y = f"list_distinct(list_filter(string_split({a}, ' '), lambda t: t <> ''))", f"list_distinct(list_filter(string_split({b}, ' '), lambda t: t <> ''))"
    both = f"len(list_intersect({x}, {y}))"
    t = f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({x}) + len({y}) - {both}) END)"
    edit = f"(1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE least(1.0, 0.55::DOUBLE * {edit} + 0.33::DOUBLE * {t} + CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.12::DOUBLE ELSE 0.0 END + CASE WHEN {t} > 0 THEN 0.08::DOUBLE ELSE 0.0 END) END)"


#: Records some of whose names carry an extra word, as near copies do.
TAILED = "tailed AS (SELECT seq, id, CASE WHEN k % 11 <> 0 THEN date END AS date, CASE WHEN k % 29 <> 0 THEN channel END AS channel, price, CASE WHEN k % 7 = 0 THEN concat(commodity, ' x') WHEN k % 97 = 0 THEN NULL ELSE commodity END AS commodity, CASE WHEN k % 89 <> 0 THEN market END AS market FROM rec)"


def tailed(spark, sf):
    k, gone = F.col("k"), F.lit(None)
    named = F.when(k % 7 == 0, F.concat("commodity", F.lit(" x"))).when(k % 97 == 0, gone).otherwise(F.col("commodity"))
    return records(spark, sf).withColumns({"commodity": named, **{c: F.when(k % n != 0, F.col(c)) for c, n in (("date", 11), ("channel", 29), ("market", 89))}})


_NB = f"nb AS (SELECT a, b, score FROM (SELECT x.commodity AS a, y.commodity AS b, {r4(sim('x.commodity', 'y.commodity'))} AS score FROM (SELECT DISTINCT commodity FROM tailed WHERE commodity IS NOT NULL) x, (SELECT DISTINCT commodity FROM tailed WHERE commodity IS NOT NULL) y) WHERE score >= 0.82)"


@query("j08_name_neighbours", f"{{rec}}, {TAILED}, {_NB} SELECT * FROM nb")
def j08(spark, sf):
    return dedupe.name_neighbours(tailed(spark, sf).select(F.col("commodity").alias("name")))


@query(
    "d14_near_duplicates",
    f"""{{rec}}, {TAILED}, {_NB}, full0 AS (SELECT seq, id, coalesce(CAST(date AS VARCHAR), '') AS date, coalesce(channel, '') AS channel, coalesce(commodity, '') AS commodity, coalesce(market, '') AS market FROM tailed),
  mk AS (SELECT DISTINCT market FROM full0), forms AS (SELECT market, trim(regexp_replace(lower(market), '[^a-z0-9]+', ' ', 'g')) AS form FROM mk),
  mw AS (SELECT market, form, unnest(string_split(form, ' ')) AS w FROM forms),
  mnb AS (SELECT a, b, score FROM (SELECT DISTINCT x.market AS a, y.market AS b, {r4(sim('x.form', 'y.form'))} AS score FROM mw x JOIN mw y USING (w)) WHERE score >= 0.82),
  keyed AS (SELECT *, lower(concat_ws('|', date, market, commodity, channel)) AS key FROM full0),
  firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, id) = 1),
  pairs AS (SELECT x.id, y.id AS original_id, y.seq AS s2, (nb.score + mnb.score) / 2 AS score FROM firsts x JOIN nb ON nb.a = x.commodity JOIN mnb ON mnb.a = x.market
    JOIN firsts y ON y.date = x.date AND y.channel = x.channel AND y.commodity = nb.b AND y.market = mnb.b WHERE NOT (x.commodity = y.commodity AND x.market = y.market) AND (y.seq, y.id) < (x.seq, x.id)),
  best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY s2, original_id) = 1)
  SELECT id, original_id, {r4('score')} AS score, CASE WHEN score >= 0.92 THEN 'PROBABLE_DUPLICATE' ELSE 'POSSIBLE_DUPLICATE' END AS type, CASE WHEN score >= 0.92 THEN 'medium' ELSE 'low' END AS severity FROM best""",
)
def d14(spark, sf):
    return dedupe.near_duplicates(written(tailed(spark, sf)))

"""Features, forest and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import r4 as cut
from ..operators import anomaly, evaluate, features, forest, match
from ..sources.files import written
from . import analyze
from .q_entities import SCORES
from .q_rules import LADDER, OUTLIERS, r4
from .registry import query
from .views import commodities, markets, raw_records, records

_LN = "ln(greatest({0}, 1e-6::DOUBLE))"


def _own(c: str) -> str:
    return f"CASE WHEN channel = '{c}' THEN price ELSE {c} END"


_FEATURES = f"""{LADDER},
  q3 AS (SELECT commodity, channel, count(*) AS peers, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM rec WHERE price > 0 GROUP BY ALL HAVING count(*) >= 3),
  ps AS (SELECT q3.*, mad FROM q3 JOIN (SELECT commodity, channel, quantile_cont(abs(price - median), 0.5) AS mad FROM rec JOIN q3 USING (commodity, channel) WHERE price > 0 GROUP BY ALL) USING (commodity, channel)),
  b0 AS (SELECT rec.*, peers, median, iqr, mad, coalesce(price / median, 1.0) AS r FROM rec LEFT JOIN ps USING (commodity, channel) WHERE price > 0),
  typ AS (SELECT coalesce(quantile_cont({_LN.format('retail / farmgate')}, 0.5), ln(1.3::DOUBLE)) AS trf, coalesce(quantile_cont({_LN.format('wholesale / farmgate')}, 0.5), ln(1.1::DOUBLE)) AS twf, coalesce(quantile_cont({_LN.format('retail / wholesale')}, 0.5), ln(1.1::DOUBLE)) AS trw FROM lad),
  b1 AS (SELECT b0.*, mr, pr, farmgate, wholesale, retail, trf, twf, trw FROM b0 LEFT JOIN (SELECT market, quantile_cont(r, 0.5) AS mr FROM b0 GROUP BY market) USING (market) LEFT JOIN (SELECT province, quantile_cont(r, 0.5) AS pr FROM b0 GROUP BY province) USING (province) LEFT JOIN lad USING (date, market, commodity), typ),
  ft AS (SELECT id, {_LN.format('r')} AS ratio, coalesce(greatest(-8.0, least(8.0, 0.6745 * (price - median) / (CASE WHEN mad > 0 THEN mad WHEN iqr > 0 THEN 0.6745 * iqr / 1.349 ELSE 0.6745 * greatest(0.05 * median, 1.0) END))), 0.0) AS z,
    {_LN.format('r / mr')} AS market_residual, {_LN.format('r / pr')} AS province_residual, CASE channel WHEN 'farmgate' THEN 0.0 WHEN 'wholesale' THEN 1.0 ELSE 2.0 END::DOUBLE AS channel_code,
    coalesce(CASE WHEN channel IN ('retail', 'farmgate') THEN ln(greatest(({_own('retail')}) / ({_own('farmgate')}), CASE WHEN ({_own('retail')}) / ({_own('farmgate')}) IS NOT NULL THEN 1e-6::DOUBLE END)) END, trf) AS retail_farm,
    coalesce(CASE WHEN channel IN ('wholesale', 'farmgate') THEN ln(({_own('wholesale')}) / ({_own('farmgate')})) END, twf) AS wholesale_farm, coalesce(CASE WHEN channel IN ('retail', 'wholesale') THEN ln(({_own('retail')}) / ({_own('wholesale')})) END, trw) AS retail_wholesale FROM b1)"""


@query("m04_price_features", f"{{rec}}, {_FEATURES} SELECT id, " + ", ".join(f"{r4(c)} AS {c}" for c in features.NAMES) + " FROM ft")
def m04(spark, sf):
    return features.price_features(written(records(spark, sf))).select("id", *(cut(F.col(c)).alias(c) for c in features.NAMES))


def _vectors(spark, sf):
    """What a forest needs of each row: its id and features."""
    return features.price_features(written(records(spark, sf).drop("district", "unit", "k"))).select("id", *features.NAMES)


@query("m06_forest_scores")
def m06(spark, sf):
    _, scored = forest.fitted(written(_vectors(spark, sf)), keep=("id",))
    return scored.select("id", cut(F.col("score")).alias("score"))


@query("m08_forest_issues")
def m08(spark, sf):
    rec = written(records(spark, sf))
    f = written(features.price_features(rec))
    model, scored = forest.fitted(f)
    return forest.findings(scored, model, anomaly.price_outliers(rec))


@query("m08_merge_evidence", f"""{{rec}}, {OUTLIERS}, kn AS (SELECT id, severity, confidence, CAST(floor(median + 0.5) AS BIGINT) AS suggestion, k FROM (SELECT *, {r4('least(0.99, 0.6 + least(abs(z), 12.0) / 20 + CASE WHEN outside THEN 0.08 ELSE 0.0 END)')} AS confidence, CASE WHEN abs(z) > 8 THEN 'critical' WHEN abs(z) > 5 THEN 'high' ELSE 'medium' END AS severity FROM outliers) JOIN (SELECT id, k FROM rec) USING (id))
  SELECT id, severity, CASE WHEN k % 3 = 0 THEN least(0.99, greatest(confidence, 0.7 + (k % 30) / 100.0)) ELSE confidence END AS confidence, suggestion, 'z' || CASE WHEN k % 3 = 0 THEN ',forest=' || CAST(k % 30 AS VARCHAR) || ',signal=ratio' ELSE '' END AS evidence, 'known' AS origin FROM kn
  UNION ALL SELECT id, 'medium', 0.7 + (k % 30) / 100.0, NULL, 'forest=' || CAST(k % 30 AS VARCHAR) || ',signal=ratio', 'forest' FROM rec WHERE k % 53 = 0 AND id NOT IN (SELECT id FROM kn)""")
def m08_merge_evidence(spark, sf):
    """Outliers merged with stored findings of a forest, here of every third outlier and every 53rd other record."""
    rec = written(records(spark, sf))
    known = anomaly.price_outliers(rec)
    priced = known.withColumn("evidence", F.array(F.struct(F.lit("z").alias("label"), F.lit(None).cast("string").alias("value"))))
    marks = rec.join(known.select("id", F.lit(True).alias("known")), "id", "left")
    stored = marks.where((F.col("known") & (F.col("k") % 3 == 0)) | (F.col("known").isNull() & (F.col("k") % 53 == 0))).select(
        "id", (F.col("k") % 30).alias("score"), F.when(F.col("known"), "corroborated").otherwise("new").alias("effect"), F.lit("ratio").alias("reason"), F.lit("medium").alias("severity"), (0.7 + (F.col("k") % 30) / 100).alias("confidence"), F.lit(None).cast("long").alias("suggestion"),
    )
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e.label, e.value)), ",")
    return forest.merged(priced, stored).withColumn("evidence", told)


_INJECTED = """inj0 AS (SELECT rec.*, f.farmgate, CASE WHEN k % 97 = 0 THEN (k // 97) % 4 END AS turn FROM rec LEFT JOIN (SELECT date, market, commodity, max_by(price, row(seq, id)) FILTER (WHERE channel = 'farmgate') AS farmgate FROM rec WHERE price > 0 GROUP BY ALL) f USING (date, market, commodity)),
  inj AS (SELECT * EXCLUDE (price, turn, farmgate), CASE WHEN turn = 0 THEN 'times_ten' WHEN turn = 1 THEN 'tenth' WHEN turn = 2 THEN 'plus_60' WHEN turn = 3 AND channel = 'retail' AND farmgate IS NOT NULL THEN 'inverted' END AS kind,
    CASE WHEN turn = 0 THEN price * 10 WHEN turn = 1 THEN price / 10 WHEN turn = 2 THEN price * 1.6::DOUBLE WHEN turn = 3 AND channel = 'retail' AND farmgate IS NOT NULL THEN farmgate * 0.7::DOUBLE ELSE price END AS price FROM inj0)"""


@query("m10_injection_recall", f"{{rec}}, {_INJECTED}, {OUTLIERS.replace('FROM rec', 'FROM inj')}, {LADDER.replace('FROM rec', 'FROM inj')}, sc AS (SELECT kind, CASE WHEN id IN (SELECT id FROM outliers) THEN 1.0 ELSE 0.0 END::DOUBLE AS s, CASE WHEN id IN (SELECT record_id FROM viol) THEN 1.0 ELSE 0.0 END::DOUBLE AS l FROM inj) SELECT kind, count(*) AS n, {r4('avg(s)')} AS statistics, {r4('avg(l)')} AS ladder, {r4('avg(greatest(s, l))')} AS either FROM sc GROUP BY kind")
def m10(spark, sf):
    return evaluate.recall(written(records(spark, sf)))


@query("k05_model_roundtrip")
def k05(spark, sf):
    """Scores by a model that was stored and loaded."""
    f = written(_vectors(spark, sf))
    return forest.score(f, forest.from_json(forest.to_json(forest.train(f)))).select("id", cut(F.col("score")).alias("score"))


@query("m09_whole_analysis")
def m09(spark, sf):
    """Findings by type, from raw cells through all layers."""
    a = analyze.analyze(raw_records(spark, sf), commodities(spark, sf), markets(spark, sf))
    return a.issues.groupBy("type", "severity").agg(F.count("*").alias("n"))


_MISSPELT = "miss AS (SELECT commodity AS want, concat(substr(commodity, 1, 2), substr(commodity, 4)) AS name, 'drop' AS kind FROM cat UNION ALL SELECT commodity, concat(substr(commodity, 1, 1), substr(commodity, 3, 1), substr(commodity, 2, 1), substr(commodity, 4)), 'swap' FROM cat UNION ALL SELECT commodity, concat(commodity, ' x'), 'tail' FROM cat)"


@query("m11_match_accuracy", f"{{std}}, {SCORES.replace('SELECT DISTINCT commodity_form AS name FROM std', 'SELECT DISTINCT name FROM miss').replace('forms AS', _MISSPELT + ', forms AS', 1)} SELECT kind, count(*) AS n, {r4('avg(CASE WHEN c.owner = want THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS top1 FROM miss LEFT JOIN (SELECT * FROM cand WHERE rank = 1) c USING (name) GROUP BY kind")
def m11(spark, sf):
    """Share of misspelt catalog names whose best owner is the right one, by kind of mistake."""
    c = F.col("commodity")
    part = lambda a, b=None: F.substring(c, a, b or 1_000_000)
    kinds = {"drop": F.concat(part(1, 2), part(4)), "swap": F.concat(part(1, 1), part(3, 1), part(2, 1), part(4)), "tail": F.concat(c, F.lit(" x"))}
    catalog = commodities(spark, sf)
    miss = catalog.select(c.alias("want"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("name")) for k, e in kinds.items()))))
    best = match.candidates(match.fuzzy_scores(miss.select("name"), match.forms(catalog)), 1).select("name", "owner")
    right = F.when(F.col("owner") == F.col("want"), 1.0).otherwise(0.0)
    return miss.join(best, "name", "left").groupBy("kind").agg(F.count("*").alias("n"), cut(F.avg(right)).alias("top1"))

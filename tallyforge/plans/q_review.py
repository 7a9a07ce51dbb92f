"""Review: edits, decisions, rechecks, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, review
from . import q_analytics
from ..sources.files import written
from .q_analytics import ISSUES
from .q_entities import std
from .q_rules import DUPES, LADDER, OUTLIERS, r4
from .registry import query
from .views import raw_records, records

#: Synthetic events by k: prices edited once or twice, units once; some rows deleted; some findings decided on.
_EDITS_SQL = """ed AS (SELECT id, 'raw_price' AS field, '100' AS value, 1 AS ts FROM raw WHERE k % 13 = 0 UNION ALL SELECT id, 'raw_price', '250.50', 2 FROM raw WHERE k % 26 = 0 UNION ALL SELECT id, 'raw_unit', 'kg', 3 FROM raw WHERE k % 17 = 0),
  le AS (SELECT id, field, max_by(value, ts) AS value FROM ed GROUP BY ALL),
  cur AS (SELECT raw.* REPLACE (coalesce(p.value, raw_price) AS raw_price, coalesce(u.value, raw_unit) AS raw_unit), p.id IS NOT NULL OR u.id IS NOT NULL AS corrected FROM raw LEFT JOIN (SELECT * FROM le WHERE field = 'raw_price') p USING (id) LEFT JOIN (SELECT * FROM le WHERE field = 'raw_unit') u USING (id) WHERE k % 101 <> 0)"""


def edits(spark, sf):
    raw = raw_records(spark, sf)
    made = [(13, "raw_price", "100", 1), (26, "raw_price", "250.50", 2), (17, "raw_unit", "kg", 3)]
    parts = [raw.where(F.col("k") % n == 0).select("id", F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(at).alias("at"), F.lit("human").alias("via")) for n, f, v, at in made]
    return parts[0].union(parts[1]).union(parts[2])


@query("r02_current_state", f"{{raw}}, {_EDITS_SQL} SELECT id, raw_price, raw_unit, corrected FROM cur")
def r02(spark, sf):
    raw = raw_records(spark, sf)
    return review.current(raw, edits(spark, sf), raw.where("k % 101 = 0")).select("id", "raw_price", "raw_unit", "corrected")


_TOUCHED = "edited AS (SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN price * 3 ELSE price END AS price) FROM rec)"


@query("r03_ladder_recheck", f"{{rec}}, {_TOUCHED}, {LADDER.replace('FROM rec', 'FROM edited')} SELECT record_id, \"check\", {r4('gap')} AS gap FROM viol WHERE (date, market, commodity) IN (SELECT (date, market, commodity) FROM rec WHERE k % 13 = 0)")
def r03(spark, sf):
    rec = records(spark, sf)
    edited = rec.withColumn("price", F.when(F.col("k") % 13 == 0, F.col("price") * 3).otherwise(F.col("price")))
    return review.rechecked_ladder(edited, rec.where("k % 13 = 0")).select("record_id", "check", "gap")


@query("r04_confirm_suggestions", f"{{rec}}, {OUTLIERS} SELECT id, 'raw_price' AS field, CAST(CAST(floor(median + 0.5) AS BIGINT) AS VARCHAR) AS value, 'ai' AS via FROM outliers WHERE {r4('least(0.99, 0.6 + least(abs(z), 12.0) / 20 + CASE WHEN outside THEN 0.08 ELSE 0.0 END)')} >= 0.9")
def r04(spark, sf):
    return review.confirmed(anomaly.price_outliers(written(records(spark, sf))), 0.9)


_KEEP = "NOT ((type IN ('MISSING_VALUE', 'INVALID_PRICE', 'LADDER_VIOLATION') AND severity = 'critical') OR type = 'INVALID_DATE')"


@query("r05_keep_rules", f"{{rec}}, {ISSUES} SELECT record_id, type, severity, {_KEEP} AS keepable FROM iss")
def r05(spark, sf):
    return review.can_keep(q_analytics.issues(spark, sf)).select("record_id", "type", "severity", "keepable")


_DECIDED = f"""decisions AS (SELECT record_id, type, 'accepted' AS decision, 1 AS ts FROM iss WHERE substr(record_id, 1, 1) IN ('a', 'b', 'c') UNION ALL SELECT record_id, type, 'corrected', 2 FROM iss WHERE substr(record_id, 1, 1) = 'c'),
  ld AS (SELECT record_id, type, max_by(decision, ts) AS decision FROM decisions GROUP BY ALL),
  dec AS (SELECT i.* REPLACE (CASE WHEN decision IS NULL THEN status WHEN decision = 'accepted' AND NOT ({_KEEP}) THEN 'open' ELSE decision END AS status) FROM iss i LEFT JOIN ld USING (record_id, type))"""


def decided(spark, sf, rec=None):
    found = written(q_analytics.issues(spark, sf, rec))
    first = F.substring("record_id", 1, 1)
    made = found.where(first.isin("a", "b", "c")).select("record_id", "type", F.lit("accepted").alias("decision"), F.lit(1).alias("at"))
    made = made.union(found.where(first == "c").select("record_id", "type", F.lit("corrected"), F.lit(2)))
    return review.decided(found, made)


@query("r07_recheck_decisions", f"{{rec}}, {ISSUES}, {_DECIDED} SELECT record_id, type, severity, status FROM dec")
def r07(spark, sf):
    return decided(spark, sf).select("record_id", "type", "severity", "status")


@query("r08_publish", f"{{rec}}, {ISSUES}, {_DECIDED} SELECT id, commodity, market, channel, {r4('price')} AS price, id IN (SELECT record_id FROM dec WHERE status = 'corrected') AS corrected FROM rec WHERE id NOT IN (SELECT record_id FROM dec WHERE status = 'open' AND severity IN ('critical', 'high'))")
def r08(spark, sf):
    rec = written(records(spark, sf))
    found = written(decided(spark, sf, rec))
    blocked = found.where("status = 'open' AND severity IN ('critical', 'high')").select(F.col("record_id").alias("id"))
    fixed = found.where("status = 'corrected'").select(F.col("record_id").alias("id"), F.lit(True).alias("corrected")).distinct()
    out = rec.join(blocked, "id", "left_anti").join(fixed, "id", "left")
    return out.select("id", "commodity", "market", "channel", (F.floor(F.col("price") * 1e4 + 0.5) / 1e4).alias("price"), F.coalesce("corrected", F.lit(False)).alias("corrected"))


@query("a18_row_states", f"{{rec}}, {ISSUES}, st0 AS (SELECT record_id, CASE WHEN bool_or(status = 'open' AND severity IN ('critical', 'high')) THEN 'error' WHEN bool_or(status = 'open') THEN 'warning' ELSE 'valid' END AS state FROM iss GROUP BY record_id) SELECT state, count(*) AS n FROM st0 GROUP BY state")
def a18(spark, sf):
    return review.row_states(q_analytics.issues(spark, sf)).groupBy("state").agg(F.count("*").alias("n"))


@query("a19_grouped_findings", f"{{rec}}, {ISSUES}, f AS (SELECT i.type, i.severity, r.market, r.commodity FROM iss i JOIN rec r ON r.id = i.record_id) SELECT type, severity, market, commodity, count(*) AS members FROM f GROUP BY ALL")
def a19(spark, sf):
    rec = written(records(spark, sf))
    where = rec.select(F.col("id").alias("record_id"), "market", "commodity")
    return q_analytics.issues(spark, sf, rec).join(where, "record_id").groupBy("type", "severity", "market", "commodity").agg(F.count("*").alias("members"))


@query("a17_validation_groups")
def a17(spark, sf):
    rows = std(spark, sf).select("seq", "id", "date", F.col("raw_market").alias("market"), F.col("raw_commodity").alias("commodity"), "unit", "channel")
    return review.price_groups(rows)


@query("j18_surviving_issues", f"{{rec}}, {DUPES} SELECT d.id, d.original_id FROM dup d WHERE d.id IN (SELECT id FROM rec WHERE k % 101 <> 0)")
def j18(spark, sf):
    from ..operators import dedupe

    rec = written(records(spark, sf))
    return dedupe.exact_duplicates(rec).join(rec.where("k % 101 <> 0").select("id"), "id", "left_semi").select("id", "original_id")

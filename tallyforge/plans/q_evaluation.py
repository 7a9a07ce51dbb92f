"""Calibration of name matching, and injected price errors through all layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, evaluate, match
from ..sources.files import written
from .q_entities import FOLD, FORMS, _model
from .q_rules import LADDER, OUTLIERS, r4, sim
from .registry import query
from .views import commodities, records, table


def _picked(salt: str, n: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat(s, '{salt}')), 1, 4)) AS INTEGER) % {n})"


def _doubles(values: tuple[float, ...]) -> str:
    return f"unnest([{', '.join(map(str, values))}]::DOUBLE[])"


_MISSPELT = f"""sp0 AS (SELECT commodity AS s, 1 + {_picked('drop', 'greatest(length(commodity) - 2, 1)')} AS d, 1 + {_picked('swap', 'greatest(length(commodity) - 3, 1)')} AS w, list_filter(range(2, length(commodity) + 1), lambda p: lower(substr(commodity, p, 1)) IN ('a', 'e', 'i', 'o', 'u')) AS ps FROM cat),
  sp AS (SELECT *, ps[1 + {_picked('vowel', 'greatest(len(ps), 1)')}] AS v FROM sp0),
  miss AS (SELECT s AS want, 'as it is' AS kind, s AS raw FROM sp UNION ALL SELECT s, 'drop', CASE WHEN length(s) < 2 THEN s ELSE substr(s, 1, d) || substr(s, d + 2) END FROM sp
    UNION ALL SELECT s, 'swap', CASE WHEN length(s) < 4 THEN s ELSE substr(s, 1, w) || substr(s, w + 2, 1) || substr(s, w + 1, 1) || substr(s, w + 3) END FROM sp
    UNION ALL SELECT s, 'vowel', CASE WHEN len(ps) = 0 THEN s || 'a' ELSE substr(s, 1, v - 1) || translate(lower(substr(s, v, 1)), 'aeiou', 'eioua') || substr(s, v + 1) END FROM sp
    UNION ALL SELECT s, 'spacing', '  ' || replace(upper(s), ' ', '  ') || ' ' FROM sp)"""
_FOREIGN = "foreigners AS (SELECT n_name AS raw FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer)"
_JUDGED = f"""{{std}}, {FORMS.split(', names AS')[0]}, {_MISSPELT}, {_FOREIGN},
  cases AS (SELECT grp, kind, want, {FOLD.format('raw')} AS name FROM (SELECT 'misspelt' AS grp, kind, want, raw FROM miss UNION ALL SELECT 'phrased', 'plural', s, s || 's' FROM sp UNION ALL SELECT 'phrased', 'qualified', s, 'fresh ' || s FROM sp UNION ALL SELECT 'foreign', 'none', NULL, raw FROM foreigners)),
  ex AS (SELECT name, count(DISTINCT owner) AS owners FROM (SELECT DISTINCT name FROM cases) JOIN forms ON name = form GROUP BY name), rest AS (SELECT DISTINCT name FROM cases WHERE name NOT IN (SELECT name FROM ex)),
  so AS (SELECT name, owner, coalesce(max(s) FILTER (WHERE alias = 0), 0.0) AS own, coalesce(max(s) FILTER (WHERE alias > 0), 0.0) * 0.99::DOUBLE AS other FROM (SELECT name, owner, alias, {sim('name', 'form')} AS s FROM rest, forms) GROUP BY ALL),
  fz AS (SELECT * FROM (SELECT name, owner, {r4('CASE WHEN other > own THEN least(1.0, other + 0.05::DOUBLE) ELSE own END')} AS score FROM so) WHERE score >= 0.4),
  top AS (SELECT name, owner, score, coalesce(score >= 0.5 AND score - lead(score) OVER w < 0.02, false) AS tie FROM fz WINDOW w AS (PARTITION BY name ORDER BY score DESC, owner) QUALIFY row_number() OVER w = 1),
  {_model('q', 'rest', 'forms')},
  own AS (SELECT name, owner, max(c) AS own FROM (SELECT name, form, {r4('sum(w * v)')} AS c FROM qwn JOIN qwc USING (gram) GROUP BY ALL) JOIN (SELECT DISTINCT owner, form FROM forms) USING (form) GROUP BY ALL),
  near AS (SELECT r.name, t.score AS first, coalesce(t.tie, false) AS tie, model, cosine, CASE WHEN model = t.owner THEN {r4('greatest(t.score, 0.5::DOUBLE * t.score + 0.5::DOUBLE * cosine)')} ELSE coalesce(t.score, 0.0) END AS score, CASE WHEN model <> t.owner THEN {r4('cosine - coalesce(own, 0.0)')} END AS dissent
    FROM rest r LEFT JOIN top t USING (name) LEFT JOIN (SELECT name, model, cosine FROM qtb WHERE name NOT IN (SELECT name FROM top WHERE score >= 0.92)) q ON q.name = r.name LEFT JOIN own o ON o.name = r.name AND o.owner = t.owner),
  found AS (SELECT grp, kind, c.name, c.want, CASE WHEN owners IS NOT NULL THEN 1.0 ELSE coalesce(n.score, 0.0) END::DOUBLE AS score, CASE WHEN owners IS NOT NULL THEN owners > 1 ELSE coalesce(n.tie, false) END AS tie,
    CASE WHEN owners IS NOT NULL THEN f.form IS NOT NULL ELSE coalesce(n.first - z.score < 0.02, false) END AS right_, dissent, cosine, coalesce(model = c.want, false) AS model_right
    FROM cases c LEFT JOIN ex USING (name) LEFT JOIN near n ON n.name = c.name LEFT JOIN (SELECT DISTINCT form, owner FROM forms) f ON f.form = c.name AND f.owner = c.want LEFT JOIN fz z ON z.name = c.name AND z.owner = c.want),
  rv AS (SELECT floor(least(0.8, greatest(0.4, max(score) + 0.02::DOUBLE)) * 100 + 0.5) / 100 AS review, greatest(0.75, coalesce(max(cosine), 0) + 0.02::DOUBLE) AS line_floor FROM found WHERE want IS NULL)"""
_SWEPT = f""",
  tried AS (SELECT f.*, margin, NOT tie AND NOT coalesce(dissent >= margin, false) AND score >= review AS free FROM found f, rv, (SELECT {_doubles(calibrate.MARGINS)} AS margin) WHERE want IS NOT NULL),
  clean AS (SELECT margin, min(step) AS accept FROM (SELECT margin, step FROM tried, (SELECT {_doubles(calibrate.ACCEPTS)} AS step) WHERE free AND score >= step GROUP BY ALL HAVING count(*) FILTER (WHERE NOT right_) = 0) GROUP BY margin),
  swept AS (SELECT margin, coalesce(any_value(accept), 0.9::DOUBLE) AS accept, count(*) FILTER (WHERE free AND score >= coalesce(accept, 0.9) AND NOT right_) AS wrong, count(*) FILTER (WHERE grp = 'misspelt' AND score >= review AND NOT (free AND score >= coalesce(accept, 0.9))) AS reviews FROM tried LEFT JOIN clean USING (margin), rv GROUP BY margin),
  lined AS (SELECT line FROM (SELECT line, sum(CASE WHEN model_right THEN 1 ELSE -1 END) AS gain FROM found, rv, (SELECT {_doubles(calibrate.LINES)} AS line) WHERE want IS NOT NULL AND score < review AND line >= line_floor AND cosine >= line GROUP BY line) WHERE gain > 0 ORDER BY gain DESC, line LIMIT 1)"""


def cases(spark, sf) -> DataFrame:
    """Catalog names misspelt, in the plural and qualified; and names of nations, regions and segments, of which the catalog has no word."""
    catalog = commodities(spark, sf)
    name = F.col("commodity")
    wrong = calibrate.misspelt(catalog, "commodity").select(F.lit("misspelt").alias("group"), "kind", "want", "raw")
    phrased = catalog.select(F.lit("phrased").alias("group"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), name.alias("want"), e.alias("raw")) for k, e in {"plural": F.concat(name, F.lit("s")), "qualified": F.concat(F.lit("fresh "), name)}.items()))))
    sources = (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))
    foreign = None
    for source, column in sources:
        more = table(spark, sf, source).select(F.col(column).alias("raw"))
        foreign = more if foreign is None else foreign.union(more)
    none = F.lit(None).cast("string")
    return wrong.unionByName(phrased).unionByName(foreign.distinct().select(F.lit("foreign").alias("group"), F.lit("none").alias("kind"), none.alias("want"), "raw"))


def _found(spark, sf) -> DataFrame:
    return written(calibrate.judged(cases(spark, sf), match.forms(commodities(spark, sf))))


@query("m11_threshold_curve", f"{_JUDGED} SELECT margin, score, CAST(sum(r) OVER w AS BIGINT) AS rights, CAST(sum(x) OVER w AS BIGINT) AS wrongs FROM (SELECT margin, score, count(*) FILTER (WHERE right_) AS r, count(*) FILTER (WHERE NOT right_) AS x FROM found, rv, (SELECT {_doubles(calibrate.MARGINS)} AS margin) WHERE want IS NOT NULL AND score >= review AND NOT tie AND NOT coalesce(dissent >= margin, false) GROUP BY ALL) WINDOW w AS (PARTITION BY margin ORDER BY score DESC)")
def m11_curve(spark, sf):
    """Cases accepted rightly and wrongly by margin and least score accepted."""
    found = _found(spark, sf)
    return calibrate.curve(found, calibrate.review_bound(found))


@query("m11_calibration", f"{_JUDGED}{_SWEPT} SELECT margin, accept, wrong, reviews, review, (SELECT line FROM lined) AS suggest, row_number() OVER (ORDER BY wrong, reviews, margin DESC) = 1 AS chosen FROM swept, rv")
def m11_calibration(spark, sf):
    """Every margin with its bounds; chosen marks the one that calibration takes."""
    found = _found(spark, sf)
    limits = calibrate.calibrate(found)
    rows = calibrate.sweep(found, limits.review, match.Thresholds().accept)
    return rows.select("*", F.lit(limits.review).alias("review"), F.lit(limits.suggest).cast("double").alias("suggest"), (F.col("margin") == limits.veto).alias("chosen"))


@query("m11_calibrated_report", f"""{_JUDGED}{_SWEPT},
  best AS (SELECT * FROM swept ORDER BY wrong, reviews, margin DESC LIMIT 1),
  st AS (SELECT *, CASE WHEN rescued THEN model_right ELSE right_ END AS ok, CASE WHEN score >= review AND score >= accept AND NOT tie AND NOT coalesce(dissent >= margin, false) THEN 'auto' WHEN score < review AND NOT rescued THEN 'unknown' ELSE 'review' END AS status FROM (SELECT *, coalesce(score < review AND cosine >= (SELECT line FROM lined), false) AS rescued FROM found, rv, best))
  SELECT grp AS "group", kind, count(*) AS n, {r4('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS top1, {r4("avg(CASE WHEN status = 'auto' THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS accepted, count(*) FILTER (WHERE status = 'auto' AND NOT ok) AS wrong, {r4("avg(CASE WHEN status = 'review' THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS review, {r4("avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (WHERE status = 'review')")} AS review_right, {r4("avg(CASE WHEN status = 'unknown' THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS unknown FROM st GROUP BY ALL""")
def m11_report(spark, sf):
    """What the calibrated bounds make of each kind of case."""
    found = _found(spark, sf)
    return calibrate.report(found, calibrate.calibrate(found))


def _drawn(parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {parts})), 1, 7)) AS BIGINT)"


_ROUNDS = f"""cp AS (SELECT rec.*, CAST(round AS INTEGER) AS round, {_drawn("round, strftime(date, '%Y-%m-%d'), market, commodity")} AS draw FROM rec, range(1, {evaluate.ROUNDS + 1}) t(round) WHERE price > 0 AND commodity <> '' AND channel <> '' AND market <> ''),
  hs AS (SELECT *, CASE WHEN farm IS NOT NULL AND retail_id IS NOT NULL THEN draw // {evaluate.ONE_IN} % 4 ELSE draw // {evaluate.ONE_IN} % 3 END AS turn FROM (SELECT round, date, market, commodity, any_value(draw) AS draw, min_by(id, row({_drawn('round, id')}, id)) AS some_id, max_by(price, row(seq, id)) FILTER (WHERE channel = 'farmgate') AS farm, max_by(id, row(seq, id)) FILTER (WHERE channel = 'retail') AS retail_id FROM cp WHERE draw % {evaluate.ONE_IN} = 0 GROUP BY ALL)),
  mixed AS (SELECT round || '|' || id AS id, seq, date, round || '|' || market AS market, round || '|' || commodity AS commodity, channel, CASE turn WHEN 0 THEN 'times_ten' WHEN 1 THEN 'tenth' WHEN 2 THEN 'plus_60' WHEN 3 THEN 'inverted' END AS kind,
    CASE WHEN id = CASE WHEN turn = 3 THEN retail_id ELSE some_id END THEN CASE turn WHEN 0 THEN price * 10 WHEN 1 THEN price / 10 WHEN 2 THEN price * 1.6::DOUBLE ELSE farm * 0.7::DOUBLE END ELSE price END AS price FROM cp LEFT JOIN hs USING (round, date, market, commodity))"""


@query("m10_layer_recall", f"""{{rec}}, {_ROUNDS}, {OUTLIERS.replace('FROM rec', 'FROM mixed')}, {LADDER.replace('FROM rec', 'FROM mixed')},
  fl AS (SELECT id, 'statistics' AS layer FROM outliers UNION SELECT record_id, 'ladder' FROM viol UNION SELECT id, 'all' FROM outliers UNION SELECT record_id, 'all' FROM viol),
  un AS (SELECT id, kind, CASE WHEN kind IS NULL THEN id ELSE concat_ws('|', date, market, commodity) END AS unit FROM mixed),
  ea AS (SELECT t.kind, t.layer, n, coalesce(hits, 0) AS hits FROM (SELECT kind, count(DISTINCT unit) AS n, unnest(['statistics', 'ladder', 'all']) AS layer FROM un GROUP BY kind) t LEFT JOIN (SELECT kind, layer, count(DISTINCT unit) AS hits FROM un JOIN fl USING (id) GROUP BY ALL) h ON h.kind IS NOT DISTINCT FROM t.kind AND h.layer = t.layer)
  SELECT kind, layer, n, {r4('hits / CAST(n AS DOUBLE)')} AS share FROM ea UNION ALL SELECT 'any', layer, CAST(sum(n) AS BIGINT), {r4('sum(hits) / CAST(sum(n) AS DOUBLE)')} FROM ea WHERE kind IS NOT NULL GROUP BY layer""")
def m10_layer_recall(spark, sf):
    """Errors in eight copies of the table found by statistics, by the ladder, by either."""
    return evaluate.layered(records(spark, sf), with_forest=False)


@query("m10_all_layers")
def m10_all_layers(spark, sf):
    """The same with the forest; fitted by sampling, hence without a twin."""
    return evaluate.layered(records(spark, sf))

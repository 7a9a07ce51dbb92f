"""Parsing, names, entity matching and row findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import match, standardize
from .q_rules import r4, sim
from .registry import query
from .views import commodities, markets, raw_records, records, table

FOLD = "trim(regexp_replace(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
FORMS = "forms AS (SELECT commodity AS owner, commodity AS form, 0 AS alias FROM cat UNION ALL SELECT commodity, concat(split_part(commodity, ' ', 2), ' ', split_part(commodity, ' ', 1)), 1 FROM cat), names AS (SELECT DISTINCT commodity_form AS name FROM std)"
SCORES = FORMS + f""",
  ng AS (SELECT DISTINCT name, substr(concat(' ', name, ' '), CAST(i AS INTEGER), 3) AS g FROM names, range(1, 60) t(i) WHERE name <> '' AND i <= length(name)),
  fg AS (SELECT DISTINCT owner, form, alias, substr(concat(' ', form, ' '), CAST(i AS INTEGER), 3) AS g FROM forms, range(1, 60) t(i) WHERE i <= length(form)),
  pr AS (SELECT DISTINCT name, owner, form, alias FROM ng JOIN fg USING (g)), sc AS (SELECT *, {sim('name', 'form')} AS s FROM pr),
  so AS (SELECT name, owner, coalesce(max(s) FILTER (WHERE alias = 0), 0.0) AS own, coalesce(max(s) FILTER (WHERE alias > 0), 0.0) * 0.99::DOUBLE AS other FROM sc GROUP BY ALL),
  fz AS (SELECT name, owner, {r4('CASE WHEN other > own THEN least(1.0, other + 0.05::DOUBLE) ELSE own END')} AS score FROM so),
  cand AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM fz WINDOW w AS (PARTITION BY name ORDER BY score DESC, owner)),
  ex AS (SELECT name, list_sort(list(DISTINCT owner)) AS owners FROM names JOIN forms ON name = form GROUP BY name)"""


def _short(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '\\b(market|mkt)\\b', ' ', 'g'), ' +', ' ', 'g'))"


TFIDF = """
  gn AS (SELECT name, g AS gram, count(*) AS tf FROM (SELECT name, substr(w, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS g, n FROM (SELECT name, concat(' ', unnest(list_filter(string_split(name, ' '), lambda t: t <> '')), ' ') AS w FROM {0}) ws, range(1, 60) t(i), range(2, 5) u(n) WHERE i <= length(w) - n + 1) GROUP BY ALL)"""
def _model(p: str, names: str, forms: str) -> str:
    """{p}tb: each name's nearest owner (model) and cosine, of all owners, by n-grams fitted to all forms; all pairs are compared."""
    return (
        TFIDF.format(f"(SELECT DISTINCT form AS name FROM {forms} WHERE form <> '')").replace("gn AS", f"{p}cg AS") + ", " + TFIDF.format(f"(SELECT DISTINCT name FROM {names})").replace("gn AS", f"{p}gn AS")
        + f""", {p}idf AS (SELECT gram, ln((1 + (SELECT count(DISTINCT name) FROM {p}cg)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM {p}cg GROUP BY gram),
  {p}wn AS (SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM (SELECT name, gram, (1 + ln(tf)) * idf AS w FROM {p}gn JOIN {p}idf USING (gram))),
  {p}wc AS (SELECT form, gram, v / sqrt(sum(v * v) OVER (PARTITION BY form)) AS v FROM (SELECT name AS form, gram, (1 + ln(tf)) * idf AS v FROM {p}cg JOIN {p}idf USING (gram))),
  {p}tb AS (SELECT name, owner AS model, cosine FROM (SELECT name, owner, max(cosine) AS cosine FROM (SELECT name, form, {r4('sum(w * v)')} AS cosine FROM {p}wn JOIN {p}wc USING (gram) GROUP BY ALL) JOIN (SELECT DISTINCT owner, form FROM {forms}) USING (form) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY cosine DESC, owner) = 1)"""
    )


def _ranked(p: str, names: str, forms: str, accept: str) -> str:
    """{p}near: owner, score and tie of each name (column name), all names compared with all forms (owner, form, alias)."""
    return f"""{p}so AS (SELECT name, owner, coalesce(max(s) FILTER (WHERE alias = 0), 0.0) AS own, coalesce(max(s) FILTER (WHERE alias > 0), 0.0) * 0.99::DOUBLE AS other FROM (SELECT name, owner, alias, {sim('name', 'form')} AS s FROM {names}, {forms} WHERE name <> '' AND form <> '') GROUP BY ALL),
  {p}fz AS (SELECT name, owner, {r4('CASE WHEN other > own THEN least(1.0, other + 0.05::DOUBLE) ELSE own END')} AS score FROM {p}so),
  {p}cand AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next, lead(owner) OVER w AS second FROM {p}fz WINDOW w AS (PARTITION BY name ORDER BY score DESC, owner)),
  {_model(p, names, forms)},
  {p}best AS (SELECT name, owner, score, next, second, coalesce(score >= 0.5 AND score - next < 0.02, false) AS tie, CASE WHEN score < 0.92 THEN model END AS model, cosine FROM {p}cand LEFT JOIN {p}tb USING (name) WHERE rank = 1 AND score >= 0.3),
  {p}near AS (SELECT name, tie, CASE WHEN model <> owner AND coalesce(next, 0) > least(score, {accept}::DOUBLE - 0.01::DOUBLE) THEN second ELSE owner END AS owner,
    {r4(f"CASE WHEN model <> owner THEN greatest(least(score, {accept}::DOUBLE - 0.01::DOUBLE), coalesce(next, 0)) WHEN model = owner THEN greatest(score, 0.5::DOUBLE * score + 0.5::DOUBLE * cosine) ELSE score END")} AS score FROM {p}best)"""


def _status(accept: str, review: str) -> str:
    return f"CASE WHEN name = '' THEN 'empty' WHEN len(owners) = 1 THEN 'exact' WHEN len(owners) > 1 THEN 'ambiguous' WHEN coalesce(score, 0) < {review} THEN 'unknown' WHEN tie THEN 'ambiguous' WHEN score >= {accept} THEN 'auto' ELSE 'review' END"


#: What is known of a name that reaches no owner is that its score is low: the score of unknown names isn't compared.
DECIDED = SCORES + f""", crest AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM ex)), {_ranked('c', 'crest', 'forms', '0.9')},
  dec1 AS (SELECT n.name, owners, {_status('0.9', '0.55')} AS status, CASE WHEN len(owners) = 1 THEN owners[1] WHEN owners IS NULL AND score >= 0.55 THEN owner END AS match, CASE WHEN len(owners) >= 1 THEN 1.0 ELSE coalesce(score, 0.0) END AS score FROM names n LEFT JOIN ex USING (name) LEFT JOIN cnear USING (name)),
  decided AS (SELECT name, CASE WHEN archived AND name <> '' THEN 'archived' ELSE status END AS status, match, score FROM dec1 LEFT JOIN cat ON match = commodity)"""
MARKETS = f"""
  mforms AS (SELECT DISTINCT market AS owner, {FOLD.format('market')} AS form FROM reg), mnames AS (SELECT DISTINCT market_form AS name FROM std),
  mx1 AS (SELECT name, list_sort(list(DISTINCT owner)) AS owners FROM mnames JOIN mforms ON name = form GROUP BY name),
  mrest AS (SELECT name, {_short('name')} AS short FROM mnames WHERE name NOT IN (SELECT name FROM mx1)), mbare AS (SELECT owner, {_short('form')} AS form, 0 AS alias FROM mforms),
  mx2 AS (SELECT short, list_sort(list(DISTINCT owner)) AS owners FROM (SELECT DISTINCT short FROM mrest) JOIN mbare ON short = form GROUP BY short),
  mask AS (SELECT DISTINCT short AS name FROM mrest WHERE short <> '' AND short NOT IN (SELECT short FROM mx2)), {_ranked('m', 'mask', 'mbare', '0.88')},
  mall AS (SELECT name, owners, NULL AS owner, NULL AS score, NULL AS tie FROM mx1 UNION ALL SELECT r.name, owners, owner, score, tie FROM mrest r LEFT JOIN mx2 USING (short) LEFT JOIN mnear n ON n.name = r.short),
  mdec AS (SELECT name, CASE WHEN len(owners) >= 1 THEN 1.0 ELSE coalesce(score, 0.0) END AS score, CASE WHEN len(owners) >= 1 THEN owners[1] WHEN score >= 0.5 THEN owner END AS match, {_status('0.88', '0.5')} AS status FROM mall)"""
RES = DECIDED + f""", {MARKETS},
  res AS (SELECT s.*, d.status, d.match, d.score, c.unit AS catalog_unit, m.status AS market_status, m.match AS market_match, m.score AS market_score, g.market AS registry_market, g.district, g.province FROM std s LEFT JOIN decided d ON d.name = s.commodity_form LEFT JOIN cat c ON c.commodity = d.match
    LEFT JOIN mdec m ON m.name = s.market_form LEFT JOIN reg g ON g.market = m.match AND m.status IN ('exact', 'auto'))"""


def std(spark, sf):
    return standardize.typed(raw_records(spark, sf))


def res(spark, sf):
    return standardize.resolved(std(spark, sf), commodities(spark, sf), markets(spark, sf))


@query("f01_normalize_text", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("folded"))


@query("f03_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, upper(p_name[1]) || p_name[2:] AS label FROM part")
def f03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title(F.col("p_name")).alias("title"), text.label(F.col("p_name")).alias("label"))


@query("f06_parse_price", "{std} SELECT id, raw_price, price FROM std")
def f06(spark, sf):
    return std(spark, sf).select("id", "raw_price", "price")


@query("f07_parse_date", "{std} SELECT id, raw_date, date FROM std")
def f07(spark, sf):
    return std(spark, sf).select("id", "raw_date", "date")


@query("f09_channel_map", "{std} SELECT raw_channel, channel, count(*) AS n FROM std GROUP BY ALL")
def f09(spark, sf):
    return std(spark, sf).groupBy("raw_channel", "channel").agg(F.count("*").alias("n"))


@query("f10_unit_norm", "{std} SELECT raw_unit, unit, count(*) AS n FROM std GROUP BY ALL")
def f10(spark, sf):
    return std(spark, sf).groupBy("raw_unit", "unit").agg(F.count("*").alias("n"))


@query("f11_currency_default", "SELECT event_type, upper(coalesce(nullif(trim(CASE WHEN user_id % 3 = 0 THEN '' ELSE 'usd' END), ''), 'RWF')) AS currency, count(*) AS n FROM events GROUP BY ALL")
def f11(spark, sf):
    raw = F.when(F.col("user_id") % 3 == 0, "").otherwise("usd")
    return table(spark, sf, "events").groupBy("event_type", parse.currency(raw).alias("currency")).agg(F.count("*").alias("n"))


_PAIRS = "prs AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) w FROM part) a JOIN (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) w FROM part) b USING (w) WHERE a.p_name < b.p_name)"


def _name_pairs(spark, sf):
    words = table(spark, sf, "part").select("p_name").distinct().withColumn("w", F.explode(F.split("p_name", " ")))
    return words.select(F.col("p_name").alias("a"), "w").join(words.select(F.col("p_name").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()


@query("f14_levenshtein", f"WITH {_PAIRS} SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance, {r4('1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b))')} AS edit_similarity FROM prs")
def f14(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").alias("distance"), text.r4(text.edit_similarity(F.col("a"), F.col("b"))).alias("edit_similarity"))


@query("f16_token_jaccard", f"WITH {_PAIRS} SELECT a, b, {r4('CAST(len(list_intersect(string_split(a, chr(32)), string_split(b, chr(32)))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a, chr(32)), string_split(b, chr(32)))))')} AS jaccard FROM prs")
def f16(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", text.r4(text.token_similarity(F.col("a"), F.col("b"))).alias("jaccard"))


@query("f17_similarity", f"WITH {_PAIRS} SELECT a, b, {r4(sim('a', 'b'))} AS similarity FROM prs")
def f17(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", text.r4(text.similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query("f18_indel_ratio")
def f18(spark, sf):
    a, b = F.col("a"), F.col("b")
    kinds = {"ratio": match.indel_ratio, "token_sort": match.token_sort_ratio, "token_set": match.token_set_ratio, "score": match.fuzzy_score}
    return _name_pairs(spark, sf).select("a", "b", *(text.r4(f(a, b)).alias(n) for n, f in kinds.items()))


@query("f27_province_label", "{rec} SELECT province, CASE WHEN letters LIKE '%kigali%' THEN 'Kigali' WHEN letters LIKE '%east%' THEN 'East' WHEN letters LIKE '%west%' THEN 'West' WHEN letters LIKE '%north%' THEN 'North' WHEN letters LIKE '%south%' THEN 'South' END AS matched, n FROM (SELECT province, regexp_replace(lower(province), '[^a-z]', '', 'g') AS letters, count(*) AS n FROM rec GROUP BY ALL)")
def f27(spark, sf):
    letters = F.regexp_replace(F.lower("province"), "[^a-z]", "")
    found = None
    for word, name in (("kigali", "Kigali"), ("east", "East"), ("west", "West"), ("north", "North"), ("south", "South")):
        found = (F if found is None else found).when(letters.contains(word), name)
    return records(spark, sf).groupBy("province").agg(F.count("*").alias("n")).withColumn("matched", found)


@query("d02_lineage", "{std} SELECT id, field, CASE WHEN before = '' THEN '(empty)' ELSE before END AS before, CASE WHEN after = '' THEN '(empty)' ELSE after END AS after FROM (SELECT id, 'date' AS field, trim(raw_date) AS before, coalesce(strftime(date, '%Y-%m-%d'), '') AS after FROM std UNION ALL SELECT id, 'channel', trim(raw_channel), coalesce(channel, '') FROM std UNION ALL SELECT id, 'unit', trim(raw_unit), coalesce(unit, '') FROM std) WHERE before <> after")
def d02(spark, sf):
    return standardize.lineage(std(spark, sf))


@query("d03_missing", "{std} SELECT id, fields, severity FROM (SELECT id, concat_ws(',', CASE WHEN raw_date = '' THEN 'date' END, CASE WHEN raw_commodity = '' THEN 'commodity' END, CASE WHEN raw_market = '' THEN 'market' END, CASE WHEN channel IS NULL THEN 'channel' END, CASE WHEN price IS NULL THEN 'price' END) AS fields, CASE WHEN price IS NULL OR raw_commodity = '' THEN 'critical' ELSE 'medium' END AS severity FROM std) WHERE fields <> ''")
def d03(spark, sf):
    return standardize.missing(std(spark, sf))


@query("d04_invalid_date", "{std} SELECT id, raw_date, 'high' AS severity FROM std WHERE raw_date <> '' AND date IS NULL")
def d04(spark, sf):
    return standardize.invalid_dates(std(spark, sf))


@query("d05_invalid_price", "{std} SELECT id, price, 'critical' AS severity FROM std WHERE price <= 0")
def d05(spark, sf):
    return standardize.invalid_prices(std(spark, sf))


@query("d06_unknown_unit", "{std} SELECT id, unit, 'medium' AS severity FROM std WHERE unit NOT IN ('kg', 'litre', 'piece', 'bunch', 'bag')")
def d06(spark, sf):
    return standardize.unknown_units(std(spark, sf))


@query("d07_unusual_unit", f"{{std}}, {RES} SELECT id, unit, catalog_unit AS suggestion, 'low' AS severity FROM res WHERE unit IN ('kg', 'litre', 'piece', 'bunch', 'bag') AND unit <> catalog_unit AND status IN ('exact', 'auto')")
def d07(spark, sf):
    return standardize.unusual_units(res(spark, sf))


@query("d08_entity_issues", f"{{std}}, {RES} SELECT id, entity, status, CASE WHEN status = 'unknown' THEN 'UNKNOWN_ENTITY' ELSE 'ENTITY_MATCH' END AS type, CASE WHEN status = 'unknown' THEN 'high' WHEN status IN ('archived', 'ambiguous') THEN 'medium' WHEN entity = 'market' OR score >= 0.78 THEN 'low' ELSE 'medium' END AS severity, suggestion, CASE WHEN status <> 'unknown' THEN score END AS score FROM (SELECT id, 'commodity' AS entity, status, match AS suggestion, score FROM res UNION ALL SELECT id, 'market', market_status, market_match, market_score FROM res) WHERE status IN ('unknown', 'archived', 'ambiguous', 'review')")
def d08(spark, sf):
    return _told(standardize.entity_findings(res(spark, sf)))


def _told(decided):
    """Without the score of unknown names, of which no more is worked out than that it is below the limit."""
    return decided.withColumn("score", F.when(F.col("status") != "unknown", F.col("score")))


@query("d10_match_status", f"{{std}}, {DECIDED} SELECT name, status, match, CASE WHEN status <> 'unknown' THEN score END AS score FROM decided")
def d10(spark, sf):
    return _told(match.decide(std(spark, sf).select(F.col("commodity_form").alias("name")), commodities(spark, sf)))


@query("j01_registry_join", f"{{std}}, {RES} SELECT id, coalesce(registry_market, nullif(array_to_string(list_transform(string_split(lower(trim(raw_market)), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '')) AS market, district, province FROM res")
def j01(spark, sf):
    return res(spark, sf).select("id", "market", "district", "province")


@query("d12_market_status", f"{{std}}, {MARKETS} SELECT name, status, match, CASE WHEN status <> 'unknown' THEN score END AS score FROM mdec")
def d12(spark, sf):
    return _told(match.decide_markets(std(spark, sf).select(F.col("market_form").alias("name")), markets(spark, sf)))


@query("j05_exact_forms", f"{{std}}, {SCORES} SELECT name, array_to_string(owners, '|') AS owners FROM ex")
def j05(spark, sf):
    names = std(spark, sf).select(F.col("commodity_form").alias("name")).distinct()
    return match.exact_owners(names, match.forms(commodities(spark, sf))).select("name", F.array_join("owners", "|").alias("owners"))


@query("j06_archived", f"{{std}}, {RES} SELECT match AS commodity, count(*) AS n FROM res WHERE status = 'archived' GROUP BY match")
def j06(spark, sf):
    return res(spark, sf).where("status = 'archived'").groupBy(F.col("match").alias("commodity")).agg(F.count("*").alias("n"))


@query("j07_best_match", f"{{std}}, {SCORES} SELECT name, owner, score, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 3")
def j07(spark, sf):
    names = std(spark, sf).select(F.col("commodity_form").alias("name"))
    return match.candidates(match.fuzzy_scores(names, match.forms(commodities(spark, sf)))).select("name", "owner", "score", "rank")


_CAT_GRAMS = TFIDF.format("(SELECT commodity AS name FROM cat)").replace("gn AS", "cg AS")
_IDF = "idf AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(DISTINCT name) FROM cg)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM cg GROUP BY gram)"
_COS = f"""{_CAT_GRAMS}, {_IDF}, {TFIDF.format('names')},
  wn0 AS (SELECT name, gram, (1 + ln(tf)) * idf AS w FROM gn JOIN idf USING (gram)), wn AS (SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM wn0),
  wc0 AS (SELECT name AS owner, gram, (1 + ln(tf)) * idf AS v FROM cg JOIN idf USING (gram)), wc AS (SELECT owner, gram, v / sqrt(sum(v * v) OVER (PARTITION BY owner)) AS v FROM wc0),
  cos AS (SELECT name, owner, {r4('sum(w * v)')} AS cosine FROM wn JOIN wc USING (gram) GROUP BY ALL), tb AS (SELECT name, owner AS model, cosine FROM cos QUALIFY row_number() OVER (PARTITION BY name ORDER BY cosine DESC, owner) = 1)"""


@query("m01_tfidf_idf", f"{{std}}, {_CAT_GRAMS}, {_IDF} SELECT gram, df, {r4('idf')} AS idf FROM idf")
def m01(spark, sf):
    return match.idf(match.grams(commodities(spark, sf).select(F.col("commodity").alias("name")))).select("gram", "df", text.r4(F.col("idf")).alias("idf"))


@query("m02_tfidf_match", f"{{std}}, {FORMS}, {_COS} SELECT name, model AS owner, cosine FROM tb")
def m02(spark, sf):
    names = std(spark, sf).select(F.col("commodity_form").alias("name")).distinct()
    return match.tfidf_best(names, commodities(spark, sf).select(F.col("commodity").alias("name")))


@query("d09_rank_entities", f"{{std}}, {SCORES}, {_COS} SELECT c.name, c.owner, {r4('CASE WHEN score >= 0.92 OR model IS NULL THEN score WHEN owner = model THEN greatest(score, 0.5::DOUBLE * score + 0.5::DOUBLE * cosine) ELSE least(score, 0.89::DOUBLE) END')} AS score, coalesce(score >= 0.5 AND score - next < 0.02, false) AS ambiguous, CASE WHEN score < 0.92 THEN owner = model END AS model_agrees FROM cand c LEFT JOIN tb USING (name) WHERE rank = 1")
def d09(spark, sf):
    names = std(spark, sf).select(F.col("commodity_form").alias("name"))
    return match.rank_entities(names, commodities(spark, sf))

"""Exact and near duplicates of price records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, r4, similarity, spread
from ..sources.files import written
from .sieve import among, without

NEAR, SURE = 0.82, 0.92
#: The least share of common words of alike names of which neither is within the other, and the least share of a name that is left of it in
#: one within it whose common words are fewer; both follow from NEAR and the weights of ``similarity``. Rounding is allowed for.
WORDS = (NEAR - 1e-4 - 0.55 - 0.08) / 0.33
PART = (NEAR - 1e-4 - 0.12 - 0.08 - 0.33 * WORDS) / 0.55
#: Names of at most so many letters are cut into all their parts.
SHORT = 64


def key() -> Column:
    """Date, market, commodity and channel in lower case; gaps count as empty."""
    return F.lower(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "market", "commodity", "channel"))))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Later rows of a key against its first: equal prices are exact duplicates, others probable ones.

    The first row of a key is found by an aggregate and joined, so that a key with many rows isn't sorted in one task. Only rows
    whose key's hash occurs again are looked at for that; two keys of one hash merely make more of them."""
    rows = df.select("seq", "id", "price", key().alias("key")).withColumn("hash", F.xxhash64("key"))
    again = written(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    rows = written(among(rows, again, "hash").drop("hash"))
    first = rows.groupBy("key").agg(F.min(F.struct("seq", "id", "price")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, "key").where(F.struct("seq", "id") > F.struct("first.seq", "first.id"))
    same = F.col("price").eqNullSafe(F.col("first.price"))
    return later.select("id", F.col("first.id").alias("original_id"), F.when(same, "EXACT_DUPLICATE").otherwise("PROBABLE_DUPLICATE").alias("type"), F.when(same, "high").otherwise("critical").alias("severity"), F.when(same, 0.99).otherwise(0.90).alias("confidence"))


def name_neighbours(names: DataFrame) -> DataFrame:
    """Pairs (a, b, score) of distinct names that are alike, both ways, with each name's own pair at 1; names
    without a letter or digit are like nothing, themselves included.

    Pairs are looked for among distinct forms, without comparing all that share a word. Either the share of common words is ``WORDS`` at least: then, words in
    order with rare ones first, the two share one of the first few. Or one form is a part of the other with ``PART`` of its letters at least: such parts
    are cut out and looked up; forms of over ``SHORT`` letters, which have many, are compared with those that share a word and aren't shorter than such a part."""
    one = written(names.distinct().where("name IS NOT NULL").withColumn("form", normalized(F.col("name"))).where("form <> ''"))
    forms = one.select("form").distinct()
    words = forms.withColumn("ws", F.array_remove(F.array_distinct(F.split("form", " ")), "")).select("form", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    counted = words.join(words.groupBy("word").agg(F.count("*").alias("forms")).hint("merge"), "word")
    rank = F.row_number().over(Window.partitionBy("form").orderBy("forms", "word"))
    first = counted.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * WORDS) + 1).select("form", "n", "word")
    other = first.select(F.col("form").alias("b"), F.col("n").alias("m"), "word").hint("merge")
    by_words = first.join(other, "word").where((F.col("form") < F.col("b")) & (F.least("n", "m") >= WORDS * F.greatest("n", "m"))).select(F.col("form").alias("a"), "b")
    size = F.length("form")
    least = F.ceil(size * PART).cast("int")
    shorter = forms.where((size > 1) & (size <= SHORT)).withColumn("k", F.explode(F.sequence(least, size))).where(F.col("k") < size)
    cut = shorter.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("form") - F.col("k") + 1))).select(F.col("form").alias("a"), F.substr("form", "at", "k").alias("b"))
    by_parts = cut.join(forms.select(F.col("form").alias("b")).hint("merge"), "b").select("a", "b")
    long = words.where(size > SHORT).select(F.col("form").alias("a"), "word").join(words.select(F.col("form").alias("b"), "word").hint("merge"), "word")
    long = long.where((F.length("b") < F.length("a")) & (F.length("b") >= PART * F.length("a")) & F.contains("a", "b")).select("a", "b")
    pairs = by_words.union(by_parts).union(long).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = spread(pairs, "b").withColumn("score", r4(similarity(F.col("a"), F.col("b")))).where(F.col("score") >= NEAR).select("a", "b", "score")
    alike = pairs.union(pairs.select("b", "a", "score")).union(forms.select("form", F.col("form").alias("b"), F.lit(1.0).alias("score")))
    named = lambda c, form: one.select(F.col("name").alias(c), F.col("form").alias(form)).hint("merge")
    return alike.toDF("form_a", "form_b", "score").join(named("a", "form_a"), "form_a").join(named("b", "form_b"), "form_b").select("a", "b", "score")


def near_duplicates(df: DataFrame) -> DataFrame:
    """Rows that aren't duplicates by key, against the earliest earlier row of their date and channel with alike names.
    Gaps count as empty: rows without a date are of one date, but a row without a name is like none.

    Of the rows of one date, channel and pair of names only the earliest can be an original, and of all alike groups only
    the earliest of those: if that one isn't earlier than a row, none is. So groups are joined, not rows."""
    names, keys = ["commodity", "market"], ["date", "channel", "commodity", "market"]
    flagged = written(exact_duplicates(df).select("id"))
    rows = without(df, flagged, "id").select("seq", "id", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys))
    groups = rows.groupBy(*keys).agg(F.min(F.struct("seq", "id")).alias("first"))
    alike = [name_neighbours(df.select(F.col(n).alias("name"))).select(F.col("a").alias(n), F.col("b").alias(f"{n}_2"), F.col("score").alias(f"{n}_score")) for n in names]
    other = groups.select("date", "channel", *(F.col(n).alias(f"{n}_2") for n in names), F.col("first").alias("other"))
    pairs = groups.select(*keys).join(alike[0], "commodity").join(alike[1], "market").where("NOT (commodity = commodity_2 AND market = market_2)")
    score = (F.col("commodity_score") + F.col("market_score")) / 2
    hashed = F.xxhash64(*keys).alias("hash")
    best = written(pairs.join(other, ["date", "channel", "commodity_2", "market_2"]).groupBy(*keys).agg(F.min(F.struct("other", score.alias("score"))).alias("f")).select("*", hashed))
    found = among(rows.select("*", hashed), best, "hash").drop("hash").join(best.drop("hash"), keys).where(F.col("f.other") < F.struct("seq", "id"))
    sure = F.col("f.score") >= SURE
    return found.select("id", F.col("f.other.id").alias("original_id"), r4(F.col("f.score")).alias("score"), F.when(sure, "PROBABLE_DUPLICATE").otherwise("POSSIBLE_DUPLICATE").alias("type"), F.when(sure, "medium").otherwise("low").alias("severity"))

"""Entity matching of distinct names against a catalog: exact forms, then fuzzy scores over shared character trigrams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import normalized, r4, similarity, spread, token_similarity
from ..sources.files import written

ALIAS_WEIGHT, ALIAS_LIFT = 0.99, 0.05
#: Names of at most so many letters are looked up by all their spellings with a letter less.
SHORT = 64


@dataclass(frozen=True)
class Thresholds:
    """Accepted as it is, worth a review, and two names too close to choose. ``veto`` is the margin by which the n-gram model
    must prefer another owner to be heard, ``suggest`` the cosine from which its owner is suggested where spelling finds none (None: never)."""

    accept: float = 0.90
    review: float = 0.55
    tie: float = 0.02
    tie_least: float = 0.5
    veto: float = 0.0
    suggest: float | None = None


def trigrams(form: Column) -> Column:
    """Distinct trigrams of a padded form."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def forms(catalog: DataFrame) -> DataFrame:
    """owner, form, alias (0 for the name itself): the catalog's ``aliases`` if it has such a column, else a name's two words may come in either order."""
    name = F.col("commodity")
    if "aliases" in catalog.columns:
        own = catalog.select(name.alias("owner"), normalized(name).alias("form"), F.lit(0).alias("alias"))
        others = catalog.select(name.alias("owner"), F.explode("aliases").alias("form")).select("owner", normalized(F.col("form")).alias("form"), F.lit(1).alias("alias"))
        return own.union(others).where("form <> ''").distinct()
    swapped = F.concat(F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" "), F.split_part(name, F.lit(" "), F.lit(1)))
    both = catalog.select(F.col("commodity").alias("owner"), F.inline(F.array(F.struct(name.alias("form"), F.lit(0).alias("alias")), F.struct(swapped.alias("form"), F.lit(1).alias("alias")))))
    return both


def shuffled(df: DataFrame) -> DataFrame:
    """To be joined by shuffling: names and forms grow with the tables, and files of them look small enough to be sent out by the driver."""
    return df.hint("merge")


def exact_owners(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, owners: every owner that has the name among its forms."""
    return names.join(shuffled(known), names.name == known.form).groupBy("name").agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def owner_scores(pairs: DataFrame) -> DataFrame:
    """name, owner, score of pairs (name, owner, form, alias); a winning alias is weighed down, then lifted."""
    name, form = F.col("name"), F.col("form")
    pairs = spread(pairs, "name").withColumn("t", token_similarity(name, form)).withColumn("s", similarity(name, form, F.col("t")))
    best = lambda alias: F.coalesce(F.max(F.when((F.col("alias") > 0) == alias, F.col("s"))), F.lit(0.0))
    by = pairs.groupBy("name", "owner").agg(best(False).alias("own"), best(True).alias("other"))
    other = F.col("other") * ALIAS_WEIGHT
    return by.select("name", "owner", r4(F.when(other > F.col("own"), F.least(F.lit(1.0), other + ALIAS_LIFT)).otherwise(F.col("own"))).alias("score"))


def fuzzy_scores(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, owner, score of names and forms that share a trigram: those that share none are alike by less than half."""
    left = names.distinct().where("name <> ''").withColumn("gram", F.explode(trigrams(F.col("name"))))
    right = known.withColumn("gram", F.explode(trigrams(F.col("form"))))
    return owner_scores(left.join(right, "gram").select("name", "owner", "form", "alias").distinct())


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, " ")), "")


def _ranked(names: DataFrame, parts: Column, known: DataFrame) -> DataFrame:
    """name, part and its rank among the name's parts, those of fewest forms first; ``forms`` of each."""
    each = names.withColumn("part", F.explode(parts)).join(shuffled(known.groupBy("part").agg(F.count("*").alias("forms"))), "part", "left").na.fill(0, ["forms"])
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("forms", "part")))


def one_edit_apart(names: DataFrame, spelled: DataFrame) -> DataFrame:
    """name, form: all pairs of names of at most ``SHORT`` letters and forms that an edit at most tells apart, and some that two do: they have a
    spelling in common once a letter or none is left out of each. A spelling has a bounded number of those, however many forms there are."""

    def without_one(text: Column) -> Column:
        return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))))

    left = names.select("name").where(F.length("name").between(1, SHORT)).withColumn("part", F.explode(without_one(F.col("name"))))
    right = spelled.select("form").where(F.length("form").between(1, SHORT + 1)).withColumn("part", F.explode(without_one(F.col("form"))))
    return left.join(shuffled(right), "part").select("name", "form").distinct()


def near_scores(names: DataFrame, known: DataFrame, limits: Thresholds) -> DataFrame:
    """name, owner, score: of each name every owner that may decide its match, without comparing all names with all forms.

    Forms an edit away, or else what the rarest trigrams and the rarest word bring, give a lower bound of the best score. Only owners can matter that
    reach the review limit and come within the tie of the best (or beat what a best one that the model doubts is capped to). A form that
    reaches so much shares either more than one word in 2n - 1 of n words, hence one of the name's rarest n - 1 words (any word, if the form has
    fewer than n), or it is so few edits away that of any 3 d + 1 trigrams one is left, hence one of the rarest. Names for which that is one edit
    at most have all such forms already; trigrams, which ever more forms share, are asked only about the others."""
    names, known = written(names.distinct().where("name <> ''")), known.distinct().where("form <> ''")
    spelled = known.select("form").distinct()
    words_of = spelled.withColumn("m", F.size(_words(F.col("form")))).withColumn("part", F.explode(_words(F.col("form"))))
    words_in = _ranked(names, _words(F.col("name")), words_of)

    def owners(*found: DataFrame) -> DataFrame:
        forms_found = reduce(lambda a, b: a.union(b), (f.select("name", "form") for f in found)).distinct()
        return forms_found.join(shuffled(known.select("form", "owner")), "form").select("name", "owner").distinct().join(shuffled(known), "owner")

    # the score that still matters, of a form: less what an alias is lifted by, if there are any, and the last digit
    lifted = not known.where("alias > 0").isEmpty()

    def bounded(names: DataFrame, scores: DataFrame) -> DataFrame:
        """name, n, reach: its words, and the edits that a form may be away that shares few of them."""
        first = scores.groupBy("name").agg(F.max("score").alias("least"))
        floor = F.greatest(F.lit(limits.review), F.least(F.coalesce("least", F.lit(0.0)) - limits.tie, F.lit(limits.accept - 0.01)))
        need = ((floor - ALIAS_LIFT) / ALIAS_WEIGHT if lifted else floor) - 1e-4
        n = F.size(_words(F.col("name")))
        edit = (need - 0.2 - 0.33 / (2 * n - 1)) / 0.55
        reach = F.when(edit > 1, -1).when(edit <= 0.01, 1 << 20).otherwise(F.floor((1 - edit) / edit * F.length("name") + 1e-6))
        return written(names.join(shuffled(first), "name", "left").select("name", n.alias("n"), reach.alias("reach")))

    close = written(one_edit_apart(names, spelled))
    seeds = written(owner_scores(owners(close)))
    bound = bounded(names, seeds)
    settled = (F.col("reach") <= 1) & (F.length("name") <= SHORT)
    rest = written(bound.where(~settled).select("name"))
    found = [close]
    if not rest.isEmpty():
        grams_of = spelled.withColumn("part", F.explode(trigrams(F.col("form"))))
        grams_in = written(_ranked(rest, trigrams(F.col("name")), grams_of))
        present = Window.partitionBy("name").orderBy("rank")
        rarest = grams_in.where("forms > 0").withColumn("at", F.row_number().over(present)).where("at <= 2")
        worded = words_in.join(shuffled(rest), "name", "left_semi").where("rank = 1 AND forms > 0")
        more = owner_scores(owners(rarest.join(shuffled(grams_of), "part"), worded.join(shuffled(words_of), "part")))
        further = bounded(rest, more.unionByName(seeds.join(shuffled(rest), "name", "left_semi")))
        probed = grams_in.where("forms > 0").join(shuffled(further), "name").where("rank <= 3 * reach + 1")
        found.append(probed.join(shuffled(grams_of), "part"))
        bound = bound.where(settled).unionByName(further)
    asked = words_in.where("forms > 0").join(shuffled(bound), "name")
    found.append(asked.where("rank < n").join(shuffled(words_of), "part"))
    short = asked.where("n > 1").withColumn("m", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))))
    found.append(short.join(shuffled(words_of), ["part", "m"]))
    return owner_scores(owners(*found))


def candidates(scores: DataFrame, limit: int = 3) -> DataFrame:
    """The best owners of each name with their rank and the next one's score."""
    w = Window.partitionBy("name").orderBy(F.desc("score"), "owner")
    return scores.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where(F.col("rank") <= limit)


def modelled(best: DataFrame, known: DataFrame, limits: Thresholds) -> DataFrame:
    """Best and second owners with the n-gram model's word on those below ``SURE``: if it prefers the same owner its cosine blends the score
    upward; if it prefers another by the margin ``veto``, the score is capped below acceptance, where the second may overtake it. A name whose
    best score stays below the review limit gets the model's owner, not for acceptance, if its cosine reaches ``suggest``.

    name, owner, score, tie (whether the second came close before the model spoke), model, cosine."""
    top = best.where("rank = 1")
    asked = top.where(F.coalesce("score", F.lit(0.0)) < SURE).select("name", "owner")
    model = nearest_by_model(asked, known).withColumnRenamed("owner", "model")
    out = top.join(shuffled(model), "name", "left").join(shuffled(best.where("rank = 2").select("name", F.col("owner").alias("second"), F.col("score").alias("second_score"))), "name", "left")
    agrees = F.col("model") == F.col("owner")
    doubted = F.col("model").isNotNull() & ~agrees & (r4(F.col("cosine") - F.col("own")) >= limits.veto)
    capped = F.least("score", F.lit(limits.accept - 0.01))
    overtaken = doubted & (F.coalesce("second_score", F.lit(0.0)) > capped)
    score = F.when(overtaken, F.col("second_score")).when(doubted, capped).when(agrees, F.greatest("score", 0.5 * F.col("score") + 0.5 * F.col("cosine"))).otherwise(F.col("score"))
    tie = (F.col("score") >= limits.tie_least) & (F.col("score") - F.col("second_score") < limits.tie)
    out = out.select("name", F.when(overtaken, F.col("second")).otherwise(F.col("owner")).alias("owner"), r4(score).alias("score"), F.coalesce(tie, F.lit(False)).alias("tie"), "model", "cosine")
    if limits.suggest is None:
        return out
    rescued = (F.coalesce("score", F.lit(0.0)) < limits.review) & (F.col("cosine") >= limits.suggest)
    changed = {"owner": F.col("model"), "score": F.greatest(F.lit(limits.review), F.least("cosine", F.lit(limits.accept - 0.01))), "tie": F.lit(False)}
    return out.withColumns({c: F.when(rescued, e).otherwise(F.col(c)) for c, e in changed.items()})


def _decided(out: DataFrame, limits: Thresholds) -> DataFrame:
    """name, status, match and score of names beside their exact ``owners`` or their modelled owner, score and tie."""
    score = F.when(F.size("owners") >= 1, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    status = (
        F.when(F.col("name") == "", "empty").when(F.size("owners") == 1, "exact").when(F.size("owners") > 1, "ambiguous")
        .when(score < limits.review, "unknown").when(F.col("tie"), "ambiguous").when(score >= limits.accept, "auto").otherwise("review")
    )
    return out.select("name", status.alias("status"), F.when(F.col("owners").isNull() & (score >= limits.review), F.col("owner")).alias("match"), score.alias("score"), "owners")


def decide(names: DataFrame, catalog: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """name, status, match, score of each distinct name: exact, archived, auto, review, ambiguous, unknown or empty."""
    names, known = written(names.distinct()), written(forms(catalog))
    exact = exact_owners(names, known)
    rest = names.join(shuffled(exact), "name", "left_anti")
    best = written(candidates(near_scores(rest, known, limits), 2))
    if limits.suggest is not None:  # the model is asked about names that no owner comes near, too
        best = written(best.unionByName(rest.where("name <> ''").join(best, "name", "left_anti").withColumn("rank", F.lit(1)), allowMissingColumns=True))
    out = _decided(names.join(shuffled(exact), "name", "left").join(shuffled(modelled(best, known, limits)), "name", "left"), limits)
    out = out.withColumn("match", F.when(F.size("owners") == 1, F.col("owners")[0]).otherwise(F.col("match")))
    archived = catalog.where("archived").select(F.col("commodity").alias("match"), F.lit(True).alias("old"))
    out = out.join(shuffled(archived), "match", "left")
    return out.select("name", F.when(F.col("old") & (F.col("name") != ""), "archived").otherwise(F.col("status")).alias("status"), "match", "score")


MARKET, SURE = Thresholds(accept=0.88, review=0.50), 0.92


def market_name(form: Column) -> Column:
    """A market's form without the word market."""
    return F.trim(F.regexp_replace(F.regexp_replace(form, r"\b(market|mkt)\b", " "), " +", " "))


def decide_markets(names: DataFrame, registry: DataFrame, limits: Thresholds = MARKET) -> DataFrame:
    """name, status, match, score of each distinct folded market name: a registered spelling first, else the best of the
    registry once the word market is left out of both."""
    forms_of = written(registry.select(F.col("market").alias("owner"), normalized(F.col("market")).alias("form")).distinct())
    whole = written(names.distinct().where("name IS NOT NULL"))
    first = exact_owners(whole, forms_of)
    rest = whole.join(shuffled(first), "name", "left_anti").withColumn("short", market_name(F.col("name")))
    bare = forms_of.select("owner", market_name(F.col("form")).alias("form"), F.lit(0).alias("alias"))
    asked = rest.select(F.col("short").alias("name")).distinct()
    second = exact_owners(asked, bare)
    best = written(candidates(near_scores(asked.join(shuffled(second), "name", "left_anti"), bare, limits), 2))
    near = asked.join(shuffled(second), "name", "left").join(shuffled(modelled(best, bare, limits)), "name", "left")
    out = rest.join(shuffled(near.withColumnRenamed("name", "short")), "short", "left").select("name", "owners", "owner", "score", "tie")
    none = {"owner": "string", "score": "double", "tie": "boolean"}
    out = _decided(out.unionByName(first.select("name", "owners", *(F.lit(None).cast(k).alias(c) for c, k in none.items()))), limits)
    return out.select("name", "status", F.when(F.size("owners") >= 1, F.col("owners")[0]).otherwise(F.col("match")).alias("match"), "score")


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, all pairs at once: a bit for each character of the first text (64 at most)
    says where the row of the dynamic programme doesn't rise."""
    out = np.zeros(len(a), np.int64)
    wide = max(map(len, a), default=0)
    x, y = (np.array([list(map(ord, t)) + [fill] * (most - len(t)) for t in texts], np.int32).reshape(len(texts), most) for texts, fill, most in ((a, -1, wide), (b, -2, max(map(len, b), default=0))))
    if not x.size or not y.size:
        return out
    bits = np.uint64(1) << np.arange(wide, dtype=np.uint64)
    row = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(y.shape[1]):
        met = row & ((x == y[:, k : k + 1]) * bits).sum(axis=1, dtype=np.uint64)
        row = (row + met) | (row - met)
    return wide - ((row[:, None] & bits) != 0).sum(axis=1)


def _common_long(a: str, b: str) -> int:
    """The same for one pair of any length, in one whole number."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & masks.get(c, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & full).bit_count()


@F.pandas_udf(LongType())
def common_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the longest common subsequence; nulls count as empty."""
    x, y = (["" if t is None else t for t in s.tolist()] for s in (a, b))
    long = np.array([min(len(s), len(t)) > 64 or max(len(s), len(t)) > 512 for s, t in zip(x, y, strict=True)], bool)
    out = np.zeros(len(x), np.int64)
    short = np.flatnonzero(~long)
    first = [min(x[k], y[k], key=len) for k in short]
    out[short] = _common(first, [max(y[k], x[k], key=len) for k in short])
    for k in np.flatnonzero(long):
        out[k] = _common_long(x[k], y[k])
    return pd.Series(out)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the longest common subsequence over the summed lengths; two empty texts are equal."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    lengths = F.length(a) + F.length(b)
    return F.when(lengths == 0, 1.0).otherwise(2 * common_letters(a, b) / lengths)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio once the words of both stand in order."""
    in_order = lambda c: F.array_join(F.sort_array(F.filter(F.split(c, " "), lambda w: w != "")), " ")
    return indel_ratio(in_order(a), in_order(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the common words alone and with what else either has; 1 if one's words are all among the other's, 0
    if either has none."""
    x, y = _words(a), _words(b)
    spelled = lambda words: F.array_join(F.sort_array(words), " ")
    both, one, two = (spelled(w) for w in (F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)))
    shared, left, right = F.length(both), F.length(one), F.length(two)
    gap = F.when(shared > 0, 1).otherwise(0)
    rest = 1 - (left + right - 2 * common_letters(one, two)) / (2 * shared + 2 * gap + left + right)
    alone = lambda other: 1 - (gap + other) / (2 * shared + gap + other)
    best = F.when(shared > 0, F.greatest(rest, alone(left), alone(right))).otherwise(rest)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((shared > 0) & ((left == 0) | (right == 0)), 1.0).otherwise(best)


def fuzzy_score(a: Column, b: Column) -> Column:
    """The better of the plain and the sorted ratio, and of 0.95 of the set ratio where both have several words; 0 if either is empty."""
    plain = F.greatest(indel_ratio(a, b), token_sort_ratio(a, b))
    several = F.contains(a, F.lit(" ")) & F.contains(b, F.lit(" "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(plain, F.when(several, 0.95 * token_set_ratio(a, b)).otherwise(0.0)))


def grams(names: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """name, gram, tf: character n-grams of padded words."""
    words = names.withColumn("word", F.explode(F.filter(F.split("name", " "), lambda w: w != ""))).withColumn("word", F.concat(F.lit(" "), "word", F.lit(" ")))

    def cut(n: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.length("word") - n + 1)
        return words.where(F.length("word") >= n).withColumn("gram", F.explode(F.transform(places, lambda i: F.substr("word", i, F.lit(n)))))

    parts = [cut(n) for n in range(low, high + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("name", "gram").agg(F.count("*").alias("tf"))


def idf(corpus: DataFrame) -> DataFrame:
    """gram, df, idf = ln((1 + names) / (1 + df)) + 1."""
    total = corpus.agg(F.countDistinct("name").alias("total"))
    return corpus.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("gram", "df", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, by: DataFrame) -> DataFrame:
    """name, gram, w: (1 + ln tf) idf, scaled to unit length; unknown grams are dropped."""
    raw = counts.join(shuffled(by), "gram").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(shuffled(norm), "name").select("name", "gram", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_best(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """name, owner, cosine: the nearest name of the corpus."""
    counted = grams(corpus)
    by = idf(counted)
    left, right = weights(grams(names), by), weights(counted, by).select(F.col("name").alias("owner"), "gram", F.col("w").alias("v"))
    scores = left.join(right, "gram").groupBy("name", "owner").agg(r4(F.sum(F.col("w") * F.col("v"))).alias("cosine"))
    return scores.groupBy("name").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "owner")).alias("b")).select("name", "b.owner", (-F.col("b.c")).alias("cosine"))


def nearest_by_model(asked: DataFrame, known: DataFrame) -> DataFrame:
    """name, owner, cosine, own: of all owners the nearest one by the n-gram model, fitted to all forms, ties to the smaller owner; and the
    cosine of the owner that was asked about (0 if none).

    The cosine of the owner that a name is asked about (``owner``) is a lower bound. Let the n-grams be in order, rare ones first: what a name and a form
    bring together from the first n-gram on that they share is at most the product of the lengths of what either has from there on. So they are
    met at n-grams where that product reaches the bound, with their whole weights, and no pair is handed on that doesn't reach it."""
    known = known.where("form <> ''")
    counted = grams(known.select(F.col("form").alias("name")).distinct())
    by = written(idf(counted))
    right = written(weights(counted, by).join(shuffled(by.select("gram", "df")), "gram").select(F.col("name").alias("form"), "gram", F.col("w").alias("v"), "df"))
    left = written(weights(grams(asked.select("name").distinct()), by).join(shuffled(by.select("gram", "df")), "gram"))
    own = asked.join(shuffled(known.select("owner", "form").distinct()), "owner").select("name", "form").distinct()
    dots = own.join(shuffled(right.drop("df")), "form").join(shuffled(left.drop("df")), ["name", "gram"]).groupBy("name", "form").agg(F.sum(F.col("w") * F.col("v")).alias("c"))
    least = written(dots.groupBy("name").agg(F.max("c").alias("least")))

    def behind(of: str, weight: str) -> Column:
        return F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(of).orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    names = left.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("gram", "w"))).alias("x"))
    names = names.join(shuffled(least), "name", "left").select("name", F.col("x.gram").alias("grams"), F.col("x.w").alias("ws"), (F.coalesce("least", F.lit(0.0)) - 1e-4).alias("least"))
    lowest = names.agg(F.min("least").alias("lowest"))
    vectors = right.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("gram", "v"))).alias("vs"))
    met = right.withColumn("form_behind", behind("form", "v")).crossJoin(F.broadcast(lowest)).where("form_behind >= lowest").select("form", "gram", "form_behind").join(shuffled(vectors), "form")
    probes = left.withColumn("behind", behind("name", "w")).select("name", "gram", "behind").join(shuffled(names), "name").where("behind >= least")
    pairs = probes.join(shuffled(met), "gram").where("behind * form_behind >= least")
    dot = F.aggregate(F.zip_with("grams", "ws", lambda g, w: w * F.coalesce(F.try_element_at("vs", g), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    full = pairs.withColumn("dot", dot).where("dot >= least").groupBy("name", "form").agg(r4(F.max("dot")).alias("cosine"))
    owned = full.join(shuffled(known.select("form", "owner").distinct()), "form").groupBy("name", "owner").agg(F.max("cosine").alias("cosine"))
    nearest = owned.groupBy("name").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "owner")).alias("b"))
    return nearest.join(shuffled(least), "name", "left").select("name", "b.owner", (-F.col("b.c")).alias("cosine"), r4(F.coalesce("least", F.lit(0.0))).alias("own"))


def rank_entities(names: DataFrame, catalog: DataFrame, accept: float = 0.90, sure: float = 0.92) -> DataFrame:
    """Fuzzy best, asked against the n-gram model below ``sure``: agreement blends upward, dissent caps the score."""
    best = candidates(fuzzy_scores(names, forms(catalog)), 1)
    model = tfidf_best(names.distinct(), catalog.select(F.col("commodity").alias("name"))).withColumnRenamed("owner", "model")
    out = best.join(model, "name", "left")
    tie = (F.col("score") >= 0.5) & (F.col("score") - F.col("next") < 0.02)
    agrees = F.col("owner") == F.col("model")
    score = F.when(F.col("score") >= sure, F.col("score")).when(F.col("model").isNull(), F.col("score")).when(agrees, F.greatest("score", 0.5 * F.col("score") + 0.5 * F.col("cosine"))).otherwise(F.least("score", F.lit(accept - 0.01)))
    return out.select("name", "owner", r4(score).alias("score"), F.coalesce(tie, F.lit(False)).alias("ambiguous"), F.when(F.col("score") < sure, agrees).alias("model_agrees"))

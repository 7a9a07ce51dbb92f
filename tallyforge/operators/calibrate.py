"""Evaluation and calibration of name matching: misspelt and foreign names are scored once, and every bound is read off counts.

A case is a name and the owner that it ought to find. Scores are worked out once per distinct name; margins and bounds are then tried on
counts of right and wrong cases by score, so that trying more of them doesn't match anything again.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, r4
from ..sources.files import written
from .match import SURE, Thresholds, exact_owners, near_scores, nearest_by_model

#: Margins that a dissenting model must clear, steps of the bound for acceptance and of the model's own line.
MARGINS = (0.0, 0.02, 0.05, 0.08, 0.12, 0.2, 9.0)
ACCEPTS = tuple(round(0.85 + 0.01 * k, 2) for k in range(14))
LINES = tuple(round(0.75 + 0.01 * k, 2) for k in range(23))
#: The review bound lies within these, a step above the best name that isn't in the catalog.
LOWEST, HIGHEST, STEP = 0.4, 0.8, 0.02


def picked(name: Column, salt: str, n: Column) -> Column:
    """A number below n that depends on the name and the salt alone."""
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(salt))), 1, 4), 16, 10).cast("int") % n


def misspelt(catalog: DataFrame, column: str) -> DataFrame:
    """want, kind, raw: each name of a catalog as it is and with four mistakes: a letter dropped, two letters swapped, a wrong vowel, odd case and spacing.

    Short names: none is dropped or swapped out of one letter, names below four letters aren't swapped, a name without a vowel gets one more."""
    s = F.col(column)
    size = F.length(s)
    at = 1 + picked(s, "drop", F.greatest(size - 2, F.lit(1)))
    dropped = F.when(size < 2, s).otherwise(F.concat(F.substr(s, F.lit(1), at), F.substr(s, at + 2)))
    to = 1 + picked(s, "swap", F.greatest(size - 3, F.lit(1)))
    swapped = F.when(size < 4, s).otherwise(F.concat(F.substr(s, F.lit(1), to), F.substr(s, to + 2, F.lit(1)), F.substr(s, to + 1, F.lit(1)), F.substr(s, to + 3)))
    places = F.when(size < 2, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), lambda p: F.lower(F.substr(s, p, F.lit(1))).isin(*"aeiou")))
    place = F.get(places, picked(s, "vowel", F.greatest(F.size(places), F.lit(1))))
    other = F.translate(F.lower(F.substr(s, place, F.lit(1))), "aeiou", "eioua")
    vowel = F.when(F.size(places) == 0, F.concat(s, F.lit("a"))).otherwise(F.concat(F.substr(s, F.lit(1), place - 1), other, F.substr(s, place + 1)))
    spaced = F.concat(F.lit("  "), F.replace(F.upper(s), F.lit(" "), F.lit("  ")), F.lit(" "))
    kinds = {"as it is": s, "drop": dropped, "swap": swapped, "vowel": vowel, "spacing": spaced}
    return catalog.where(s.isNotNull() & (s != "")).select(s.alias("want"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("raw")) for k, e in kinds.items()))))


def judged(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Cases (group, kind, want, raw) with what matching makes of them, whatever the bounds will be.

    score: of the best owner, once the n-gram model has spoken if it agrees; 0 below ``LOWEST``. tie: another owner is too close. right: the wanted
    owner is the best or that close to it. dissent: by how much cosine the model prefers another owner, null if it doesn't. cosine, model_right:
    the model's own best owner. A name that is one of the forms scores 1; if several owners have it, it's a tie. Cases without a name score 0;
    cases of the same name count each. want is null where nothing ought to be found: such cases are never right."""
    limits = Thresholds(accept=ACCEPTS[0], review=LOWEST)
    known = written(known)
    cases = written(cases.select("group", "kind", "want", normalized(F.coalesce("raw", F.lit(""))).alias("name")))
    names = written(cases.select("name").distinct())
    exact = exact_owners(names, known).select("name", F.size("owners").alias("owners"))
    rest = names.join(exact, "name", "left_anti")
    scores = written(near_scores(rest, known, limits).where(F.col("score") >= LOWEST))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "owner")
    top = scores.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank = 1").drop("rank")
    best = written(rest.join(top, "name", "left"))
    asked = best.where((F.coalesce("score", F.lit(0.0)) < SURE) & (F.col("name") != "")).select("name", "owner")
    model = nearest_by_model(asked, known).withColumnRenamed("owner", "model")
    tie = (F.col("score") >= limits.tie_least) & (F.col("score") - F.col("next") < limits.tie)
    agrees = F.col("model") == F.col("owner")
    near = best.join(model, "name", "left").select(
        "name", F.col("score").alias("first"), F.coalesce(tie, F.lit(False)).alias("tie"), "model", "cosine",
        F.when(agrees, r4(F.greatest("score", 0.5 * F.col("score") + 0.5 * F.col("cosine")))).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(F.col("owner").isNotNull() & ~agrees, r4(F.col("cosine") - F.col("own"))).alias("dissent"),
    )
    named = known.select(F.col("form").alias("name"), F.col("owner").alias("want"), F.lit(True).alias("spelled")).distinct()
    wanted = scores.select("name", F.col("owner").alias("want"), F.col("score").alias("wanted"))
    all_of = cases.join(exact, "name", "left").join(near, "name", "left").join(named, ["name", "want"], "left").join(wanted, ["name", "want"], "left")
    is_exact = F.col("owners").isNotNull()
    right = F.when(is_exact, F.coalesce("spelled", F.lit(False))).otherwise(F.coalesce(F.col("first") - F.col("wanted") < limits.tie, F.lit(False)))
    return all_of.select(
        "group", "kind", "name", "want", F.when(is_exact, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(is_exact, F.col("owners") > 1).otherwise(F.coalesce("tie", F.lit(False))).alias("tie"), right.alias("right"),
        "dissent", "cosine", F.coalesce(F.col("model") == F.col("want"), F.lit(False)).alias("model_right"),
    )


def _hundredth(x: float) -> float:
    return int(x * 100 + 0.5) / 100


def review_bound(found: DataFrame) -> float:
    """Just above the best score of a name that isn't in the catalog."""
    best = found.where("want IS NULL").agg(F.max("score")).first()[0]
    return _hundredth(min(HIGHEST, max(LOWEST, (best or 0.0) + STEP)))


def _free(margin: Column) -> Column:
    """Neither another owner nor the model stands against acceptance."""
    return ~F.col("tie") & ~F.coalesce(F.col("dissent") >= margin, F.lit(False))


def curve(found: DataFrame, review: float, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """margin, score, rights, wrongs: how many cases are accepted rightly and wrongly if this score is the least that is accepted.

    Scores have four decimals, so a margin has 10,001 rows at most, whatever the number of cases."""
    asked = found.where(F.col("want").isNotNull() & (F.col("score") >= review)).withColumn("margin", F.explode(F.array(*map(F.lit, margins))))
    counts = asked.where(_free(F.col("margin"))).groupBy("margin", "score").agg(F.count_if(F.col("right")).alias("r"), F.count_if(~F.col("right")).alias("w"))
    down = Window.partitionBy("margin").orderBy(F.desc("score"))
    return counts.select("margin", "score", F.sum("r").over(down).alias("rights"), F.sum("w").over(down).alias("wrongs"))


def sweep(found: DataFrame, review: float, default: float, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """A row a margin: accept (the first step at which nothing is accepted wrongly, else the default), wrong cases accepted by it, and
    misspelt cases that go to review by it."""
    marks = found.sparkSession.createDataFrame([(m, a) for m in margins for a in ACCEPTS], "margin double, step double")
    at = F.broadcast(marks).join(curve(found, review, margins), "margin").where(F.col("score") >= F.col("step"))
    clean = at.groupBy("margin", "step").agg(F.max("wrongs").alias("wrongs")).where("wrongs = 0").groupBy("margin").agg(F.min("step").alias("accept"))
    chosen = F.broadcast(marks.select("margin").distinct()).join(clean, "margin", "left").select("margin", F.coalesce("accept", F.lit(default)).alias("accept"))
    asked = found.where("want IS NOT NULL").join(F.broadcast(chosen))
    auto = (F.col("score") >= review) & (F.col("score") >= F.col("accept")) & _free(F.col("margin"))
    waits = (F.col("score") >= review) & ~auto & (F.col("group") == "misspelt")
    counts = asked.groupBy("margin", "accept").agg(F.count_if(auto & ~F.col("right")).alias("wrong"), F.count_if(waits).alias("reviews"))
    return chosen.join(counts, ["margin", "accept"], "left").na.fill(0, ["wrong", "reviews"])


def model_line(found: DataFrame, review: float) -> float | None:
    """The least cosine from which the model's owner may be suggested where spelling finds none: above every foreign name's, and where most more
    suggestions are right than wrong; None if none are."""
    foreign = found.where("want IS NULL").agg(F.max("cosine")).first()[0]
    floor = max(LINES[0], (foreign or 0.0) + STEP)
    unknown = found.where((F.col("score") < review) & F.col("want").isNotNull())
    gain = lambda line: F.coalesce(F.sum(F.when(F.col("cosine") >= line, F.when(F.col("model_right"), 1).otherwise(-1))), F.lit(0))
    lines = [x for x in LINES if x >= floor]
    gains = unknown.agg(*(gain(x).alias(str(k)) for k, x in enumerate(lines))).first() if lines else ()
    best = max(range(len(lines)), key=lambda k: (gains[k], -k), default=None)
    return lines[best] if best is not None and gains[best] > 0 else None


def calibrate(found: DataFrame, default: Thresholds = Thresholds()) -> Thresholds:
    """Bounds by which none, or the fewest, of the cases are accepted wrongly, then the fewest misspelt ones go to review, then the model's word counts least."""
    review = review_bound(found)
    best = sweep(found, review, default.accept).orderBy("wrong", "reviews", F.desc("margin")).first()
    return replace(default, accept=best.accept, review=review, veto=best.margin, suggest=model_line(found, review))


def report(found: DataFrame, limits: Thresholds) -> DataFrame:
    """group, kind: cases, the share whose best owner is right, shares accepted, sent to review and unknown, those accepted wrongly, and the share of
    suggestions for review that are right. Names that aren't in the catalog count as accepted or sent to review if they get an owner."""
    auto = (F.col("score") >= limits.review) & (F.col("score") >= limits.accept) & _free(F.lit(limits.veto))
    rescued = F.lit(False) if limits.suggest is None else (F.col("score") < limits.review) & F.coalesce(F.col("cosine") >= limits.suggest, F.lit(False))
    unknown = (F.col("score") < limits.review) & ~rescued
    right = F.when(rescued, F.col("model_right")).otherwise(F.col("right"))
    share = lambda c: r4(F.avg(F.when(c, 1.0).otherwise(0.0)))
    waits = ~auto & ~unknown
    return found.groupBy("group", "kind").agg(
        F.count("*").alias("n"), share(right).alias("top1"), share(auto).alias("accepted"), F.count_if(auto & ~right).alias("wrong"),
        share(waits).alias("review"), r4(F.avg(F.when(waits, F.when(right, 1.0).otherwise(0.0)))).alias("review_right"), share(unknown).alias("unknown"),
    )


def to_json(limits: Thresholds) -> str:
    """The bounds as text."""
    return json.dumps(asdict(limits))


def from_json(text: str) -> Thresholds:
    return Thresholds(**json.loads(text))

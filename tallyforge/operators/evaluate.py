"""How many injected price errors the layers find."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import r4
from ..sources.files import scratch, written
from . import anomaly, features, forest
from .quantiles import LIMIT, flowing_quantiles

KINDS = ("times_ten", "tenth", "plus_60", "inverted")
#: Copies of the table, and the share of sets that get an error in each, as one in so many.
ROUNDS, ONE_IN = 8, 40
LAYERS = ("statistics", "ladder", "forest")
CHANNELS = ("farmgate", "wholesale", "retail")


def injected(df: DataFrame, every: int = 97) -> DataFrame:
    """Every so many rows, by k, get one of four errors in turn; the last takes retail to 0.7 of the set's farm-gate price."""
    turn = F.floor(F.col("k") / every) % 4
    hit = F.col("k") % every == 0
    asked = written(df.where(hit & (turn == 3) & (F.col("channel") == "retail")).select(*anomaly.SET).distinct())  # the only sets whose farm-gate price is asked for
    farm = written(anomaly.ladder(df.join(asked, anomaly.SET, "left_semi")).select(*anomaly.SET, "farmgate"))
    rows = df.join(farm, anomaly.SET, "left")
    kind = F.when(hit & (turn == 0), KINDS[0]).when(hit & (turn == 1), KINDS[1]).when(hit & (turn == 2), KINDS[2]).when(hit & (F.col("channel") == "retail") & F.col("farmgate").isNotNull(), KINDS[3])
    price = F.when(F.col("kind") == KINDS[0], F.col("price") * 10).when(F.col("kind") == KINDS[1], F.col("price") / 10).when(F.col("kind") == KINDS[2], F.col("price") * 1.6).when(F.col("kind") == KINDS[3], F.col("farmgate") * 0.7).otherwise(F.col("price"))
    return rows.withColumn("kind", kind).withColumn("price", price).drop("farmgate")


def recall(df: DataFrame) -> DataFrame:
    """Kind of error (null: untouched rows): rows, share found by statistics, by the ladder, by either."""
    rows = written(injected(df))
    stats = anomaly.price_outliers(rows).select("id", F.lit(1).alias("s")).distinct()
    rules = anomaly.ladder_violations(rows).select(F.col("record_id").alias("id"), F.lit(1).alias("l")).distinct()
    found = stats.join(rules, "id", "full")
    both = rows.select("id", "kind").join(found, "id", "left")
    share = lambda c: r4(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return both.groupBy("kind").agg(F.count("*").alias("n"), share(F.col("s").isNotNull()).alias("statistics"), share(F.col("l").isNotNull()).alias("ladder"), share(F.col("s").isNotNull() | F.col("l").isNotNull()).alias("either"))


def _drawn(*parts: Column | str) -> Column:
    """A number of 28 bits that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def rounds(df: DataFrame, copies: int = ROUNDS, one_in: int = ONE_IN) -> DataFrame:
    """Copies of priced rows, each with errors of its own in one of so many sets (date, market, commodity): one error a set.

    The copy is put before id, market, province and commodity, so that every group by them stays within its copy and all
    copies go through a layer in one plan. Adds round, kind (of the set's error; null without) and injected (the row that got it). A set with
    farm-gate and retail prices may have its retail price put to 0.7 of the farm-gate one; any set one row's price times ten, a tenth or up by 60 %.
    Sets are drawn by a hash, so that reruns agree and no copy is sorted."""
    rows = anomaly.priced(df).where("coalesce(market, '') <> ''").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.withColumn("draw", _drawn("round", "date", "market", "commodity"))
    hit = rows.where(F.col("draw") % one_in == 0)
    last = lambda c, what: F.max_by(what, F.when(F.col("channel") == c, F.struct("seq", "id")))
    some = F.min_by("id", F.struct(_drawn("round", "id"), "id"))
    sets = hit.groupBy("round", *anomaly.SET).agg(F.first("draw").alias("draw"), some.alias("some"), last("farmgate", "price").alias("farm"), last("retail", "id").alias("retail_id"))
    turn = F.floor(F.col("draw") / one_in)
    kind = F.when(F.col("farm").isNotNull() & F.col("retail_id").isNotNull(), turn % 4).otherwise(turn % 3)
    sets = sets.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (kind + 1).cast("int")))
    sets = sets.select("round", *anomaly.SET, "kind", "farm", F.when(F.col("kind") == KINDS[3], F.col("retail_id")).otherwise(F.col("some")).alias("target"))
    out = rows.drop("draw").join(sets, ["round", *anomaly.SET], "left").withColumn("injected", F.coalesce(F.col("id") == F.col("target"), F.lit(False)))
    price = F.col("price")
    wrong = F.when(F.col("kind") == KINDS[0], price * 10).when(F.col("kind") == KINDS[1], price / 10).when(F.col("kind") == KINDS[2], price * 1.6).otherwise(F.col("farm") * 0.7)
    apart = {c: F.concat_ws("|", "round", c) for c in ("id", "market", "province", "commodity")}
    return out.withColumn("price", F.when(F.col("injected"), wrong).otherwise(price)).drop("farm", "target").withColumns(apart)


def flags(rows: DataFrame, model: forest.Forest | None) -> DataFrame:
    """id, layer of rows that a layer finds; a forest finds rows over its threshold with a strong signal."""
    found = [anomaly.price_outliers(rows).select("id", F.lit(LAYERS[0]).alias("layer")), anomaly.ladder_violations(rows).select(F.col("record_id").alias("id"), F.lit(LAYERS[1]).alias("layer"))]
    if model is not None:
        strong = (F.col("score") >= model.threshold) & (F.array_max("signal") >= forest.SIGNAL)
        found.append(forest.score(features.price_features(rows), model).where(strong).select("id", F.lit(LAYERS[2]).alias("layer")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def layer_recall(rows: DataFrame, found: DataFrame) -> DataFrame:
    """kind, layer, n, share: of the sets with an error of this kind the share in which a layer finds any row; where kind is null, of the rows of
    untouched sets the share that is found. The kind ``any`` is of all errors, the layer ``all`` of any layer; layers that find nothing have 0."""
    layers = F.array(*(F.lit(x) for x in (*LAYERS, "all")))
    both = found.unionByName(found.select("id", F.lit("all").alias("layer"))).distinct()
    unit = F.when(F.col("kind").isNotNull(), F.concat_ws("|", "date", "market", "commodity")).otherwise(F.col("id"))
    asked = rows.select("id", "round", "kind", unit.alias("unit"))
    hits = asked.join(both, "id").select("unit", "kind", "layer").distinct().groupBy(F.col("kind").alias("of"), F.col("layer").alias("by")).agg(F.count("*").alias("hits"))
    totals = asked.select("unit", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n")).withColumn("layer", F.explode(layers))
    each = totals.join(hits, F.col("kind").eqNullSafe(F.col("of")) & (F.col("layer") == F.col("by")), "left").select("kind", "layer", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    every = each.where("kind IS NOT NULL").groupBy("layer").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit("any").alias("kind"), "layer", "n", "hits")
    return each.unionByName(every).select("kind", "layer", "n", r4(F.col("hits") / F.col("n")).alias("share"))


def kept(df: DataFrame, copies: int = ROUNDS, one_in: int = ONE_IN, more: tuple[Column | str, ...] = (), by: tuple[str, ...] = tuple(anomaly.SET)) -> DataFrame:
    """Priced rows with what ``rounds`` would do to them, once and not in copies: ``errors`` has, for the rounds that give the row's set an error, its
    kind and the set's last prices by channel after it; prices has the row's own price in the rounds that change it. Sets are put together by one shuffle; a set's rows are of one task.

    The rows' own: last (the last of its channel in its set), again (an id that the set has already), lead (one row of each set), the set's last
    prices if it has several channels, and unit (names the set where it has several rows and errors). Rows of one id are of one set. Rows without
    a market are in no copy: copied tells. ``more`` columns are kept as well. Rows are dealt out by ``by``, columns of a set."""
    copied = F.coalesce(F.col("market"), F.lit("")) != ""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small files apart, which many tasks read later
    rows = anomaly.priced(df).select("seq", "id", *anomaly.SET, "channel", "price", *(c for c in more if c not in anomaly.SET)).repartition(parts, *by)
    rows = rows.withColumn("text", F.concat_ws("|", "date", "market", "commodity"))
    rows = rows.withColumns({f"draw_{r}": _drawn(F.lit(r), "text") for r in range(1, copies + 1)})
    hit = copied & F.col("date").isNotNull()
    rows = rows.withColumns({f"draw_{r}": F.when(hit & (F.col(f"draw_{r}") % one_in == 0), F.col(f"draw_{r}")) for r in range(1, copies + 1)})
    whole, ordered = Window.partitionBy(*anomaly.SET), Window.partitionBy(*anomaly.SET).orderBy("id")
    rows = rows.withColumns({"again": F.coalesce(F.lag("id").over(ordered) == F.col("id"), F.lit(False)), "lead": F.row_number().over(ordered) == 1})
    own = F.struct("seq", "id", "price")
    several = {f"last_{c}": F.max(F.when(copied & (F.col("channel") == c), own)).over(whole) for c in CHANNELS}
    several |= {f"some_{r}": F.min(F.when(F.col(f"draw_{r}").isNotNull(), F.struct(_drawn(F.lit(r), "id").alias("draw"), "id", "price"))).over(whole) for r in range(1, copies + 1)}
    rows = rows.withColumns(several | {"size": F.count("*").over(whole)})
    farm, retail = F.col("last_farmgate.price"), F.col("last_retail.id")

    def error(h: Column) -> Column:
        some = h.some
        turn = F.floor(h.draw / one_in)
        turn = F.when(farm.isNotNull() & retail.isNotNull(), turn % 4).otherwise(turn % 3)
        wrong = F.when(turn == 0, some.price * 10).when(turn == 1, some.price / 10).when(turn == 2, some.price * 1.6).otherwise(farm * 0.7)
        return F.struct(h.round.alias("round"), F.element_at(F.array(*map(F.lit, KINDS)), (turn + 1).cast("int")).alias("kind"), F.when(turn == 3, retail).otherwise(some.id).alias("target"), wrong.alias("wrong"))

    def told(e: Column) -> Column:
        after = lambda which, price: F.when(which == e.target, e.wrong).otherwise(price)
        ladder = (after(F.col(f"last_{c}.id"), F.col(f"last_{c}.price")).alias(c) for c in CHANNELS)
        return F.struct(e.round.alias("round"), e.kind.alias("kind"), *ladder)

    has = F.coalesce(*(F.col(f"draw_{r}") for r in range(1, copies + 1))).isNotNull()
    hits = F.filter(F.array(*(F.struct(F.lit(r).alias("round"), F.col(f"draw_{r}").alias("draw"), F.col(f"some_{r}").alias("some")) for r in range(1, copies + 1))), lambda h: h.draw.isNotNull())
    rows = rows.withColumn("errors", F.when(has, F.transform(hits, error)))
    mine = F.filter("errors", lambda e: e.target == F.col("id"))
    mine = F.when(F.size(mine) > 0, F.transform(mine, lambda e: F.struct(e.round.alias("round"), e.wrong.alias("price"))))
    many = F.size(F.array_compact(F.array(*(F.col(f"last_{c}.price") for c in CHANNELS)))) > 1
    ladder = {c: F.when(many, F.col(f"last_{c}.price")) for c in CHANNELS}
    last = F.coalesce(F.coalesce(*(F.when(F.col("channel") == c, F.col(f"last_{c}.id")) for c in CHANNELS)) == F.col("id"), F.lit(False))
    unit = F.when(has & (F.col("size") > 1), F.col("text"))
    kept_too = [c for c in df.select(*more).columns if c not in ("commodity", "channel", "price")]
    return rows.select("commodity", "channel", "price", *kept_too, copied.alias("copied"), F.col("date").isNotNull().alias("dated"), last.alias("last"), "again", "lead", unit.alias("unit"), *(ladder[c].alias(c) for c in CHANNELS), F.when(F.col("errors").isNotNull(), mine).alias("prices"), F.transform("errors", told).alias("errors"))


def in_rounds(rows: DataFrame, first: int, last: int, prices_only: bool = False) -> DataFrame:
    """Rows of ``kept`` as they are in each round; round 0 has them without errors. Nothing is shuffled or written for that."""
    few = F.sequence(F.lit(first), F.lit(last))
    if first == 0:
        few = F.when(F.col("copied"), few).otherwise(F.array(F.lit(0)))
    else:
        rows = rows.where("copied")
    of = lambda c: F.when(F.col(c).isNotNull(), F.get(F.filter(c, lambda e: e.round == F.col("round")), F.lit(0)))
    rows = rows.withColumn("round", F.explode(few)).withColumn("price", F.coalesce(of("prices")["price"], F.col("price"))).drop("prices")
    if prices_only:
        return rows
    rows = rows.withColumn("e", of("errors"))
    ladder = {c: F.when(F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(c)) for c in CHANNELS}
    return rows.withColumns(ladder | {"kind": F.col("e.kind")}).drop("e", "errors")


def peer_stats(rows: DataFrame, first: int, last: int, least: int) -> DataFrame:
    """n, median, MAD, quartiles and fences of each peer group of at least so many rows in each round."""
    keys = ["round", *anomaly.PEERS]
    wrong = F.coalesce(F.col("prices.price"), F.array().cast("array<double>"))
    low, high = F.least("price", F.array_min(wrong)), F.greatest("price", F.array_max(wrong))
    rounds_of = (rows if first == 0 else rows.where("copied")).groupBy(*anomaly.PEERS).agg(F.count("*").alias("every"), F.count_if("copied").alias("copies"), F.min(low).alias("lo"), F.max(high).alias("hi"))
    sizes = rounds_of.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("n", F.when(F.col("round") == 0, F.col("every")).otherwise(F.col("copies"))).where(F.col("n") >= least)
    sizes = written(sizes.select(*keys, "n", "lo", "hi"))
    now = in_rounds(rows.select(*anomaly.PEERS, "price", "prices", "copied"), first, last, prices_only=True).select(*keys, "price")
    q = flowing_quantiles(now.withColumnRenamed("price", "v"), sizes, keys, (0.25, 0.5, 0.75))
    q = written(q.select(*keys, "n", *(F.col("q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3")))))
    off = lambda c: F.abs(F.col(c) - F.col("median"))
    bounds = sizes.join(q.select(*keys, "median"), keys).select(*keys, "n", F.lit(0.0).alias("lo"), F.greatest(off("lo"), off("hi")).alias("hi"))
    mad = flowing_quantiles(now.join(q.select(*keys, "median"), keys).select(*keys, off("price").alias("v")), bounds, keys)
    out = q.join(mad.select(*keys, F.col("q")[0].alias("mad")), keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    return written(out.withColumns({"peers": F.col("n"), "lower": F.col("q1") - 1.5 * F.col("iqr"), "upper": F.col("q3") + 1.5 * F.col("iqr")}))


def found_by_rules(rows: DataFrame) -> dict[str, Column]:
    """Whether statistics, whether the ladder finds a row of ``in_rounds`` that has its peers' figures."""
    outside = (F.abs(r4(anomaly.robust_z())) >= anomaly.Z_LIMIT) | (F.col("price") < F.col("lower")) | (F.col("price") > F.col("upper"))
    farm, whole, retail = map(F.col, CHANNELS)
    blamed = F.when(F.col("channel") == CHANNELS[1], farm > whole).when(F.col("channel") == CHANNELS[2], F.coalesce(whole > retail, F.lit(False)) | F.coalesce(farm > retail, F.lit(False)))
    return {LAYERS[0]: (F.col("n") >= anomaly.LEAST_PEERS) & outside, LAYERS[1]: F.col("last") & blamed}


def counted(rows: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """``layer_recall`` of rows that have a column for each layer. Only the rows of sets that have several are shuffled to their set."""
    flags = {x: F.coalesce(F.col(x), F.lit(False)).cast("long") for x in layers}
    rows = rows.select("round", "kind", "unit", "again", *(c.alias(x) for x, c in flags.items())).withColumn("all", F.greatest(*layers))
    every = [*layers, "all"]
    sums = lambda df: df.groupBy("kind").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in every))
    alone = sums(rows.where("NOT again AND (kind IS NULL OR unit IS NULL)"))
    sets = rows.where("kind IS NOT NULL AND unit IS NOT NULL").groupBy("round", "unit", "kind").agg(*(F.max(x).alias(x) for x in every))
    both = written(alone.unionByName(sums(sets)).groupBy("kind").agg(*(F.sum(x).alias(x) for x in ("n", *every))))
    each = both.select("kind", F.inline(F.array(*(F.struct(F.lit(x).alias("layer"), "n", F.col(x).alias("hits")) for x in every))))
    total = each.where("kind IS NOT NULL").groupBy("layer").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit("any").alias("kind"), "layer", "n", "hits")
    return each.unionByName(total).select("kind", "layer", "n", r4(F.col("hits") / F.col("n")).alias("share"))


def by_market(df: DataFrame) -> DataFrame:
    """``written`` in as many buckets by market as there are shuffle partitions, so that rows needn't be shuffled to their market."""
    where, name = scratch(df.sparkSession), f"tallyforge_{uuid.uuid4().hex}"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", where).option("compression", "zstd").bucketBy(parts, "market").saveAsTable(name)
    return df.sparkSession.table(name)


def featured(rows: DataFrame, copies: int) -> Callable[[int, int], DataFrame]:
    """Features of ``kept`` rows, by market, and what statistics and the ladder find, in the rounds from and to which one asks: made in flight, from figures of peers, markets, provinces and ladders in each
    round. What is typical of round 0 are its own ratios, of the copies those of all."""
    keys = ["round", *anomaly.PEERS]
    stats = peer_stats(rows, 0, copies, features.LEAST_PEERS)
    ratio = F.coalesce(F.col("price") / F.col("median"), F.lit(1.0))
    place = F.when(F.col("round") == 0, F.col("province")).otherwise(F.concat_ws("|", "round", "province")).alias("place")

    def ratios(*more: str, of: DataFrame = rows) -> DataFrame:
        now = in_rounds(of.select(*anomaly.PEERS, "price", "prices", "copied", *more), 0, copies, prices_only=True)
        return now.join(stats.select(*keys, "median"), keys, "left").withColumn("v", ratio)

    sizes = written(rows.where("market IS NOT NULL").groupBy("market").agg(F.count("*").alias("size")))
    large = written(sizes.where(F.col("size") > LIMIT).select("market"))
    some = rows.where("market IS NOT NULL")
    if not large.isEmpty():
        many = ratios("market", of=some.join(large, "market", "left_semi")).select("market", "round", "v")
        counts = many.groupBy("market", "round").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        some = some.join(large, "market", "left_anti")
    each = ratios("market", of=some).groupBy("market", "round").agg(F.percentile("v", 0.5).alias("m"))  # buckets aren't shuffled
    if not large.isEmpty():
        each = each.unionByName(flowing_quantiles(many, counts, ["market", "round"]).select("market", "round", F.col("q")[0].alias("m")))
    markets = written(each.groupBy("market").agg(F.map_from_entries(F.collect_list(F.struct("round", "m"))).alias("market_ratios")))
    placed = ratios("province").withColumn("place", place).where("place IS NOT NULL").select("place", "v")
    places = flowing_quantiles(placed, placed.groupBy("place").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), ["place"])
    places = written(places.select("place", F.col("q")[0].alias("province_ratio")))
    found = F.array(*(F.struct(F.lit(n).alias("ladder"), features.safe_ln(F.col(a) / F.col(b)).alias("v")) for n, a, b in features.LADDER))
    sets = in_rounds(rows.where("lead AND copied").drop("market", "province"), 0, copies).select(F.least("round", F.lit(1)).alias("some"), F.inline(found))  # as in price_features, a set without both prices counts, with the least logarithm
    typical = flowing_quantiles(sets, sets.groupBy("some", "ladder").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), ["some", "ladder"])
    typical = {(t.some, t.ladder): t.q[0] for t in typical.collect()}

    def made(first: int, last: int) -> DataFrame:
        now = in_rounds(rows.join(markets, "market", "left"), first, last).withColumn("place", place)
        now = now.join(stats, keys, "left").join(F.broadcast(places), "place", "left")
        now = now.withColumns({"r": ratio, "market_ratio": F.col("market_ratios")[F.col("round")]})
        for (name, _, _), usual in zip(features.LADDER, features.TYPICAL, strict=True):
            now = now.withColumn(f"typical_{name}", F.lit(typical.get((min(first, 1), name), math.log(usual))).cast("double"))
        now = now.withColumns(found_by_rules(now))
        return features.vectors(now.withColumns({c: F.when(F.col("dated"), F.col(c)) for c in CHANNELS}))  # as rows without a date meet no set in price_features

    return made


def fitted(df: DataFrame, copies: int, one_in: int) -> tuple[forest.Forest, Callable[[int, int], DataFrame]]:
    """The forest of ``forest.train`` for the rows as they are, and their features by round. Ids are kept of the rows that the trees may sample, those of the least hashes."""
    n, hashed, rows = forest.TREES * forest.SAMPLE, F.xxhash64("id"), anomaly.priced(df).count()
    bounds = [int(-(2**63) + 2**64 * (4 * n / rows))] if rows > 8 * n else []
    for bound in (*bounds, None):
        sampled = (F.lit(True) if bound is None else hashed <= bound).alias("may")
        base = by_market(kept(df.withColumn("sampled", F.when(sampled, F.col("id"))), copies, one_in, ("market", "province", "sampled"), ("market",)))
        if base.where("sampled IS NOT NULL").count() >= min(n, rows):
            break
    made = featured(base, copies)
    first = made(0, 0).where("sampled IS NOT NULL").orderBy(F.xxhash64("sampled"), "sampled").limit(n).select(*features.NAMES).collect()
    x = np.array([list(r) for r in first], float).reshape(-1, len(features.NAMES))
    model = forest.fit(x)
    if len(x):
        model.threshold = math.floor(forest.quantile(forest.score(made(0, 0), model), "score", forest.QUANTILE) * 1e4 + 0.5) / 1e4
    return model, made


def layered(df: DataFrame, copies: int = ROUNDS, one_in: int = ONE_IN, with_forest: bool = True) -> DataFrame:
    """``layer_recall`` of all layers over copies with injected errors; the forest is fitted to the rows as they are.

    The copies are those of ``rounds``, but none is written or shuffled: rows are kept once, with their errors, and read for every copy."""
    if with_forest:
        model, made = fitted(df, copies, one_in)
        now = made(1, copies).withColumn("signal", F.array_max("signal"))
        asked = ("round", "kind", "unit", "again", *LAYERS)
        strong = forest.score(now.where(F.col("signal") >= forest.SIGNAL), model).withColumn(LAYERS[2], F.col("score") >= model.threshold)
        weak = now.where(F.col("signal") < forest.SIGNAL).withColumn(LAYERS[2], F.lit(False))
        return counted(strong.select(*asked).unionByName(weak.select(*asked)), LAYERS)
    rows = written(kept(df.where("coalesce(market, '') <> ''"), copies, one_in))
    now = in_rounds(rows, 1, copies).join(peer_stats(rows, 1, copies, anomaly.LEAST_PEERS), ["round", *anomaly.PEERS], "left")
    return counted(now.withColumns(found_by_rules(now)), LAYERS[:2])

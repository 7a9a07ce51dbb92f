"""Mixing sources to target weights.

Words of each source are packed, in a fixed pseudorandom order of documents, into blocks of ``block_words``; the mix
is a list of slots, dealt to output shards. Each shard draws its count of slots per source from a multinomial over
what the sources' targets still lack, so that the totals come out exactly; slot j of a source with n blocks takes
block p(j mod n), where p is a pseudorandom permutation of the source for epoch j div n. Blocks are joined to slots
by (source, block). A source's last slot may be cut short to meet its target to the word. The draws decide which shard a block's
words go to: ``mix`` says so of each document, ``shard_segments`` lists the shards themselves. There is a shard for about ``SHARD_SLOTS``
slots, and ``MAX_SHARDS`` at most.

No document is taken more than twice, as targets stop at twice a source's size. A null source is a source of its
own, last in order. Null and empty texts have size 0 and are never taken. Repeated rows are separate documents.
An empty table gives no rows. Texts of any length are taken whole: one of many blocks has a row for each block, never all its words in one. Ties
in the order of documents are broken by size and text, and rows equal in all of these may change places. Columns of other names are not read by ``mix``, and
kept by ``mixed_documents``, whose own ones get names that clash with none. Sources are collected to the driver, a row each: at most ``max_sources``, or it stops.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights by a source's place, repeating; the mix's share of all words; the most a source is repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, MAX_SOURCES = 256, 100_000
SHARD_SLOTS, MAX_SHARDS = 1 << 16, 10_000
#: Slots in one row of the plan before they are spread out.
RUN = 1 << 14
#: Documents of a source that are ordered together, and the buckets beyond which there are more, up to so many.
BUCKET_ROWS, BUCKETS, MOST_ROWS = 500, 1 << 16, 100_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source, in order: ``share`` of all words by weight; what exceeds ``most`` sizes is dealt again."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    w = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    while free and left > 0:
        total = sum(w[k] for k in free)
        full = [k for k in free if left * w[k] / total >= most * sizes[k]]
        if not full:
            for k in free:
                out[k] = left * w[k] / total
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        free = [k for k in free if k not in set(full)]
    return out


def _key(seed: int, *parts: int) -> np.ndarray:
    raw = hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=32).digest()
    return np.frombuffer(raw, np.uint64).copy()


def permute(index: np.ndarray, n: int, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) by a four-round Feistel network, walking cycles back into range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def mixed(x, k):
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & mask

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for k in key[::-1] if inverse else key:
            if inverse:
                a, b = b ^ mixed(a, k), a
            else:
                a, b = b, a ^ mixed(b, k)
        return a << np.uint64(half) | b

    out = once(np.asarray(index, np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


@dataclass
class Source:
    key: str
    size: int
    target: float
    blocks: int
    slots: int
    cut: int
    """Words of the last slot."""
    rows: int = 0


def _plan(key: str, place: int, size: int, target: float, block: int, seed: int) -> Source:
    blocks = -(-size // block)
    words = round(target)
    if not words or not size:
        return Source(key, size, target, blocks, 0, 0)
    epochs, left = divmod(words, size)
    if not left:
        epochs, left = epochs - 1, size
    last = int(permute(np.array([blocks - 1]), blocks, _key(seed, place, epochs), inverse=True)[0])
    short = blocks * block - size  # what the last block lacks
    slots = -(-left // block)
    if last < slots and left > slots * block - short:
        slots += 1
    before = (slots - 1) * block - (short if last < slots - 1 else 0)
    return Source(key, size, target, blocks, epochs * blocks + slots, left - before)


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each shard (rows) and source, from multinomials over what is lacking; columns sum to ``slots``."""
    rng, lack, out = np.random.default_rng(seed), np.array(slots, np.int64), []
    for k in range(shards):
        rest = need = -(-int(lack.sum()) // (shards - k))
        drawn = np.zeros(len(lack), np.int64)
        while rest:
            more = np.minimum(rng.multinomial(rest, lack_p) if (lack_p := (lack - drawn) / (lack - drawn).sum()).size else 0, lack - drawn)
            drawn += more
            rest = need - int(drawn.sum())
        lack = lack - drawn
        out.append(drawn)
    return np.array(out, np.int64).reshape(shards, len(slots))


def shards_for(sources: list[Source], shards: int | None = None) -> int:
    """The number of shards: as given, else by the number of slots."""
    return shards or max(1, min(MAX_SHARDS, -(-sum(s.slots for s in sources) // SHARD_SLOTS)))


def _facts(id_col: str, text_col: str, source_col: str) -> dict:
    source = F.col(source_col).cast("string")
    return {
        "doc_id": F.col(id_col).cast("long"),
        "src": F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long"),
        "h": F.xxhash64(text_col),
    }


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in _facts(id_col, text_col, source_col).items() if n != "h"))


def plan_sources(sized: DataFrame, block: int, seed: int, max_sources: int = MAX_SOURCES) -> list[Source]:
    rows = sized.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    rows = sorted(rows, key=lambda r: (r.src == "n", r.src))
    wanted = targets([r.size for r in rows])
    return [replace(_plan(r.src, k, r.size, t, block, seed), rows=r.n) for k, (r, t) in enumerate(zip(rows, wanted, strict=True))]


def slot_blocks(spark, sources: list[Source], block: int, shards: int, seed: int) -> DataFrame:
    """The mix: shard, slot (place within the shard), src, block and words (of the block, from its start)."""
    counts = shard_counts([s.slots for s in sources], shards, seed)
    ahead = np.cumsum(counts, axis=0) - counts
    within = np.cumsum(counts, axis=1) - counts
    runs = [
        (k, s.key, i, int(ahead[k, i]), int(within[k, i]), int(counts[k, i]), s.blocks, s.slots, s.cut)
        for k in range(shards) for i, s in enumerate(sources) if counts[k, i]
    ]
    plan = spark.createDataFrame(runs, "shard int, src string, place int, first long, slot0 long, n long, blocks long, slots long, cut long")
    plan = plan.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / RUN).cast("long"))))
    total = sum(s.slots for s in sources)
    tasks = min(-(-total // RUN), max(1000, total >> 21))  # tasks of a run each, of some million slots in large mixes
    plan = plan.repartition(max(1, tasks), "shard", "src", "run")
    plan = plan.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    plan = plan.withColumn("j", F.col("first") + F.col("k"))

    @F.pandas_udf("long")
    def mapped(place: pd.Series, j: pd.Series, blocks: pd.Series) -> pd.Series:
        at, out = place.to_numpy(), np.empty(len(j), np.int64)
        epoch, rest = np.divmod(j.to_numpy(), blocks.to_numpy())
        order = np.lexsort((epoch, at))
        change = (np.diff(at[order]) != 0) | (np.diff(epoch[order]) != 0)
        for rows in np.split(order, np.flatnonzero(change) + 1) if len(order) else []:
            out[rows] = permute(rest[rows], int(blocks.iat[rows[0]]), _key(seed, int(at[rows[0]]), int(epoch[rows[0]])))
        return pd.Series(out)

    return plan.select(
        "shard", (F.col("slot0") + F.col("k")).alias("slot"), "src", mapped("place", "j", "blocks").alias("block"),
        F.when(F.col("j") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block)).cast("long").alias("words"),
    )


def placed(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """Adds bucket, row (place in the bucket) and start, the words of the source before the document.

    Two levels, so that no task holds a whole source: as many buckets as its largest source needs. Equal rows may change
    places."""
    most = max([1, *(s.rows for s in sources)])
    buckets = min(-(-most // BUCKET_ROWS), max(BUCKETS, -(-most // MOST_ROWS)))
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sums = bucketed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_words"))
    ahead = sums.select("src", "bucket", (F.sum("bucket_words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("bucket_words")).alias("ahead"))
    order = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", *(["h"] if "h" in sized.columns else []))
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        bucketed.withColumns({"start": F.coalesce(inside, F.lit(0)), "row": F.row_number().over(order)})
        .join(ahead, ["src", "bucket"])
        .withColumn("start", F.col("ahead") + F.col("start"))
        .drop("ahead")
    )


def overlaps(docs: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that share words: a and b are the document's ends within the block."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    spread = docs.where("size > 0").withColumn("block", F.explode(F.sequence((start / block).cast("long"), ((end - 1) / block).cast("long"))))
    return spread.select(
        *docs.columns, "block",
        F.greatest(start - F.col("block") * block, F.lit(0)).alias("a"), F.least(end - F.col("block") * block, F.lit(block)).alias("b"),
    )


def block_use(spark, sources: list[Source], block: int, shards: int, seed: int, *by: str) -> DataFrame:
    """Of each block (and shard, if ``by`` says so) how many slots take it whole, and the words of the one that is cut short.

    It grows with the corpus, but the planner sees only the short plan that it is spread from: the hint keeps it from
    being broadcast."""
    used = slot_blocks(spark, sources, block, shards, seed).groupBy("src", "block", *by).agg(
        F.sum((F.col("words") == block).cast("long")).alias("times"), F.sum(F.when(F.col("words") < block, F.col("words")).otherwise(0)).alias("cut"),
    )
    return used.hint("merge")


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shards: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, and ``uses``: the words that each shard takes of it from each block.

    The sizes are written once to the shared folder."""
    spark = df.sparkSession
    sized = common.written(_sized(df, id_col, text_col, source_col), common.shared_dir(spark))
    sources = plan_sources(sized, block, seed)
    facts = spark.createDataFrame([(s.key, s.size, float(s.target)) for s in sources], "src string, source_size long, target double")
    docs = placed(sized, sources)
    use = block_use(spark, sources, block, shards_for(sources, shards), seed, "shard")
    words = F.col("times") * (F.col("b") - F.col("a")) + F.greatest(F.lit(0), F.least(F.col("cut"), F.col("b")) - F.col("a"))
    parts = overlaps(docs, block).join(use, ["src", "block"]).withColumn("words", words).where("words > 0")
    took = parts.groupBy("src", "bucket", "doc_id", "row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "block", "words"))).alias("uses"))
    none = F.array().cast("array<struct<shard: int, block: long, words: long>>")
    out = docs.join(took, ["src", "bucket", "doc_id", "row"], "left").join(F.broadcast(facts), "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("uses", none).alias("uses"))


def shard_segments(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The shards: for each slot the pieces of documents that it takes, in order, as shard, slot, start (words of the slot before the
    piece), src, block, doc_id, first and last (the document's words from, to)."""
    spark = df.sparkSession
    sized = common.written(_sized(df, id_col, text_col, source_col), common.shared_dir(spark))
    sources = plan_sources(sized, block, seed)
    slots = slot_blocks(spark, sources, block, shards_for(sources, shards), seed).hint("merge")
    pieces = overlaps(placed(sized, sources), block).join(slots, ["src", "block"]).where("a < words")
    first = F.col("block") * block - F.col("start") + F.col("a")
    return pieces.select("shard", "slot", F.col("a").alias("start"), "src", "block", "doc_id", first.alias("first"), (first + F.least("b", "words") - F.col("a")).alias("last"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def copies(text: str, uses: list[tuple[int, int, int]]) -> list[str]:
    """The texts that a mix makes of a document: text k has the words in ranges (first, end, times) of times k or more.

    A document that is taken whole keeps its text as it is."""
    out = []
    spans = None
    for k in range(1, max((t for *_, t in uses), default=0) + 1):
        runs: list[list[int]] = []
        for a, b, times in sorted(uses):
            if times < k or a == b:
                continue
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        if spans is None:
            spans = [m.span() for m in _WORD.finditer(text)]
        if runs == [[0, len(spans)]]:
            out.append(text)
        elif runs:
            out.append(" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out


class _Copying:
    """Rows of documents beside their uses become the rows of the mix."""

    def __init__(self, names: list[str], text_col: str):
        self.names, self.text_col = names, text_col

    def __call__(self, batches):
        for batch in batches:
            for part in common.chunks(batch):
                texts, uses = (part.column(k).to_pylist() for k in (self.names.index(self.text_col), len(self.names)))
                rows, made = [], []
                for k, (t, u) in enumerate(zip(texts, uses, strict=True)):
                    for text in copies(t or "", [(x["a"], x["b"], x["times"]) for x in u or []]):
                        rows.append(k)
                        made.append(text)
                taken = part.select(self.names).take(pa.array(rows, pa.int64()))
                for name, values in ((self.text_col, made), ("n_chars", list(map(len, made)))):
                    if name in self.names:
                        k = self.names.index(name)
                        taken = taken.set_column(k, taken.schema.field(k), pa.array(values, taken.schema.field(k).type))
                yield taken


def mixed_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix as documents, with all columns of ``df``: a row for each time that a document, or a part of it, is taken.

    ``n_chars``, where there is one, follows the text. Documents that the mix doesn't take are left out."""
    spark = df.sparkSession
    facts = _facts(id_col, text_col, source_col)
    own = {n: common.fresh(n, df) for n in (*facts, "nth", "uses")}
    sized = df.select("*", *(c.alias(own[n]) for n, c in facts.items()))
    slim = sized.select(*(F.col(own[n]).alias(n) for n in ("doc_id", "src", "size", "h")))
    slim = common.written(slim, common.shared_dir(spark))
    sources = plan_sources(slim, block, seed)
    use = block_use(spark, sources, block, shards_for(sources, shards), seed)
    docs = placed(slim, sources)
    parts = overlaps(docs, block).join(use, ["src", "block"])
    first, a, b = F.col("block") * block - F.col("start"), F.col("a"), F.col("b")
    c = F.least(F.greatest(F.col("cut"), a), b)  # the words before c are taken once more
    ranges = F.array(
        F.struct((first + a).alias("a"), (first + c).alias("b"), (F.col("times") + 1).alias("times")),
        F.struct((first + c).alias("a"), (first + b).alias("b"), F.col("times").alias("times")),
    )
    uses = parts.groupBy("src", "bucket", "row", "doc_id", "h").agg(F.flatten(F.collect_list(ranges)).alias("uses"))
    # rows of one id, source and text are alike: the n-th of them gets the n-th uses
    alike = Window.partitionBy("doc_id", "h", "src").orderBy("row")
    uses = uses.withColumn("nth", F.row_number().over(alike)).select("doc_id", "h", "src", "nth", "uses")
    numbered = sized.withColumn(own["nth"], F.row_number().over(Window.partitionBy(own["doc_id"], own["h"], own["src"]).orderBy(F.lit(0))))
    keys = [F.col(f"l.`{own[k]}`").eqNullSafe(F.col(f"r.{k}")) for k in ("doc_id", "h", "src", "nth")]
    joined = numbered.alias("l").join(uses.alias("r"), keys)
    rows = joined.select(*(F.col(f"l.`{n}`") for n in df.columns), F.col("r.uses").alias(own["uses"]))
    return rows.mapInArrow(common.Tidied(_Copying(df.columns, text_col)), df.schema)

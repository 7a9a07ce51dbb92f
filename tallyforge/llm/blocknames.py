"""Exact duplicates by deterministic block naming; DataFrame functions alone.

A text, less its white space (``[\\x20\\x09-\\x0D]``), is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and
numbered: a block's place is its integer name. Then adjacent pairs of names are sorted and numbered in the same way, level
by level, until each document has a single name. Equal texts have equal names and different texts never do: the last
block alone may be short, a name without a neighbour is paired with none, and names of a level begin behind those of the one before.

Blocks are sorted by a key of 128 bits instead of all their bytes. That this key tells all distinct blocks of the corpus apart is
checked on the blocks themselves in each run; if it doesn't, the run takes keys of another seed. So names rest on equal
bytes, not on luck, while blocks are shuffled once, combined before, and all sorts and joins move 16 bytes a block.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id (null ids last); of
rows alike in both, one. Null counts as empty, and empty texts are equal to each other. Repeated rows are separate rows of one group.
An empty table gives no rows. Texts of any length are taken whole: a text of n blocks takes log2(n) levels. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: The characters that are deleted.
WHITE = (" ", "\t", "\n", "\v", "\f", "\r")
_SEQ = (1 << 33) - 1


def normal(text: Column) -> Column:
    """The text without white space, null as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def seeded(block: Column, seed: int) -> tuple[Column, Column]:
    """The sort key of a block: two 64-bit numbers."""
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _blocks(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each block of ``bytes``: the kept columns, pos, n (blocks of the text) and block."""
    n = F.greatest(F.ceil(F.octet_length("bytes") / size), F.lit(1)).cast("int")
    spread = docs.withColumn("n", n).withColumn("pos", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)))
    return spread.select(*keep, "pos", "n", F.substring(F.col("bytes"), F.col("pos") * size + 1, F.lit(size)).alias("block"))


def tells_apart(blocks: DataFrame, key: Callable[[Column, int], tuple[Column, Column]], seed: int) -> bool:
    """Whether no two distinct blocks have one key."""
    k1, k2 = key(F.col("block"), seed)
    distinct = blocks.select(k1.alias("k1"), k2.alias("k2"), "block").distinct()
    return distinct.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def named(keys: DataFrame, where: str, base: int) -> DataFrame:
    """Distinct keys with ``name``: ``base`` plus their place in sorted order, whatever the partitions."""
    by = keys.columns
    run = keys.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("at"))
    run = common.written(run, where)
    part = F.shiftright("at", 33).alias("part")
    sizes = run.groupBy(part).agg(F.count("*").alias("rows"))  # a row for each task of the sort
    ahead = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"))
    return run.select(*by, "at", part).join(ahead, "part").select(*by, (F.lit(base) + F.col("ahead") + F.col("at").bitwiseAND(F.lit(_SEQ))).alias("name"))


def identities(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key: Callable[[Column, int], tuple[Column, Column]] = seeded) -> tuple[DataFrame, str]:
    """row, doc_id, n_chars, text_sha256 and name (equal for equal texts alone) of every row, and the folder of the run."""
    where = common.shared_dir(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("n_chars"), normal(F.col(text_col)).cast("binary").alias("bytes"))
    seed = 0
    while not tells_apart(_blocks(docs, block), key, seed):
        seed += 1
    told = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("bytes", 256).alias("text_sha256"), "bytes")
    facts = ("doc_id", "n_chars", "text_sha256")
    k1, k2 = key(F.col("block"), seed)
    cut = _blocks(told, block, "row", *facts).select("row", "pos", "n", k1.alias("k1"), k2.alias("k2"), *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in facts))
    cut = common.written(cut, f"{where}/blocks")
    names = common.written(named(cut.select("k1", "k2").distinct(), f"{where}/order-0", 0), f"{where}/names-0")
    level = common.written(cut.select("row", "pos", "n", "k1", "k2").join(names, ["k1", "k2"]).select("row", "pos", "n", "name"), f"{where}/level-0")
    whole, base, step = level.where("n = 1").select("row", "name"), 0, 0
    longest = cut.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        base += names.count()
        step, longest = step + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.where("n > 1").groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = common.written(pairs, f"{where}/pairs-{step}")
        names = common.written(named(pairs.select("a", "b").distinct(), f"{where}/order-{step}", base), f"{where}/names-{step}")
        level = pairs.join(names, ["a", "b"]).select("row", "pos", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), "name")
        level = common.written(level, f"{where}/level-{step}")
        whole = whole.union(level.where("n = 1").select("row", "name"))
    return common.written(cut.where("pos = 0").select("row", *facts).join(whole, "row"), f"{where}/identities"), where


def duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key: Callable[[Column, int], tuple[Column, Column]] = seeded) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows, where = identities(df, id_col=id_col, text_col=text_col, block=block, key=key)
    first = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = common.written(rows.groupBy("name").agg(F.count("*").alias("group_size"), first.alias("first")), f"{where}/groups")
    return rows.join(groups, "name").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of documents that stay (by their ids)."""
    keep = common.fresh("keep", df)
    kept = duplicates(df, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(keep)).distinct()
    return df.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(keep)), "left_semi")

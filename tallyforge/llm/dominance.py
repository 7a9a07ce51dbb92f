"""Dominance counting: for each row, how many rows have a smaller or equal slot and a strictly larger level.

Rows are first summed up to cells, one for each (level, slot): a hot client or day then weighs no more than any other. The cells
are range-partitioned by descending level. A task sweeps its cells from the highest level down with a Fenwick tree over
their slots: all cells of a level are looked up before any of them is inserted, so equal levels don't count each other. What
lies in higher partitions is a histogram of their slots, summed up over partitions and then over slots, and added to
each cell by (partition, slot). The counts go back to the rows by (level, slot).

A level has a cell for each slot at most, and a partition holds ``CELLS`` cells, or as many as there are slots if those are more: so
tasks stay bounded, and the histograms of all partitions together never exceed the cells. Nothing but three numbers goes to
the driver. Rows with a null slot or level count for none and get nulls; a null weight counts as 0. Ties are as above. Repeated
rows count each; an empty table gives no rows. Names of other columns may clash with none of the result, as none is read but those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Cells of a partition, unless there are more slots than that.
CELLS = 1 << 16


class Fenwick:
    """Sums over prefixes of slots 0 to n - 1, of several weights at once."""

    def __init__(self, n: int, weights: int):
        self.tree = np.zeros((n + 1, weights), np.int64)

    def add(self, slots: np.ndarray, weights: np.ndarray) -> None:
        at, left = slots + 1, weights
        while len(at):
            np.add.at(self.tree, at, left)
            at = at + (at & -at)
            keep = at < len(self.tree)
            at, left = at[keep], left[keep]

    def upto(self, slots: np.ndarray) -> np.ndarray:
        """Sums over all slots up to each of these, included."""
        out = np.zeros((len(slots), self.tree.shape[1]), np.int64)
        at = slots + 1
        while (at > 0).any():
            out += self.tree[at]  # row 0 holds zeros
            at = at & (at - 1)
        return out


def swept(level: np.ndarray, slot: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each cell, in descending order of level, the weights of cells of higher levels and no larger slots."""
    out = np.zeros_like(weights)
    kinds, at = np.unique(slot, return_inverse=True)
    tree = Fenwick(len(kinds), weights.shape[1])
    edges = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]])) if len(level) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[lo:hi] = tree.upto(at[lo:hi])
        tree.add(at[lo:hi], weights[lo:hi])
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    level, slot, n, w = (np.concatenate([p[k] for p in parts]) for k in range(4))
    inside = swept(level, slot, np.stack([n, w], axis=1))
    part = np.full(len(level), TaskContext.get().partitionId(), np.int32)
    names = ["level", "slot", "n", "w", "part", "n_in", "w_in"]
    for lo in range(0, len(level), 1 << 14):
        cols = [c[lo : lo + (1 << 14)] for c in (level, slot, n, w, part, inside[:, 0], inside[:, 1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _higher(swept_cells: DataFrame, where: str) -> DataFrame:
    """part, slot, n_up and w_up: weights of higher partitions in slots up to each slot; a row for each partition and slot."""
    own = common.written(swept_cells.groupBy("slot", "part").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), f"{where}/histograms")
    last = own.agg(F.max("part")).first()[0] or 0
    grid = own.select("slot").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    full = grid.join(own, ["slot", "part"], "left")
    before = Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = full.select("slot", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "w")))
    upto = Window.partitionBy("part").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return common.written(ahead.select("part", "slot", F.sum("n").over(upto).alias("n_up"), F.sum("w").over(upto).alias("w_up")), f"{where}/higher")


def dominating(df: DataFrame, *, slot: Column | str = "slot", level: Column | str = "level", weight: Column | str | None = None, keep: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """The columns to keep, slot, level, n_above (rows above each row) and w_above (the weights of those)."""
    where = common.shared_dir(df.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    w = F.lit(1) if weight is None else F.coalesce(as_column(weight), F.lit(0))
    s, v = as_column(slot).cast("long"), as_column(level).cast("long")
    known = df.select(v.alias("level"), s.alias("slot"), w.cast("long").alias("w")).where("level IS NOT NULL AND slot IS NOT NULL")
    cell = common.written(known.groupBy("level", "slot").agg(F.count("*").alias("n"), F.sum("w").alias("w")), f"{where}/cells")
    slots = cell.groupBy("slot").agg(F.lit(1)).count()
    tasks = max(1, -(-cell.count() // max(cells, slots)))
    down = cell.repartitionByRange(tasks, F.desc("level")).sortWithinPartitions(F.desc("level"), "slot").select("level", "slot", "n", "w")
    schema = T.StructType.fromDDL("level long, slot long, n long, w long, part int, n_in long, w_in long")
    done = common.written(down.mapInArrow(common.Tidied(_sweep), schema), f"{where}/swept")
    both = done.join(_higher(done, where).hint("merge"), ["part", "slot"])
    counts = common.written(both.select("level", "slot", (F.col("n_in") + F.col("n_up")).alias("n_above"), (F.col("w_in") + F.col("w_up")).alias("w_above")), f"{where}/counts")
    own = {c: common.fresh(c, df.select(*keep)) for c in ("slot", "level")}
    rows = df.select(*keep, s.alias(own["slot"]), v.alias(own["level"])).alias("l")
    at = [F.col(f"l.{own[c]}") == F.col(f"r.{c}") for c in ("level", "slot")]
    found = rows.join(counts.hint("merge").alias("r"), at[0] & at[1], "left")
    return found.select(*(F.col(f"l.`{c}`") for c in keep), *(F.col(f"l.{own[c]}").alias(c) for c in own), "r.n_above", "r.w_above")


def day_slot(at: Column, kind: T.DataType) -> Column:
    """Whole days since 1970 of a timestamp taken as UTC, in any session zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(at.cast("date")).cast("long")
    return F.floor(F.unix_seconds(at) / 86400).cast("long")


def sales_above(sales: DataFrame) -> DataFrame:
    """sale_id, slot (day of sale), level (tens of the total, rounded to cents), n_sales and n_rows above each sale.

    A sale stands for 1 + crc32(sale_id as text) mod 3 rows; a null id is an empty text. A total that is not finite counts as null."""
    cents = F.floor(100 * F.col("total") + F.lit(0.5)).cast("double")
    finite = ~F.isnan("total") & (F.abs("total") < F.lit(float("inf")))
    level = F.when(finite, F.floor(cents / 1000).cast("long"))
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 3
    out = dominating(sales, slot=day_slot(F.col("sold_at"), sales.schema["sold_at"].dataType), level=level, weight=weight, keep=("sale_id",))
    return out.select("sale_id", "slot", "level", *(F.when(F.col("slot").isNotNull() & F.col("level").isNotNull(), F.coalesce(c, F.lit(0))).alias(n) for c, n in (("n_above", "n_sales"), ("w_above", "n_rows"))))

"""Joins of all rows with many keys, of which most rows meet none: those rows aren't shuffled.

Keys are marked by their hash in a table of bits, whose size is fixed and which is sent to the rows. A row whose bit isn't set has none of the keys, for
certain; only rows whose bit is set are joined by the key itself. With more keys than bits more rows are joined, none is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

#: Words of 64 bits that make a row of the table, and its rows: 2 ** 27 bits, 16 MB.
WORDS, ROWS = 64, 32_768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64 * WORDS * ROWS))


def marks(keys: DataFrame, key: str) -> DataFrame:
    """at, words: the bits of all keys; rows of the table without any are left out."""
    word = keys.select(_place(F.col(key)).alias("p")).selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS int)) AS bit")
    word = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).selectExpr(f"cast(word div {WORDS} AS int) AS at", f"cast(word % {WORDS} AS int) AS nth", "bits")
    table = word.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("nth", "bits"))).alias("m"))
    return written(table.select("at", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("words")))


def told(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Adds __may: whether a row's key may be among those of the table."""
    out = rows.withColumn("__p", _place(F.col(key))).withColumn("__at", F.expr(f"cast(__p div {64 * WORDS} AS int)"))
    out = out.join(F.broadcast(table.toDF("__at", "__words")), "__at", "left")
    bit = F.expr(f"shiftright(__words[cast(__p div 64 % {WORDS} AS int)], cast(__p % 64 AS int)) & 1L")
    return out.withColumn("__may", F.coalesce(bit == 1, F.lit(False))).select(*rows.columns, "__may")


def among(rows: DataFrame, keys: DataFrame, key: str, table: DataFrame | None = None) -> DataFrame:
    """Rows whose key is among the keys, as a semi-join. ``keys`` is read twice, ``rows`` once; ``table`` are the keys' marks, where they are made already."""
    return told(rows, key, marks(keys, key) if table is None else table).where("__may").drop("__may").join(keys.select(key), key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: str, table: DataFrame | None = None) -> DataFrame:
    """Rows whose key isn't among the keys, as an anti-join. Both are read twice."""
    found = told(rows, key, marks(keys, key) if table is None else table)
    return found.where("NOT __may").unionByName(found.where("__may").join(keys.select(key), key, "left_anti").select(*found.columns)).drop("__may")

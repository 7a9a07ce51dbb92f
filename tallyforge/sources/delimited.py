"""Delimited text read in many tasks a file, quoted line breaks included, with a ledger of bad rows.

Spark cuts a file into blocks of whole lines, which are cut further into chunks of ``CHUNK`` lines. Whether a line begins within quotes depends on the
parity of all quotes before it: parities of chunks are counted and summed up by a window over chunks alone, those of lines within their chunk, so that
no task sorts a whole block. Lines of one record are then put together by the line that it begins with, which may stand in an earlier chunk.

A row of another width than the header is kept (short ones filled up, long ones cut) and listed with its file, line and number of
cells; so is a record of more than ``MOST_LINES`` lines, as a quote that is never closed makes one: its lines are taken one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_LINES = 1000
CHUNK = 10_000
#: What tells lines apart that are sorted together.
PLACE = ["file", "block", "chunk"]


@dataclass
class Table:
    rows: DataFrame
    """All columns as strings, trimmed, gaps empty."""
    bad: DataFrame
    """file, line, cells, problem and text of each row that isn't as the header says."""


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block, chunk, at (order within the file's block), value and quotes of each line."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = (F.col("block") == 0) & F.col("value").startswith("\ufeff")
    value = F.when(first, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    chunk = F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / CHUNK)  # the lower bits count a task's lines
    return text.withColumn("value", value).withColumn("chunk", chunk).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def records_of(lines: DataFrame) -> DataFrame:
    """file, line (from 1), text and broken (whether it is a line of a record that was too long) of each record."""
    inside = Window.partitionBy(*PLACE).orderBy("at")
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = lines.groupBy(*PLACE).agg(F.count("*").alias("n"), F.min("at").alias("first"), (F.sum("quotes") % 2).alias("odd"))
    chunks = chunks.select(*PLACE, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("open"))
    placed = lines.join(chunks, PLACE).withColumn("line", (F.col("ahead") + F.col("at") - F.col("first") + 1).cast("long"))
    if lines.where("quotes % 2 = 1").isEmpty():
        return placed.select("file", "line", F.col("value").alias("text"), F.lit(False).alias("broken"))
    until = F.sum("quotes").over(inside) + F.col("open")
    marked = placed.withColumn("until", until % 2).withColumn("within", (until - F.col("quotes")) % 2 == 1)
    opens = (F.col("until") == 1) & ~F.col("within")
    marked = marked.withColumn("start", F.when(~F.col("within"), F.col("line"))).withColumn("own", F.max("start").over(inside))
    last = marked.groupBy(*PLACE).agg(F.max(F.when(opens, F.col("line"))).alias("last"))
    carried = last.select(*PLACE, F.max("last").over(before).alias("carried"))
    known = marked.join(carried, PLACE).withColumn("record", F.coalesce("own", "carried", "line"))
    several = F.col("within") | (F.col("until") == 1)
    alone = known.where(~several).select("file", "line", F.col("value").alias("text"), F.lit(False).alias("broken"))
    parts = known.where(several).select("file", "record", "line", "value")
    long = parts.groupBy("file", "record").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINES).select("file", "record")
    joined = parts.join(long, ["file", "record"], "left_anti").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts"))
    joined = joined.select("file", F.col("record").alias("line"), F.array_join("parts.value", "\n").alias("text"), F.lit(False).alias("broken"))
    taken = parts.join(long, ["file", "record"], "left_semi").select("file", "line", F.col("value").alias("text"), F.lit(True).alias("broken"))
    return alone.unionByName(joined).unionByName(taken)


def head_of(lines: DataFrame, delimiters: tuple[str, ...], count: int) -> list[str]:
    """Lines from the first on that has two cells or more by any of the delimiters, wherever in the table it stands."""
    two = reduce(lambda a, b: a | b, (F.size(F.filter(F.split("value", f"[{d}]"), lambda c: F.trim(c) != "")) > 1 for d in delimiters))
    place = lines.where(two).agg(F.min(F.struct("file", "block", "at")).alias("p")).first().p
    if place is None:
        return []
    after = (F.col("file") == place.file) & (F.col("at") >= place.at)
    return [r.value for r in lines.where(after).orderBy("block", "at").limit(count).collect()]


def read(spark: SparkSession, path: str, delimiter: str, header: list[str], names: list[str]) -> Table:
    """Rows below the header and the ledger of bad ones; what stands above the header in its file is left out, and each
    further file's own header."""
    found = records_of(lines_of(spark, path))
    kind = T.StructType([*(T.StructField(f"c{k}", T.StringType()) for k in range(len(names))), T.StructField("_bad", T.StringType())])
    how = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1"}
    parsed = found.withColumn("r", F.from_csv("text", kind.simpleString(), how))
    clean = {f"c{k}": F.coalesce(F.trim(F.col(f"r.c{k}")), F.lit("")) for k in range(len(names))}
    rows = parsed.select("file", "line", "text", "broken", F.col("r._bad").isNotNull().alias("ragged"), *(c.alias(n) for n, c in clean.items()))
    told = [c.strip() for c in header]
    is_header = reduce(lambda a, b: a & b, (F.col(f"c{k}") == c for k, c in enumerate(told)))
    place = rows.where(is_header).agg(F.min(F.struct("file", "line")).alias("p")).first().p
    below = ~is_header
    if place is not None:
        below = below & ~((F.col("file") == place.file) & (F.col("line") < place.line))
    rows = rows.where(below & (F.concat_ws("", *clean) != ""))
    bare = F.regexp_replace("text", '"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    problem = F.when(F.col("broken"), "open quote").otherwise("width")
    bad = rows.where("broken OR ragged").select("file", "line", cells.alias("cells"), problem.alias("problem"), "text")
    ordered = rows.orderBy("file", "line")  # as the rows stand, for those who number them by their place
    return Table(ordered.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names))), bad)


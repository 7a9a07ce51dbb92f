"""Readers that find out what a table file is: delimited text, JSON of any nesting, XML, wide price sheets.

Headers and formats are decided on the driver from a bounded head of the file; the rows are read by Spark.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import delimited, export

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES, DEPTH = 10, 6
REFUSED = ("pdf", "doc", "docx", "odt", "rtf", "ppt", "pptx", "png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg", "zip")


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter most often in the first line, weighed by lines with the same count; ties go to the earlier."""
    lines = [x for x in lines if x.strip()][:HEAD_LINES]
    best, top = ",", 0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        score = counts[0] * counts.count(counts[0]) if lines and counts[0] else 0
        if score > top:
            best, top = d, score
    return best


def repaired_header(cells: list[str]) -> list[str]:
    """Blank names become Column n, repeated ones get a number."""
    seen: Counter[str] = Counter()
    out = []
    for k, c in enumerate(cells, 1):
        name = c.strip().lstrip("﻿") or f"Column {k}"
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def looks_binary(head: str) -> bool:
    """Over a twentieth of the first 2,000 characters are control or replacement characters."""
    part = head[:2000]
    odd = sum(c == "�" or (ord(c) < 32 and c not in "\t\n\r") for c in part)
    return bool(part) and odd > 0.05 * len(part)


def delimited_table(spark: SparkSession, path: str, delimiter: str | None = None) -> delimited.Table:
    """Rows and the ledger of bad ones. The header is the first line of the table with two cells or more, wherever it stands."""
    lines = delimited.lines_of(spark, path)
    first = [r.value for r in spark.read.text(path).limit(HEAD_LINES * 3).collect()]
    if looks_binary("\n".join(first)):
        raise ValueError("not a text file")
    head = delimited.head_of(lines, (delimiter,) if delimiter else DELIMITERS, HEAD_LINES)
    if not head:
        raise ValueError("no header")
    delimiter = delimiter or sniff_delimiter(head)
    cells = next(r for r in csv.reader(head, delimiter=delimiter) if sum(bool(c.strip()) for c in r) >= 2)
    return delimited.read(spark, path, delimiter, [c.lstrip("\ufeff") for c in cells], repaired_header(cells))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as strings, trimmed, gaps empty; lines above the header are left out.

    Rows of another width are kept: short ones are filled up, long ones lose what is beyond the header."""
    return delimited_table(spark, path, delimiter).rows


def _cells(kind: T.StructType, value: Column | None = None, path: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """Dotted names and strings of a record's leaves; without a value it is the row itself."""
    out = []
    for f in kind.fields:
        c, k, here = _field(value, f.name), f.dataType, (*path, f.name)
        if isinstance(k, T.StructType):
            out += _cells(k, c, here)
            continue
        if isinstance(k, T.ArrayType):
            inner = isinstance(k.elementType, (T.StructType, T.ArrayType, T.MapType))
            c = F.concat(F.size(c).cast("string"), F.lit(" items")) if inner else F.array_join(c.cast("array<string>"), "; ")
        elif isinstance(k, T.MapType):
            c = F.to_json(c)
        out.append((".".join(here), F.coalesce(c.cast("string"), F.lit(""))))
    return out


def _field(value: Column | None, name: str) -> Column:
    return F.col(f"`{name}`") if value is None else value.getField(name)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; lists of scalars joined by '; ', lists of structs as 'n items'; all as strings."""
    return df.select(*(c.alias(name) for name, c in _cells(df.schema)))


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _record_lists(kind: T.StructType, value: Column | None = None, path: tuple[str, ...] = ()):
    """Paths and columns of lists of structs below a schema."""
    for f in kind.fields:
        c, here = _field(value, f.name), (*path, f.name)
        if _is_list(f.dataType):
            yield here, c
        elif isinstance(f.dataType, T.StructType) and len(here) <= DEPTH:
            yield from _record_lists(f.dataType, c, here)


def _branches(kind: T.StructType, value: Column | None, context: dict[str, Column], counts: dict[tuple[str, ...], int], path: tuple[str, ...] = ()):
    """Where a document's rows are: (path, columns carried down, kind of record, list of records or None, single record)."""
    if len(path) > DEPTH:
        return []
    lists, objects, scalars = [], [], []
    for f in kind.fields:
        (lists if _is_list(f.dataType) else objects if isinstance(f.dataType, T.StructType) else scalars).append(f)
    carried = context | {name: c for name, c in _cells(T.StructType(scalars), value)}
    if lists:
        f = min(lists, key=lambda f: (-counts[*path, f.name], f.name))
        return [((*path, f.name), carried, f.dataType.elementType, _field(value, f.name), None)]
    below = []
    for f in objects:
        group = {"group": F.lit(f.name)} if len(objects) > 1 else {}
        below += _branches(f.dataType, _field(value, f.name), carried | group, counts, (*path, f.name))
    return below or [(path, context, kind, None, value)]


def json_rows(df: DataFrame, document: bool = False) -> DataFrame:
    """Rows of a JSON document: the list with most records is spread out, scalars beside it are carried down, and two or
    more sibling objects are spread out with their key in ``group``.

    Without any list, rows are records themselves unless each is a whole ``document``."""
    lists = dict(_record_lists(df.schema))
    if not lists and not document:
        return flattened(df)
    counts = dict.fromkeys(lists, 0)
    if len(lists) > 1:
        sizes = df.agg(*(F.sum(F.when(c.isNotNull(), F.size(c))).alias(f"n{k}") for k, c in enumerate(lists.values()))).first()
        counts = {path: n or 0 for path, n in zip(lists, sizes, strict=True)}
    branches = _branches(df.schema, None, {}, counts)
    if len(branches) == 1:
        path, carried, _, items, one = branches[0]
        if items is None:
            return df.select(*(c.alias(n) for n, c in (carried | dict(_cells(branches[0][2], one))).items()))
        rows = df.select(*(c.alias(n) for n, c in carried.items()), F.explode_outer(items).alias("__item"))
        fields = rows.schema["__item"].dataType.fields
        return flattened(rows.select(*(F.col(f"`{n}`") for n in carried), *(F.col(f"__item.`{f.name}`").alias(f.name if f.name not in carried else f"{path[-1]}.{f.name}") for f in fields)))

    def told(branch, item: Column) -> dict[str, Column]:
        path, carried, kind, _, _ = branch
        return carried | {n if n not in carried else f"{path[-1]}.{n}": c for n, c in _cells(kind, item)}

    names = list(dict.fromkeys(n for b in branches for n in told(b, F.lit(None))))

    def record(branch, item: Column) -> Column:
        cells = told(branch, item)
        return F.struct(*(cells.get(n, F.lit("")).alias(n) for n in names))

    def each(branch):
        return lambda item: record(branch, item)

    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names])))
    parts = []
    for b in branches:
        _, _, _, items, one = b
        made = F.array(record(b, one)) if items is None else F.transform(items, each(b))
        parts.append(F.when((one if items is None else items).isNotNull(), made).otherwise(empty))
    return df.select(F.inline(F.concat(*parts)))


def read_json(spark: SparkSession, path: str, **more) -> DataFrame:
    """A JSON list, an object with records in it, or a line for each record; ``data`` around the records is opened. Records of the
    nested price export become its flat columns, see ``export.export_rows``, which gets what else is given."""
    head = "".join(r.value for r in spark.read.text(path).limit(HEAD_LINES).collect()).lstrip("\ufeff \t\r\n")
    lines = bool(re.match(r"\{.*\}\s*$", head.split("\n")[0] if "\n" in head else head)) and spark.read.text(path).limit(2).count() > 1
    df = spark.read.json(path, multiLine=not lines)
    for records in (df, *(df.select(F.explode(F.col(f"`{f.name}`")).alias("r")).select("r.*") for f in df.schema.fields if _is_list(f.dataType))):
        if export.is_export(records):
            return export.export_rows(records, **more)
    return json_rows(df, document=not lines and head.startswith("{"))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of an XML file, cut at each ``>``: opening tags, how often they are there, and whether another one follows
    directly."""
    opens, outer, before = Counter(), set(), None
    for batch in batches:
        for text in batch.column(0).to_pylist():
            m = re.search(r"<([A-Za-z_][\w.-]*)(?:\s[^<]*)?$", text)
            if m and before and not text[: m.start()].strip():
                outer.add(before)
            before = m[1] if m and not text.endswith("/") else None
            if m:
                opens[m[1]] += 1
    yield pa.RecordBatch.from_pydict({"tag": pa.array(list(opens), pa.string()), "n": pa.array(list(opens.values()), pa.int64()), "outer": pa.array([t in outer for t in opens], pa.bool_())})


def row_tag_of(spark: SparkSession, path: str) -> str:
    """The most frequent element with others in it, of all elements of the file; without such, the most frequent one."""
    parts = spark.read.option("lineSep", ">").text(path).mapInArrow(_tally, "tag string, n long, outer boolean")
    tags = parts.groupBy("tag").agg(F.sum("n").alias("n"), F.max("outer").alias("outer"))
    row = tags.orderBy(F.desc("outer"), F.desc("n"), F.desc("tag")).first()
    if row is None:
        raise ValueError("no element")
    return row["tag"]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Rows of the most frequent repeated element; attributes and children become columns."""
    return flattened(spark.read.format("xml").option("rowTag", row_tag or row_tag_of(spark, path)).option("inferSchema", "false").load(path))


def read_table(spark: SparkSession, path: str, **more) -> DataFrame:
    """Any of the formats, by extension or else by the first character; ``more`` is for the nested price export.

    Pictures, documents and other files that aren't text are refused."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in REFUSED:
        raise ValueError(f"a .{ext} file holds no table that is read here")
    if ext == "parquet":
        df = spark.read.parquet(path)
        return export.export_rows(df, **more) if export.is_export(df) else flattened(df)
    first = next((r.value.lstrip("\ufeff \t")[:1] for r in spark.read.text(path).limit(HEAD_LINES).collect() if r.value.strip()), "")
    if ext in ("json", "ndjson", "jsonl") or (ext not in ("csv", "tsv", "xml", "txt") and first in "[{"):
        return read_json(spark, path, **more)
    if ext == "xml" or first == "<":
        return read_xml(spark, path)
    return read_delimited(spark, path, "\t" if ext == "tsv" else None)


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables one below the other by column name, gaps empty, with the name of each row's table."""
    parts = [df.withColumn("source_file", F.lit(name)) for name, df in tables.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.na.fill("")

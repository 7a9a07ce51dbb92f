"""Helpers shared by the training-data operators: Arrow batch mapping, table access, shared folders."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one output batch; keeps the Python side's memory bounded when rows are long.
CHUNK_ROWS = 128
#: Bytes of text after which an output batch is cut short.
CHUNK_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 3, is 1: rows whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK_ROWS rows, and about CHUNK_BYTES, whichever is reached first."""
    n = batch.num_rows
    rows = max(1, min(CHUNK_ROWS, int(CHUNK_ROWS * 4 * CHUNK_BYTES / max(1, batch.nbytes / max(1, n) * CHUNK_ROWS * 4))))
    for lo in range(0, n, rows):
        yield batch.slice(lo, rows)


class Tidied:
    """A function over Arrow batches that gives the memory it used back to the system when a task is done: workers are kept
    for later tasks, and what each of them had at most would add up."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)


class Mapper:
    """Applies ``make()(*columns) -> columns`` to chunks of Arrow batches; ``make`` runs once per task."""

    def __init__(self, make: Callable[[], Callable[..., Any]], schema: T.StructType):
        self.make, self.schema = make, to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = self.make()
        for batch in batches:
            for part in chunks(batch):
                columns = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Any]], schema: T.StructType | str) -> DataFrame:
    """Maps the columns of ``df`` (in order) through ``make()``; the output has ``schema``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return df.mapInArrow(Tidied(Mapper(make, schema)), schema)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one is set only where the session has none and all its tasks
    run in this process, as in tests. On a cluster without the setting it stops: executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tf-{uuid.uuid4().hex}"


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, longer by as many underscores as it takes to clash with no column of the tables."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, where: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage so that lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def filesystem(uri: str):
    """(file system, path) of a folder URI, for files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")

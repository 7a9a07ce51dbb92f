"""Shared folders for intermediate files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a local one only where the session names none and all its tasks run
    in this process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/core-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back. Its size is known from then on, so that a small one is sent to the
    rows that it is joined with, instead of shuffling these."""
    where = scratch(df.sparkSession)
    df.write.parquet(where, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(where)

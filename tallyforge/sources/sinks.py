"""Exports of records, written by the executors as folders of CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an export, in order.
COLUMNS = ("date", "province", "district", "market", "commodity", "channel", "unit", "price", "currency", "corrected")


def export_columns(df: DataFrame) -> DataFrame:
    """The columns of an export; a currency that isn't there is RWF, rows without the mark aren't corrected."""
    out = df if "currency" in df.columns else df.withColumn("currency", F.lit("RWF"))
    out = out if "corrected" in df.columns else out.withColumn("corrected", F.lit(False))
    return out.select(*COLUMNS)


def write_csv(df: DataFrame, where: str) -> None:
    """Trusted records with a header, quoted where needed, in gzip files; corrected is yes or no."""
    rows = export_columns(df).withColumn("corrected", F.when(F.col("corrected"), "yes").otherwise("no"))
    rows.write.csv(where, header=True, escape='"', emptyValue="", compression="gzip")


def write_json(df: DataFrame, where: str) -> None:
    """Trusted records, an object a line, in gzip files; corrected is true or false, gaps are null."""
    export_columns(df).write.option("ignoreNullFields", "false").json(where, compression="gzip")


def clean(trusted: DataFrame) -> DataFrame:
    """Trusted records with a price above zero."""
    return trusted.where("price > 0")

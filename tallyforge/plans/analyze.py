"""The whole analysis of an upload: records, findings, lineage, profile, coverage and score, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, anomaly, dedupe, features, forest, profile, standardize
from ..sources import mapping
from ..sources.files import written

RAW = {"date": "raw_date", "market": "raw_market", "commodity": "raw_commodity", "price_type": "raw_channel", "unit": "raw_unit", "price": "raw_price"}


@dataclass
class Analysis:
    records: DataFrame
    issues: DataFrame
    lineage: DataFrame
    profile: DataFrame
    coverage: DataFrame
    score: DataFrame
    trusted: DataFrame


def upload(df: DataFrame, found: dict[str, str] | None = None, channel: str | None = None) -> DataFrame:
    """An upload under the raw names, gaps empty. A wide sheet, with a column of prices for each channel, becomes a row for each price.

    Where it has no ``seq`` and ``id``, rows are numbered as they stand: by their place in their part of the table, which for
    files that Spark reads is their place in the file. The numbered table is written once, so that ids stay what they are."""
    if found is None:
        df = mapping.unpivot_channels(df)
        found = mapping.suggest_mapping(df)
    if lacking := mapping.missing_required(found):
        raise ValueError(f"no column for {', '.join(lacking)}")
    cells = [F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit("")) if f in found else F.lit(channel or "" if f == "price_type" else "") for f in RAW]
    more = [F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit("")).alias(f"raw_{f}") for f in ("district", "province") if f in found]
    place = F.monotonically_increasing_id()
    own = [F.col("seq") if "seq" in df.columns else place.alias("seq"), F.col("id").cast("string") if "id" in df.columns else F.concat(F.lit("rec-"), place).alias("id")]
    out = df.select(*own, *(c.alias(n) for c, n in zip(cells, RAW.values(), strict=True)), *more)
    return out if {"seq", "id"} <= set(df.columns) else written(out)


def _found(df: DataFrame, record: str, kind: str, category: str, confidence=None, severity=None, suggestion=None) -> DataFrame:
    return df.select(
        F.col(record).alias("record_id"), F.lit(kind).alias("type") if kind else F.col("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity") if severity else F.col("severity"),
        (F.lit(confidence) if isinstance(confidence, float) else F.col("confidence")).cast("double").alias("confidence"), (F.col(suggestion) if suggestion else F.lit(None)).cast("string").alias("suggestion"), F.lit("open").alias("status"),
        (F.col("evidence") if "evidence" in df.columns else F.lit(None)).cast("array<struct<label: string, value: string>>").alias("evidence"),
    )


def analyze(raw: DataFrame, catalog: DataFrame, registry: DataFrame, *, with_forest: bool = True) -> Analysis:
    """Stages in order: standardise, row findings, duplicates, outliers, ladder, forest; then profiles and the score.

    Standardised rows are written to the shared folder once, as all later stages read them."""
    rows = written(standardize.resolved(standardize.typed(raw), catalog, registry))
    records = rows.select("seq", "id", "date", "province", "district", "market", "commodity", "unit", "channel", "price", F.lit(False).alias("corrected"))
    outliers = anomaly.price_outliers(records)
    priced = outliers.withColumn("evidence", F.array(F.struct(F.lit("z").alias("label"), F.col("z").cast("string").alias("value"))))
    if with_forest:  # what it corroborates is told with the known outlier, what it finds alone stands beside
        f = written(features.price_features(records))
        model, scored = forest.fitted(f)
        priced = forest.merged(priced, forest.findings(scored, model, outliers))
    parts = [
        _found(standardize.missing(rows), "id", "MISSING_VALUE", "completeness", 1.0), _found(standardize.invalid_dates(rows), "id", "INVALID_DATE", "conflict", 1.0),
        _found(standardize.invalid_prices(rows), "id", "INVALID_PRICE", "conflict", 1.0), _found(standardize.unknown_units(rows), "id", "UNIT_INCONSISTENCY", "conflict", 0.85),
        _found(standardize.unusual_units(rows), "id", "UNIT_INCONSISTENCY", "conflict", 0.8, None, "suggestion"),
        _found(standardize.entity_findings(rows).withColumnRenamed("score", "confidence"), "id", "", "conflict", None, None, "suggestion"),
        _found(dedupe.exact_duplicates(records), "id", "", "duplicate"), _found(dedupe.near_duplicates(records).withColumnRenamed("score", "confidence"), "id", "", "duplicate"),
        _found(priced, "id", "PRICE_ANOMALY", "anomaly", None, None, "suggestion"), _found(anomaly.ladder_violations(records), "record_id", "LADDER_VIOLATION", "conflict"),
        _found(anomaly.markups(records), "record_id", "PRICE_ANOMALY", "anomaly", None, "high"),
    ]
    issues = reduce(lambda a, b: a.unionByName(b), parts)
    return Analysis(records, issues, standardize.lineage(rows), profile.dataset(records), profile.coverage(records, registry), profile.quality(rows, issues, list(RAW.values())), analytics.trusted(records, issues))

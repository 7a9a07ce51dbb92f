"""Isolation forest: its trees sample rows of the whole table, all rows are scored on the executors."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import r4
from ..sources.files import written
from .features import NAMES

TREES, SAMPLE, QUANTILE, SIGNAL, CAP = 100, 256, 0.975, 0.4, 0.05
#: Bins of one pass over scores; rows that are few enough to be sorted.
BINS, SORTED = 2048, 100_000
#: Rows that are scored at a time.
PART = 16384


def path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    """Per tree: feature (-1 in a leaf), split, right child (the left one follows its parent), leaf depth."""
    sample: int
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Each tree is folded from its leaves upward, for a part of the rows at a time: a comparison of a whole column and a choice between two
        small numbers at every inner node, where following a row down the tree takes a look-up of its own at every level."""
        depth = np.zeros(len(x))
        trees = [_coded(*t) for t in self.trees]
        for start in range(0, len(x), PART):
            columns = np.ascontiguousarray(x[start : start + PART].T, float)
            sums = depth[start : start + PART]
            for tree in trees:
                sums += _folded(columns, *tree)
        return 2.0 ** (-depth / len(self.trees) / max(path_norm(self.sample), 1e-9))


def _coded(feature: np.ndarray, split: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> tuple[list, list, list, list, type, np.ndarray]:
    """A tree whose leaves have numbers, as small as may be, for their depths."""
    depths, codes = np.unique(leaf, return_inverse=True)
    kind = np.uint8 if len(depths) <= 1 << 8 else np.uint16 if len(depths) <= 1 << 16 else np.uint32
    return feature.tolist(), split.tolist(), right.tolist(), codes.tolist(), kind, depths


def _folded(columns: np.ndarray, feature: list, split: list, right: list, codes: list, kind: type, depths: np.ndarray) -> np.ndarray | float:
    """The depth that each row reaches; children follow their parent."""
    wide, found = kind is not np.uint8, {}
    for k in range(len(feature) - 1, -1, -1):
        if feature[k] < 0:
            found[k] = codes[k]
            continue
        low, high = found.pop(k + 1), found.pop(right[k])
        mask = (columns[feature[k]] >= split[k]).view(np.uint8)
        if wide:
            mask = mask.astype(kind)
        np.negative(mask, out=mask)  # all bits, or none
        np.bitwise_and(mask, low ^ high, out=mask)
        found[k] = np.bitwise_xor(mask, low, out=mask)
    return depths[found[0]]


def to_json(forest: Forest) -> str:
    """The model as text, with the features it was fitted to."""
    return json.dumps({"features": NAMES, "sample": forest.sample, "threshold": forest.threshold, "trees": [[a.tolist() for a in t] for t in forest.trees]})


def from_json(text: str) -> Forest | None:
    """A stored model, or None if it was fitted to other features."""
    d = json.loads(text)
    if tuple(d["features"]) != NAMES:
        return None
    return Forest([tuple(np.array(a) for a in t) for t in d["trees"]], d["sample"], d["threshold"])


def fit(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    rng = np.random.default_rng(seed)
    psi = min(sample, len(x))
    limit = math.ceil(math.log2(max(2, psi)))
    out = []
    for _ in range(trees if len(x) else 0):
        feature, split, right, leaf = [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> None:
            me = len(feature)
            feature.append(-1)
            split.append(0.0)
            right.append(-1)
            leaf.append(depth + path_norm(len(rows)))
            if depth >= limit or len(rows) <= 1:
                return
            part = x[rows]
            varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
            if not len(varied):
                return
            f = int(rng.choice(varied))
            low, high = part[:, f].min(), part[:, f].max()
            cut = round(float(rng.uniform(low, high)), 4)
            goes = part[:, f] >= cut
            if goes.all() or not goes.any():
                return
            feature[me], split[me] = f, cut
            grow(rows[~goes], depth + 1)
            right[me] = len(feature)
            grow(rows[goes], depth + 1)

        grow(rng.choice(len(x), psi, replace=False), 0)
        out.append((np.array(feature), np.array(split), np.array(right), np.array(leaf)))
    return Forest(out, psi)


def train(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    """A forest whose trees each sample rows of the whole table, by a hash of their id; the threshold is the quantile of the
    scores of all rows."""
    return fitted(features, trees, sample, seed, ())[0]


def fitted(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 42, keep: tuple[str, ...] | None = None) -> tuple[Forest, DataFrame]:
    """The forest of ``train`` and the scored rows that its threshold was read from, written once, so that no row is scored again. They have
    the columns to keep, or all but the features themselves, which nothing asks for after the score."""
    rows = _sampled(features, trees * sample).select(*NAMES).collect()  # what the trees sample
    x = np.array([list(r) for r in rows], float).reshape(-1, len(NAMES))
    forest = fit(x, trees, sample, seed)
    kept = [c for c in features.columns if c not in NAMES] if keep is None else keep
    scored = written(score(features, forest).select(*kept, "score"))
    if len(x):
        forest.threshold = math.floor(quantile(scored, "score", QUANTILE) * 1e4 + 0.5) / 1e4
    return forest, scored


def _sampled(features: DataFrame, n: int) -> DataFrame:
    """The n rows of the least hash of their id. Of a table with many more, those below a bound are sorted, which has about twice as many."""
    rows, hashed = features.count(), F.xxhash64("id")
    if rows > 4 * n:
        below = features.where(hashed <= int(-(2**63) + 2**64 * (2 * n / rows)))
        if below.count() >= n:
            features = below
    return features.orderBy(hashed, "id").limit(n)


def quantile(df: DataFrame, column: str, q: float) -> float:
    """The q-quantile of a column of numbers, interpolated, over all rows: counts in ever finer bins find the bins of the
    two rows around it, and only rows of these are sorted. No task holds more than the counts of ``BINS`` bins."""
    values = written(df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("v")))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return math.nan
    at = (n - 1) * q
    found = [_ranked(values, k, low, high) for k in sorted({math.floor(at), math.ceil(at)})]
    return found[0] + (found[-1] - found[0]) * (at - math.floor(at))


def _ranked(values: DataFrame, k: int, low: float, high: float) -> float:
    """The value at place k, from 0."""
    while low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        part = values.where(F.col("v").between(low, high))
        bins = part.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("bin").collect()
        for b in bins:
            if k < b.n:
                break
            k -= b.n
        if b.n <= SORTED or (b.lo, b.hi) == (low, high):
            return part.where(F.col("v").between(b.lo, b.hi)).orderBy("v").offset(k).limit(1).first().v
        low, high = b.lo, b.hi
    return low


def score(features: DataFrame, forest: Forest) -> DataFrame:
    """Adds the score, between 0 and 1."""

    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(forest.scores(np.column_stack(columns)) if forest.trees else np.zeros(len(columns[0])))

    return features.withColumn("score", F.pandas_udf(scored, DoubleType())(*NAMES))


def findings(scored: DataFrame, forest: Forest, known: DataFrame) -> DataFrame:
    """Rows over the threshold with a strong signal: they corroborate a known outlier, or are new ones.

    New ones are held to a share of all rows: those of the highest scores, ties to the smaller id."""
    strong = scored.where((F.col("score") >= forest.threshold) & (F.array_max("signal") >= SIGNAL))
    rows = strong.join(known.select("id", F.lit(True).alias("known")).distinct(), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    cap = max(1, math.floor(CAP * scored.count() + 0.5))
    rows = written(rows)
    new = rows.where("NOT known")
    if new.count() > cap:
        new = new.orderBy(F.desc("score"), "id").limit(cap)
    rows = rows.where("known").unionByName(new)
    reason = F.element_at(F.array(*map(F.lit, NAMES)), F.array_position("signal", F.array_max("signal")).cast("int"))
    return rows.select(
        "id", r4(F.col("score")).alias("score"), F.when(F.col("known"), "corroborated").otherwise("new").alias("effect"), reason.alias("reason"),
        F.when(F.col("score") >= forest.threshold + 0.06, "high").otherwise("medium").alias("severity"),
        r4(F.least(F.lit(0.97), 0.7 + 2 * (F.col("score") - forest.threshold))).alias("confidence"),
        F.when(F.col("peers") >= 3, F.floor(F.col("median") + 0.5).cast("long")).alias("suggestion"),
    )


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known outliers with the forest's word on them, and the forest's own new ones below.

    ``known`` has id, severity, confidence, suggestion and evidence (label and value of each piece). A known outlier that the forest
    corroborates gets its score and its strongest signal as evidence, once, and the higher confidence of the two, 0.99 at most."""
    piece = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    told = F.array(piece("forest", F.col("f.score")), piece("signal", F.col("f.reason")))
    word = found.where("effect = 'corroborated'").groupBy("id").agg(F.max(F.struct("score", "reason", "confidence")).alias("f"))
    has = F.exists("evidence", lambda e: e.label == "forest")
    raised = F.col("f").isNotNull() & ~has
    out = known.join(word, "id", "left").select(
        "id", "severity", F.when(raised, F.least(F.lit(0.99), F.greatest("confidence", "f.confidence"))).otherwise(F.col("confidence")).alias("confidence"),
        F.col("suggestion").cast("long").alias("suggestion"), F.when(raised, F.concat("evidence", told)).otherwise(F.col("evidence")).alias("evidence"), F.lit("known").alias("origin"),
    )
    new = found.where("effect = 'new'").select("id", "severity", "confidence", F.col("suggestion").cast("long").alias("suggestion"), F.array(piece("forest", F.col("score")), piece("signal", F.col("reason"))).alias("evidence"), F.lit("forest").alias("origin"))
    return out.unionByName(new)

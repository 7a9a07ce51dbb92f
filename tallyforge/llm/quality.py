"""Quality scores by Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0; a linear score is fitted by logistic loss on the difference of
their features. The cut is the score quantile at the labels' share of 0 in the fitted rows, and scores are passed
through a logistic curve centred on it, so that 0.5 is the cut.

Features come from the whole text alone, of any length. Null and empty texts have features of zero and a score like any
other. At most ``FIT_ROWS`` labelled rows, the first by a hash of doc_id, are fitted, each row of label 0 against ``RIVALS`` of
label 1 at least; with fewer than two labels seen, every score is 0.5. A doc_id labelled twice counts with the larger label,
one with several texts by the one whose features come first. Equal texts have equal scores; a score on the cut counts as
good. Repeated rows give repeated results, an empty table none; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS, RIVALS, RIDGE, SEED = 20_000, 20, 1.0, 23
_SYMBOLS = b"|#*$%&@~^_<>{}[]\\=+/"
_CLASSES = [b".,;:!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"aeiouAEIOU", b"\n", *(bytes([c]) for c in _SYMBOLS), b"-\"'()"]


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    if not raw:
        return [0.0] * WIDTH
    words = raw.split()
    n, w = len(raw), max(1, len(words))
    kinds = set(words)
    same = sum(map(eq, words, words[1:]))
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out = [1.0, np.log1p(w), np.log1p(n / w), len(kinds) / w, len(kinds) / w**0.75, same / w, np.sqrt(same / w), len(set(lines)) / len(lines), np.log1p(n / len(lines))]
    out += [float((lengths <= k).mean()) for k in (1, 2, 3)] + [float((lengths >= k).mean()) for k in (8, 12, 20)]
    shares = [(n - len(raw.translate(None, c))) / n for c in _CLASSES]
    symbols = (n - len(raw.translate(None, _SYMBOLS))) / n
    out += [*map(np.sqrt, shares), symbols, np.sqrt(symbols), min(1.0, 20 * symbols)]
    out.append((n - len(raw.translate(None, bytes(range(128, 256))))) / n)
    return out


WIDTH = 9 + 6 + len(_CLASSES) + 3 + 1


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.width, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rivals: int = RIVALS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Newton steps on the logistic loss of preference pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = max(len(bad) * rivals, len(good))
    better = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    diff = z[better] - z[np.resize(rng.permutation(bad), n)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), diff.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.sort(z @ w)
    k = min(len(raw) - 1, max(1, len(bad)))
    return Model(mean, scale, w, float((raw[k - 1] + raw[k]) / 2), float(max(1e-6, raw.std() / 4)))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch):
            rows = [np.array(features(t)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary()), part.column("quality")], ["doc_id", "x", "quality"])


def learn(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on labelled rows that aren't held out; features are made on the executors and FIT_ROWS of them collected."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality").mapInArrow(common.Tidied(_features_of), "doc_id long, x binary, quality int")
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).collect()  # a row a label
    rows = sorted((bytes(r.x), r.quality) for r in rows)  # the fit doesn't depend on the order of tasks
    x = np.array([np.frombuffer(r[0]) for r in rows]).reshape(-1, WIDTH)
    return fit(x, np.array([r[1] for r in rows]))


def _scoring(model: Model):
    def make():
        def step(ids, texts):
            s = model.score(np.array([features(t) for t in texts]).reshape(-1, WIDTH))
            return ids, s.tolist(), (s >= 0.5).astype(int).tolist()

        return step

    return make


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col))
    out = common.map_rows(plain, _scoring(model), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model accepts."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in common.chunks(batch):
                x = np.array([features(t) for t in part.column(place).to_pylist()]).reshape(-1, WIDTH)
                yield part.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(common.Tidied(run), docs.schema)

"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Texts are lower-cased, everything in ASCII but letters becomes a space, and byte n-grams of one to three are hashed
into ``WIDTH`` counts, scaled by roots and length. All machines are linear, with squared hinge loss. Within a family the language
with most pair wins is taken, ties by summed margins. The score is the product of the logistic margins of the
decisions that led to it.

At most ``PER_LANGUAGE`` rows a language, the first by a hash of doc_id, are fitted; languages missing from
``FAMILIES`` are families of their own. ``und`` with score 0 goes to null texts, texts without a letter, and every
text when nothing could be learnt. Whole texts are counted, of any length. Equal texts get equal results; ties of wins and
margins go to the language first in alphabetical order. Repeated rows are learnt once and give repeated results; an empty table
gives none. Columns of other names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTH, PER_LANGUAGE, STEPS, COST = 4096, 400, 150, 20.0
#: Languages whose samples the driver takes; with more of them learning stops.
MAX_LANGUAGES = 1000
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
    "semitic": ("ar", "he", "am"),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"={lang}")


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    shift = np.uint32(20)
    counts = np.bincount(raw, minlength=WIDTH) + np.bincount(two * np.uint32(2654435761) >> shift, minlength=WIDTH) + np.bincount(three * np.uint32(2246822519) >> shift, minlength=WIDTH)
    counts[32] = 0  # spaces say how the text is laid out
    out = np.sqrt(counts, dtype=np.float32)
    return out / max(1e-6, float(np.sqrt(out @ out)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine for y in -1, 1: accelerated descent on the squared hinge."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(z.shape[1], x.dtype)
    rate, t = 1 / (1 + 4 * cost), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - rate * (v - 2 * cost * ((share * slack * y) @ z))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of rows of features."""
        if not self.families:
            return [("und", 0.0)] * len(x)
        z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if len(self.families) == 1:
            chosen, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = z @ self.family_weights
            chosen, sure = margins.argmax(axis=1), _logistic(margins.max(axis=1))
        out: list[tuple[str, float]] = [("und", 0.0)] * len(x)
        for k in set(chosen.tolist()):
            rows = np.flatnonzero(chosen == k)
            langs = self.members[self.families[k]]
            wins, sums, least = (np.zeros((len(rows), len(langs))) for _ in range(3))
            least += 1.0
            for i, j in combinations(range(len(langs)), 2):
                m = z[rows] @ self.pairs[langs[i], langs[j]]
                for a, s in ((i, m), (j, -m)):
                    wins[:, a] += s > 0
                    sums[:, a] += np.tanh(s)
                    least[:, a] = np.minimum(least[:, a], _logistic(s))
            best = (wins + sums / (2 * len(langs))).argmax(axis=1)
            for r, b in zip(range(len(rows)), best, strict=True):
                out[rows[r]] = (langs[b], float(sure[rows[r]] * least[r, b]))
        return out


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = np.array(langs, dtype=object)
    known = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for lang in known:
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    model = Model(families, None, members)
    own = np.array([family(lang) for lang in langs], dtype=object)
    if len(families) > 1:
        one = [svm(x, np.where(own == f, 1, -1).astype(x.dtype)) for f in families]
        model.family_weights = np.array(one).T
    for group in members.values():
        for a, b in combinations(group, 2):
            rows = (names == a) | (names == b)
            model.pairs[a, b] = svm(x[rows], np.where(names[rows] == a, 1, -1).astype(x.dtype))
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch):
            rows = [features(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "h")), pa.array(rows, pa.binary())], ["doc_id", "lang", "h", "x"])


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on a bounded sample of rows that aren't held out, all languages alike; features are made on the executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~common.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    place = rows.select("doc_id", "lang", "h").withColumns({"fine": F.pmod("h", F.lit(512)), "coarse": F.pmod("h", F.lit(8))})
    for keys in (["lang", "fine"], ["lang", "coarse"], ["lang"]):  # so that no task ranks a whole language
        place = place.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("n") <= per_language).drop("n")
    picked = place.select("doc_id", "lang", "h").distinct().limit(MAX_LANGUAGES * per_language + 1).collect()
    if len(picked) > MAX_LANGUAGES * per_language:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if the driver can hold their samples")
    spark, keys = docs.sparkSession, ["doc_id", "lang", "h"]
    wanted = F.broadcast(spark.createDataFrame(picked, "doc_id long, lang string, h long"))  # bounded by the parameters alone
    found = rows.join(wanted, keys, "left_semi").select(*keys, "text").mapInArrow(common.Tidied(_features_of), "doc_id long, lang string, h long, x binary")
    found = found.groupBy(*keys).agg(F.min("x").alias("x")).collect()
    found = sorted((bytes(r.x), r.lang) for r in found)  # the fit doesn't depend on the order of tasks
    x = np.array([np.frombuffer(r[0], np.float16) for r in found], np.float32).reshape(-1, WIDTH)
    return fit(x, [r[1] for r in found])


def _predicting(model: Model):
    def make():
        def step(ids, texts):
            has = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            langs, scores = ["und"] * len(ids), [0.0] * len(ids)
            if has:
                for k, (lang, s) in zip(has, model.predict(np.array([features(texts[k]) for k in has])), strict=True):
                    langs[k], scores[k] = lang, s
            return ids, langs, scores

        return step

    return make


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col))
    out = common.map_rows(plain, _predicting(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")

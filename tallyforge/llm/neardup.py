"""Near-duplicate groups by HyperMinHash: banded compressed registers, corrected estimates, links confirmed on full sets.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased, words split at ASCII white
space); with fewer words the whole sequence is its only shingle, without words it is empty and linked with nothing.
Shingles are 64-bit hashes, dealt to ``REGISTERS`` buckets by 8 bits; a register keeps the number of leading zeros of
a bucket's smallest remaining hash and the ``MANTISSA`` bits behind its first one. A bucket without shingles takes
the minimum of another hash over the whole set, so that registers of two sets agree with their Jaccard similarity as
probability, also for small sets. ``BANDS`` bands of ``ROWS`` registers give candidates: a pair at the threshold of
0.8 is missed with a probability of 1.3e-7.

Documents of equal sets are one class (its smallest doc_id stands for it), found by a fingerprint before any
pairing. Pairs of classes are estimated from registers, less the expected chance collisions, and those above the threshold
less six standard deviations are confirmed on full sets. Buckets are never paired out at once: first each class
meets the smallest class of its bucket; pairs in a bucket are formed only between classes that aren't connected yet,
so a group of many near copies costs about a pair a class, and no link between unconnected classes is left out.

Null and empty texts have no shingles and are their own component, as is a row without doc_id. Rows of one doc_id are one
document: it is linked with what any of its texts is linked with. Repeated rows give repeated results; an empty table
gives none. Texts of any length are taken whole; of the other columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

SHINGLE, SIMILAR = 2, (80, 100)
REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 40, 5
#: Rows and bytes of sets of a bucket that are compared at once.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Least estimate that is confirmed: the threshold less six standard deviations of the estimate at it.
LEAST = SIMILAR[0] / SIMILAR[1] - 6 * (SIMILAR[0] / SIMILAR[1] * (1 - SIMILAR[0] / SIMILAR[1]) / REGISTERS) ** 0.5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_REST = np.uint64((1 << 56) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(size, len(h))
    out = h[: len(h) - k + 1] * _A
    for i in range(1, k):
        out = (out ^ out >> np.uint64(29)) * _B + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out + np.uint64(k)))


def _register(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of 56 bits, and the bits behind the first one, in 16 bits."""
    bits = np.zeros(len(rest), np.int64)
    np.maximum(bits, np.frexp((rest >> np.uint64(24)).astype(np.float64))[1] + 24, out=bits, where=rest >> np.uint64(24) > 0)
    low = rest >> np.uint64(24) == 0
    bits[low] = np.frexp(rest[low].astype(np.float64))[1]
    lift = np.maximum(0, 56 - bits).astype(np.uint64)
    mantissa = (rest << lift & (_REST >> np.uint64(1))) >> np.uint64(55 - MANTISSA)
    return (lift << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


_PLACES = np.arange(REGISTERS, dtype=np.uint64) * _C + _A


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty."""
    bucket = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # sorted: the smallest of its bucket
    rest = np.empty(REGISTERS, np.uint64)
    full = np.zeros(REGISTERS, bool)
    rest[bucket[first]] = shingles[first] & _REST
    full[bucket[first]] = True
    none = np.flatnonzero(~full)
    if len(none):
        step = max(1, 200_000 // len(none))
        least = np.full(len(none), _REST)
        for k in range(0, len(shingles), step):
            least = np.minimum(least, (_mixed(shingles[k : k + step, None] ^ _PLACES[none]) & _REST).min(axis=0))
        rest[none] = least
    return _register(rest)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of each band of rows of registers; the band is part of the key."""
    rows = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, rows.shape[:2])
    for k in range(ROWS):
        h = _mixed(h * _B + rows[..., k] + np.uint64(1))
    return h.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers of sets of n and m, less the chance collisions of compressed registers.

    0.169919487159739: fixed value of the published approximation."""
    same = (a == b).sum(axis=1)
    ratio = np.maximum(n, m) / np.minimum(n, m)
    chance = 0.169919487159739 * 2.0 ** (np.log2(REGISTERS) - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, same - chance) / REGISTERS


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch):
            sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            if full:
                for k, row in zip(full, band_keys(np.array([sketch(sets[k]) for k in full])), strict=True):
                    keys[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n", "fp", "keys"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            key = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
            rep, n = (np.repeat(part.column(k).to_numpy(), BANDS) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep), pa.array(n)], ["key", "rep", "n"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sets and registers of the rows whose text has the class's fingerprint."""
    for batch in batches:
        for part in common.chunks(batch):
            rows = []
            for rep, fp, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s = shingle_set(text, size)
                if xxhash.xxh3_128_digest(s.tobytes()) == fp:
                    rows.append((rep, fp, s.tobytes(), sketch(s).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["rep", "fp", "shingles", "registers"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, set and registers of a, of b) those that are linked: estimated first, confirmed then."""
    for batch in batches:
        for part in common.chunks(batch):
            sa, ra, sb, rb = (part.column(k).to_pylist() for k in (2, 3, 4, 5))
            n, m = (np.array([len(x) // 8 for x in s], np.float64) for s in (sa, sb))
            a, b = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
            hopeful = estimate(a, b, n, m) >= LEAST if len(n) else np.zeros(0, bool)
            keep = [bool(h) and linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for h, x, y in zip(hopeful, sa, sb, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the labels of one pair of blocks of a bucket; a label joined to another is not tried again."""
    first, second = int(group["i"].iat[0]), int(group["j"].iat[0])
    group = group.sort_values("rep").reset_index(drop=True)
    registers = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(s) for s in sets], np.float64)
    rep, label, block = (group[c].to_numpy() for c in ("rep", "label", "block"))
    label = label.copy()
    out = []
    rows = np.flatnonzero(block == first)
    for x in rows:
        others = np.flatnonzero((block == second) & (label != label[x]) & (np.arange(len(rep)) > x if first == second else True))
        if not len(others):
            continue
        near = estimate(registers[others], registers[x][None], sizes[others], sizes[x]) >= LEAST
        for y in others[near]:
            if label[y] != label[x] and linked(sets[x], sets[y]):
                out.append((rep[x], rep[y]))
                label[label == label[y]] = label[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark = df.sparkSession
    where = common.shared_dir(spark)
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = common.written(plain.mapInArrow(common.Tidied(partial(_described, size=shingle)), "doc_id long, n long, fp binary, keys binary"), f"{where}/told")
    classes = told.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    classes = common.written(classes, f"{where}/classes")
    banded = classes.select("rep", "n", "keys").mapInArrow(common.Tidied(_banded), "key long, rep long, n long")
    stars = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("rows"), F.sum("n").alias("total")).where("rows > 1")
    stars = common.written(stars, f"{where}/stars")
    shared = common.written(banded.join(stars, "key"), f"{where}/shared")
    needed = shared.select("rep").distinct().join(classes.select("rep", "fp"), "rep")
    texts = needed.join(plain.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "fp", "text")
    sets = common.written(texts.mapInArrow(common.Tidied(partial(_sets, size=shingle)), "rep long, fp binary, shingles binary, registers binary").dropDuplicates(["rep", "fp"]), f"{where}/sets")
    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"), F.col("registers").alias(f"r{c}")) for c in "ab")
    pairs = shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "ra", "sb", "rb").mapInArrow(common.Tidied(_confirmed), "a long, b long")
    # the texts of one doc_id belong together: a link from it to the class of each
    several = told.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    own = told.join(several, "doc_id").select("doc_id", "fp").join(classes.select("fp", "rep"), "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = common.written(links.union(own), f"{where}/links")
    labels = connected(links, f"{where}/first").withColumnRenamed("node", "rep")
    marked = shared.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    marked = common.written(marked, f"{where}/marked")
    # a bucket with two labels or more may hold further links; one pair of it was tried if it has just two rows
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    left = marked.where("rows > 2").join(mixed, "key").withColumn("parts", parts)
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select("key", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    across = left.join(sets, "rep").groupBy("key", "i", "j").applyInPandas(_across, "a long, b long")
    every = common.written(links.union(across).distinct(), f"{where}/every")
    final = connected(every, f"{where}/second").withColumnRenamed("node", "rep")
    known = classes.select("fp", "rep").join(final, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component"))
    out = told.select("doc_id", "n", "fp").join(known, "fp", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows, with all their columns, of the smallest doc_id of each group."""
    kept = common.fresh("kept", df)
    found = groups(df, id_col=id_col, text_col=text_col, shingle=shingle).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    return df.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(kept)), "left_semi")

"""Nearest neighbours by inner product: anisotropic product quantisation, four-bit table scans, exact reranking.

A vector is stored as its nearest of ``CELLS`` centres, the length of the residual, and four bits for each pair of the
residual direction's dimensions. Codes and codebooks minimise the squared error plus ``ETA`` - 1 times the square of
its part along the vector, which is what shifts large inner products. The index is a written table; each task has a
block of queries, reads the index's codes from the shared folder block by block, and keeps the best ``RERANK`` rows of each
query: two codes share a byte and a table of 256 sums. It then reads the vectors of these rows for exact products, added up
in double precision in order of dimensions. Neither codes nor vectors are shuffled to the queries, and what a query passes
on doesn't grow with the table.

Queries are the rows whose id is divisible by ``EVERY``. Null and zero vectors, vectors with null or non-finite
components, and those of another length than the most frequent one take no part, as do rows without an id. Equal vectors are
scanned once: they stand for their smallest ids, more than which no answer can hold. Rows that repeat id and vector count
once. Equal products are ranked by id. An empty table gives no rows; other columns are not read. The codebooks are fitted to
at most ``FIT_ROWS`` vectors, the first by a hash of their id; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

EVERY, TOP, FIT_ROWS, CELLS, CENTRES, RERANK = 20, 20, 8192, 64, 16, 256
#: Queries of a task at most, queries worth a task and tasks of small tables; rows of the index, and queries, scored at once.
QUERY_BLOCK, LEAST_BLOCK, TASKS, ROW_BLOCK, SUB = 4096, 32, 24, 1 << 15, 64
THRESHOLD, SEED = 0.2, 29


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    """Weight of parallel against orthogonal error for products above a cosine of ``threshold``."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def _assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        a = _assigned(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Model:
    """Centres, and for each pair of dimensions ``CENTRES`` code words for residual directions."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, np.float64)
        self.dims = x.shape[1]
        self.pad = -self.dims % 4
        rng = np.random.default_rng(SEED)
        self.cells = _kmeans(x, min(CELLS, len(x)), 12, rng)
        direction, u, _, _ = self._residuals(x)
        self.groups = u.shape[1] // 2
        parts = u.reshape(len(u), self.groups, 2)
        self.words = np.stack([_kmeans(parts[:, m], CENTRES, 12, rng) for m in range(self.groups)])
        for _ in range(2):
            self.words = self._fitted(direction, parts, self._codes(direction, u))

    def _residuals(self, x: np.ndarray):
        """Unit vectors, residual directions (padded to pairs of pairs), residual lengths, cells."""
        cell = _assigned(x, self.cells)
        r = x - self.cells[cell]
        norm = np.sqrt((r * r).sum(axis=1))
        u = r / np.maximum(norm, 1e-12)[:, None]
        unit = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
        wide = ((0, 0), (0, self.pad))
        return np.pad(unit, wide), np.pad(u, wide), norm, cell

    def _codes(self, direction: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Code words by coordinate descent on the anisotropic loss."""
        more = eta(self.dims) - 1
        parts, along = u.reshape(len(u), self.groups, 2), direction.reshape(len(u), self.groups, 2)
        error = parts[:, :, None] - self.words[None]  # rows, groups, words, 2
        size = (error * error).sum(axis=3)
        shift = (error * along[:, :, None]).sum(axis=3)
        codes = size.argmin(axis=2)
        rows = np.arange(len(u))
        total = np.take_along_axis(shift, codes[:, :, None], 2)[..., 0].sum(axis=1)
        for _ in range(2):
            for m in range(self.groups):
                rest = total - shift[rows, m, codes[:, m]]
                codes[:, m] = (size[:, m] + more * (rest[:, None] + shift[:, m]) ** 2).argmin(axis=1)
                total = rest + shift[rows, m, codes[:, m]]
        return codes

    def _fitted(self, direction: np.ndarray, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Code words that minimise the loss for given codes: least squares over all of them at once."""
        n, more = len(parts), eta(self.dims) - 1
        size = self.groups * CENTRES * 2
        at = ((np.arange(self.groups) * CENTRES + codes) * 2)[:, :, None] + np.arange(2)
        along = np.zeros((n, size))
        np.put_along_axis(along, at.reshape(n, -1), direction.reshape(n, -1), 1)
        counts = np.bincount(at.ravel(), minlength=size).astype(np.float64)
        wanted = np.bincount(at.ravel(), parts.ravel(), size) + more * along.T @ (direction * parts.reshape(n, -1)).sum(axis=1)
        new = np.linalg.solve(np.diag(counts + 1e-3) + more * along.T @ along, wanted + 1e-3 * self.words.ravel())
        return new.reshape(self.words.shape)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, residual length and packed codes, two a byte."""
        direction, u, norm, cell = self._residuals(np.asarray(x, np.float64))
        codes = self._codes(direction, u)
        return cell.astype(np.int32), norm.astype(np.float32), (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with the centres, and with all pairs of code words of a byte."""
        wide = np.pad(q, ((0, 0), (0, self.pad))).reshape(len(q), self.groups, 2)
        one = np.einsum("qgd,gwd->gqw", wide, self.words)
        both = one[0::2, :, None, :] + one[1::2, :, :, None]
        return (q @ self.cells.T).astype(np.float32), both.reshape(self.groups // 2, len(q), -1).astype(np.float32)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of queries with rows, one each, in double precision, dimension by dimension."""
    out = np.zeros(len(rows))
    for d in range(q.shape[1]):
        out += q[:, d].astype(np.float64) * rows[:, d].astype(np.float64)
    return out


class Best:
    """The rows of largest estimates of each query, over blocks of an index that are handed in one after the other."""

    def __init__(self, model: Model, q: np.ndarray, depth: int):
        self.q, self.depth, self.rows = q, depth, 0
        self.tables = [model.tables(q[lo : lo + SUB].astype(np.float64)) for lo in range(0, len(q), SUB)]
        self.score = np.full((len(q), depth), -np.inf, np.float32)
        self.place = np.full((len(q), depth), -1, np.int64)

    def add(self, cell: np.ndarray, norm: np.ndarray, code: np.ndarray) -> None:
        """Codes have a row for each byte."""
        n = len(cell)
        for k, (centre, table) in enumerate(self.tables):
            at = slice(k * SUB, (k + 1) * SUB)
            score = np.zeros((len(centre), n), np.float32)
            for m in range(len(code)):
                score += np.take(table[m], code[m], axis=1)
            score *= norm
            score += np.take(centre, cell, axis=1)
            first = np.argpartition(-score, self.depth - 1, axis=1)[:, : self.depth] if n > self.depth else np.broadcast_to(np.arange(n), score.shape)
            both = np.hstack([self.score[at], np.take_along_axis(score, first, 1)])
            place = np.hstack([self.place[at], first + self.rows])
            keep = np.argpartition(-both, self.depth - 1, axis=1)[:, : self.depth]
            self.score[at], self.place[at] = np.take_along_axis(both, keep, 1), np.take_along_axis(place, keep, 1)
        self.rows += n


def _blocks(where: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The index, in the same order every time."""
    fs, base = common.filesystem(where)
    for f in sorted(fs.get_file_info(FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                yield from pq.ParquetFile(source).iter_batches(rows, columns=columns)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _answered(q: np.ndarray, model: Model, where: str, depth: int, row_block: int) -> list[list[tuple[int, float]]]:
    """(vec_id, product) of the nearest rows of each query, its own among them."""
    best = Best(model, q, depth)
    for block in _blocks(where, ["cell", "norm", "code"], row_block):
        best.add(block.column(0).to_numpy(), block.column(1).to_numpy(), np.ascontiguousarray(_matrix(block.column(2), np.uint8).T))
    flat = best.place.ravel()
    order = np.argsort(flat, kind="stable")
    score, least, more = np.full(len(flat), -np.inf), np.zeros(len(flat), np.int64), {}
    at, row = int(np.searchsorted(flat[order], 0)), 0
    for block in _blocks(where, ["ids", "vec"], row_block):
        end = at + int(np.searchsorted(flat[order[at:]], row + block.num_rows))
        wanted = order[at:end]
        if len(wanted):
            local = flat[wanted] - row
            used, back = np.unique(local, return_inverse=True)
            ids = block.column(0).take(pa.array(used)).to_pylist()
            score[wanted] = exact(q[wanted // depth], _matrix(block.column(1).take(pa.array(used)), np.float32)[back])
            least[wanted] = np.array([i[0] for i in ids])[back]
            more |= {row + int(u): i for u, i in zip(used, ids, strict=True) if len(i) > 1}
        at, row = end, row + block.num_rows
    out = []
    for k in range(len(q)):
        own = slice(k * depth, (k + 1) * depth)
        found = []
        for o in np.lexsort((least[own], -score[own]))[: TOP + 1].tolist():
            place = int(best.place[k, o])
            if place >= 0:
                found += [(i, float(score[own][o])) for i in more.get(place, [int(least[own][o])])]
        out.append(sorted(found, key=lambda f: (-f[1], f[0]))[: TOP + 1])
    return out


def _searched(batches: Iterator[pa.RecordBatch], model: Model, where: str, depth: int, query_block: int, row_block: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, query_block):
            part = batch.slice(lo, query_block)
            found = _answered(_matrix(part.column(1), np.float32), model, where, depth, row_block)
            rows = [[{"vec_id": i, "score": s} for i, s in f] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, kind)], ["h", "vec", "found"])


def _coded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            vec = part.column(1).to_pylist()
            cell, norm, code = model.encode(np.frombuffer(b"".join(vec), np.float32).reshape(len(vec), -1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(norm), pa.array([c.tobytes() for c in code], pa.binary())], ["ids", "vec", "cell", "norm", "code"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists as bytes, which are cheaper to compare and move; minus zero becomes zero."""
    for batch in batches:
        x = [np.array(v, np.float32) + np.float32(0) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vec"])


def search(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``TOP`` nearest rows of each query."""
    spark = df.sparkSession
    vector = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & vector.isNotNull())
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = rows.where(good)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dims = usual[0].n if usual else 1
    packed = rows.where(F.size("v") == dims).mapInArrow(_packed, "vec_id long, vec binary").distinct()
    where = common.shared_dir(spark)
    packed = common.written(packed.withColumn("h", F.xxhash64("vec")), f"{where}/vectors")
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = Model(np.frombuffer(b"".join(sorted(bytes(r.vec) for r in sample)), np.float32).reshape(len(sample), dims))
    ids = packed.withColumn("salt", F.pmod("vec_id", F.lit(61)))
    for keys in (["h", "vec", "salt"], ["h", "vec"]):  # the smallest ids of equal vectors, of which there may be many
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("n") <= TOP + 1)
    classes = ids.groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    coded = classes.select("ids", "vec").mapInArrow(partial(_coded, model=model), "ids array<long>, vec binary, cell int, norm float, code binary")
    common.written(coded, f"{where}/index")
    asked = packed.where(F.col("vec_id") % EVERY == 0).select("h", "vec", F.col("vec_id").alias("query_id"))
    wanted = common.written(asked.select("h", "vec").distinct(), f"{where}/wanted")
    queries = wanted.count()
    tasks = max(1, -(-queries // QUERY_BLOCK), min(TASKS, -(-queries // LEAST_BLOCK)))
    search_in = partial(_searched, model=model, where=f"{where}/index", depth=RERANK, query_block=QUERY_BLOCK, row_block=ROW_BLOCK)
    answers = wanted.repartition(tasks).mapInArrow(search_in, "h long, vec binary, found array<struct<vec_id: long, score: double>>")
    others = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, TOP)
    ranked = asked.join(answers, ["h", "vec"]).select("query_id", F.posexplode(others).alias("k", "f"))
    return ranked.select("query_id", (F.col("k") + 1).alias("rank"), "f.vec_id", "f.score")

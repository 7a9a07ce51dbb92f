"""Sampled segmentations over a SentencePiece vocabulary, reproducible by row key, and their lossless decoding.

A text gets a space in front, spaces become U+2581, and all ways to spell it in pieces form a lattice. Forward
filtering sums the probabilities of the paths that reach each place; backward sampling draws a path from the end,
with uniforms hashed from (seed, row key, word, step), so that a row's segmentation depends on nothing but its key
and text. No piece spans the gap before a word, hence the lattice splits there without loss, and words that recur
are filtered once. Characters without a piece (U+2581 in the text too) are spelled in byte pieces.

Words of more than ``LONG`` characters (scripts without spaces, encoded data) are filtered one by one with a window of the
longest piece: of each place only its sum is kept, and the sampler works the shares out again where it passes. Texts of any
length are taken whole, in parts of at most ``BATCH_CHARS`` characters of words, which change nothing.

A piece's probability falls as 1 / (rank + ``OFFSET``) with its place in the vocabulary (a BPE model has ranks for scores),
to the power ``THETA``; a byte counts as the last rank. Null gives null ids, empty text an empty list; a null key counts
as 0. Rows with equal keys and texts get equal segmentations. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OFFSET, THETA, SEED = 3.0, 1.0, 11
#: Characters of text that are segmented together; characters of a word that is filtered alone.
BATCH_CHARS, LONG = 600_000, 2048
#: Factor that keeps sums of a long word within a double's range.
_LIFT = 1e200
_SPACE, _RAW = 0x2581, 0x110001
_WORDS = re.compile(r" *[^ ]+| +")
_TURN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Vocabulary:
    """Pieces, their weights and the hashes of all their prefixes."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes_id = np.full(256, -1, np.int32)
        self.spelled = [b""] * self.size
        names: dict[str, int] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names[piece] = i
                self.spelled[i] = piece.replace("▁", " ").encode()
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece spans the gap before a word")
        if (self.bytes_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        weight = -np.log(np.arange(self.size) + OFFSET)
        self.weight = (theta * (weight - np.log(np.exp(weight).sum()))).astype(np.float64)
        self.byte_weight = float(self.weight.min())
        self.longest = max(map(len, names))
        self.names, self.share = names, np.exp(self.weight).tolist()
        self.byte_share = float(np.exp(self.byte_weight))
        self.reach: dict[str, int] = {}  # the longest piece that ends in a character
        for piece in names:
            self.reach[piece[-1]] = max(len(piece), self.reach.get(piece[-1], 1))
        self.odd = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.reach and not any(c in piece for piece in names))
        prefixes: dict[int, int] = {}
        for piece, i in names.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes[h] = i if n == len(piece) else prefixes.get(h, -1)
        self.keys = np.array(sorted(prefixes), np.uint64)
        self.ids = np.array([prefixes[int(k)] for k in self.keys], np.int32)


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float = THETA) -> Vocabulary:
    return Vocabulary(path, theta)


class Lattice:
    """Forward filtering of words (each with its space in front), longest first; nodes lie in layers by offset."""

    def __init__(self, v: Vocabulary, words: list[str]):
        self.v = v
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.length = lengths[order]
        text = "".join([words[k] for k in order.tolist()])
        codes = _codes(text).copy()
        gap = codes == 32
        codes[codes == _SPACE] = _RAW
        codes[gap] = _SPACE
        self.first = np.cumsum(self.length) - self.length
        top = int(self.length[0])
        wide = len(words) - np.searchsorted(self.length[::-1], np.arange(top + 1))  # words that reach each layer
        self.layer = np.concatenate([[0], np.cumsum(wide)])
        self.wide, self.text = wide, text
        n = int(self.layer[-1])
        deep = min(v.longest, top)
        self.piece = np.full((deep + 1, n), -1, np.int16 if v.size < 1 << 15 else np.int32)
        score = np.full((deep + 1, n), -np.inf, np.float32)
        word = np.repeat(np.arange(len(words)), self.length)
        offset = np.arange(len(codes)) - self.first[word]
        room = self.length[word] - offset
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        for l in range(1, deep + 1):
            keep = room[at] >= l
            at, h = at[keep], h[keep]
            h = h * _BASE + (codes[at + l - 1] + 1).astype(np.uint64)
            k = np.searchsorted(v.keys, h)
            k[k == len(v.keys)] = 0
            known = v.keys[k] == h
            ids = v.ids[k]
            piece = known & (ids >= 0)
            node = self.layer[offset[at[piece]] + l] + word[at[piece]]
            self.piece[l, node] = ids[piece]
            score[l, node] = v.weight[ids[piece]]
            if l == 1:
                lone = at[~piece]
                node = self.layer[offset[lone] + 1] + word[lone]
                size = 1 + (codes[lone] > 0x7F) + (codes[lone] > 0x7FF) + ((codes[lone] > 0xFFFF) & (codes[lone] != _RAW))
                size = np.where(codes[lone] == _RAW, 3, size)
                score[1, node] = size * v.byte_weight
            at, h = at[known], h[known]
        alpha = np.zeros(n, np.float64)
        for i in range(1, top + 1):
            lo, hi, w = int(self.layer[i]), int(self.layer[i + 1]), int(wide[i])
            lens = range(1, min(i, deep) + 1)
            paths = np.stack([score[l, lo:hi] + alpha[self.layer[i - l] : self.layer[i - l] + w] for l in lens])
            best = paths.max(axis=0)
            shares = np.cumsum(np.exp(paths - best), axis=0)
            alpha[lo:hi] = best + np.log(shares[-1])
            score[1 : len(lens) + 1, lo:hi] = shares / shares[-1]
            score[len(lens), lo:hi] = 1.0
        self.shares, self.alpha = score, alpha

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, its number of pieces, pieces): pieces of occurrences of words, one after the other.

        A piece of -1 - c is character c of ``text``, to be spelled in bytes."""
        rank = self.rank[word]
        left = self.length[rank].copy()
        live = np.arange(len(word))
        steps = []
        count = np.zeros(len(word), np.int64)
        step = 0
        while len(live):
            r, i = rank[live], left[live]
            node = self.layer[i] + r
            turn = np.uint64((step + 1) * int(_TURN) & 0xFFFFFFFFFFFFFFFF)
            u = (_mixed(seed[live] + turn) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            l = np.ones(len(live), np.int64)
            more = np.flatnonzero(self.shares[1, node] <= u)
            while len(more):
                l[more] += 1
                m = l[more]
                more = more[(self.shares[m, node[more]] <= u[more]) & (m < np.minimum(i[more], len(self.shares) - 1))]
            piece = self.piece[l, node].astype(np.int64)
            lone = np.flatnonzero(piece < 0)
            piece[lone] = -1 - (self.first[r[lone]] + i[lone] - 1)
            steps.append((live, piece))
            count[live] += 1
            left[live] = i - l
            live = live[left[live] > 0]
            step += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (who, piece) in enumerate(steps):  # drawn from the end
            out[end[who] - 1 - k] = piece
        return end, count, out


class LongWord:
    """Forward filtering of one word (with its space in front) in plain numbers, and samples of it."""

    def __init__(self, v: Vocabulary, word: str):
        self.v, self.word = v, word
        self.spelled = word.replace("\u2581", v.odd).replace(" ", "\u2581")
        self.sums, self.lifts = np.ones(len(word) + 1), np.zeros(len(word) + 1, np.int32)
        sums, lifts = [1.0], [0]  # of the window alone
        deep, lift = v.longest, 0
        for i in range(1, len(word) + 1):
            total = 0.0
            for length, weight, _ in self.ways(i):
                x = weight * sums[-length]
                total += x * _LIFT if lifts[-length] < lift else x
            if total < 1 / _LIFT:
                total, lift = total * _LIFT, lift + 1
            self.sums[i], self.lifts[i] = total, lift
            sums.append(total)
            lifts.append(lift)
            if len(sums) > 4096:
                del sums[:-deep], lifts[:-deep]

    def ways(self, i: int):
        """Length, weight and id (-1 for bytes) of what may end at a place, shorter ones first."""
        v, text = self.v, self.spelled
        find = v.names.get
        k = find(text[i - 1])
        if k is None:
            yield 1, v.byte_share ** len(self.word[i - 1].encode()), -1
        else:
            yield 1, v.share[k], k
        for length in range(2, min(i, v.reach.get(text[i - 1], 1)) + 1):
            k = find(text[i - length : i])
            if k is not None:
                yield length, v.share[k], k

    def sample(self, seed: int) -> np.ndarray:
        out: list[int] = []
        i, step, chances = len(self.word), 0, []
        while i:
            if step % 4096 == 0:
                turns = (np.arange(step + 1, step + 4097).astype(np.uint64)) * _TURN
                chances = ((_mixed(np.uint64(seed) + turns) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            ways = [(length, w * float(self.sums[i - length]) * (_LIFT if self.lifts[i - length] < self.lifts[i] else 1.0), k) for length, w, k in self.ways(i)]
            rest = chances[step % 4096] * sum(x for _, x, _ in ways)
            for length, x, k in ways:  # noqa: B007
                rest -= x
                if rest < 0:
                    break
            out += [k] if k >= 0 else self.v.bytes_id[list(self.word[i - 1].encode())][::-1].tolist()
            i -= length
            step += 1
        return np.array(out[::-1], np.int32)


def _words_of(text: str) -> list[str]:
    """Words without the first of their spaces."""
    if "  " in text or text[:1] == " ":
        return [w[1:] for w in _WORDS.findall(" " + text)]
    return text.split(" ")


def _seeds(keys: list[int], places: list[np.ndarray], seed: int) -> np.ndarray:
    """A number for each word from its row's key and its place in the text."""
    row = np.repeat(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64), [len(p) for p in places])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return _mixed(_mixed(row + np.uint64(seed)) + place.astype(np.uint64) * _BASE)


def _short(parts: list[tuple[list[str], int, int]], v: Vocabulary, seed: int) -> list[np.ndarray]:
    """Ids of runs of words: (words, row key, place of the first)."""
    kinds = dict.fromkeys(chain.from_iterable(words for words, _, _ in parts))
    index = dict(zip(kinds, range(len(kinds)), strict=True))
    if not index:
        return [np.zeros(0, np.int32) for _ in parts]
    sizes = np.fromiter((len(words) for words, _, _ in parts), np.int64, len(parts))
    lattice = Lattice(v, [f" {w}" for w in index])
    word = np.fromiter(map(index.__getitem__, chain.from_iterable(words for words, _, _ in parts)), np.int64, int(sizes.sum()))
    mixed = _seeds([k for _, k, _ in parts], [np.arange(at, at + len(words)) for words, _, at in parts], seed)
    end, _, piece = lattice.sample(word, mixed)
    ends = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])]
    lone = np.flatnonzero(piece < 0)
    if len(lone):  # bytes take the place of such a character
        spelled = [v.bytes_id[list(lattice.text[-1 - c].encode())] for c in piece[lone].tolist()]
        size = np.ones(len(piece), np.int64)
        size[lone] = [len(s) for s in spelled]
        ahead = np.concatenate([[0], np.cumsum(size)])
        wide = np.empty(int(ahead[-1]), np.int64)
        wide[ahead[:-1]] = piece
        for at, s in zip(ahead[lone].tolist(), spelled, strict=True):
            wide[at : at + len(s)] = s
        piece, ends = wide, ahead[ends]
    piece = piece.astype(np.int32)
    return [piece[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _runs(words: list[str]):
    """(place, words) of runs of short words of at most BATCH_CHARS characters, and (place, word) of long ones."""
    if max(map(len, words)) <= LONG and sum(map(len, words)) + len(words) <= BATCH_CHARS:
        yield 0, words
        return
    at = size = 0
    for k, w in enumerate(words):
        if len(w) > LONG or size + len(w) > BATCH_CHARS:
            if k > at:
                yield at, words[at:k]
            at, size = k, 0
        if len(w) > LONG:
            yield k, w
            at = k + 1
        else:
            size += len(w) + 1
    if at < len(words):
        yield at, words[at:]


def sample_segmentations(texts: list[str], keys: list[int], v: Vocabulary, seed: int = SEED) -> list[np.ndarray]:
    """Ids of each text."""
    owner: list[int] = []  # the text of each part, in order
    made: list[np.ndarray | None] = []
    waiting: list[tuple[int, tuple[list[str], int, int]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for (k, _), ids in zip(waiting, _short([p for _, p in waiting], v, seed), strict=True):
            made[k] = ids
        waiting.clear()
        size = 0

    for t, (text, key) in enumerate(zip(texts, keys, strict=True)):
        for place, part in _runs(_words_of(text)) if text else []:
            owner.append(t)
            made.append(None)
            if isinstance(part, str):
                made[-1] = LongWord(v, f" {part}").sample(int(_seeds([key], [np.array([place])], seed)[0]))
                continue
            chars = sum(map(len, part)) + len(part)
            if size and size + chars > BATCH_CHARS:
                flush()
            waiting.append((len(made) - 1, (part, key, place)))
            size += chars
    flush()
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for t, ids in zip(owner, made, strict=True):
        found[t].append(ids)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in found]


def decode(ids, v: Vocabulary) -> str:
    """The text of any segmentation."""
    raw = b"".join(map(v.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw.decode()[1:] if len(raw) else ""


def _grouped(batch: pa.RecordBatch):
    sizes, lo, total = batch.column(1).to_pylist(), 0, 0
    for k, t in enumerate(sizes):
        total += len(t or "")
        if total >= BATCH_CHARS or k == len(sizes) - 1:
            yield batch.slice(lo, k + 1 - lo), sizes[lo : k + 1]
            lo, total = k + 1, 0


class _Encoding:
    def __init__(self, path: str, seed: int, theta: float):
        self.path, self.seed, self.theta = path, seed, theta

    def __call__(self, batches):
        v = vocabulary(self.path, self.theta)
        for batch in batches:
            for part, texts in _grouped(batch):
                keys = [k or 0 for k in part.column(0).to_pylist()]
                ids = sample_segmentations([t or "" for t in texts], keys, v, self.seed)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                mask = pa.array([t is None for t in texts])
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([part.column(0), column, part.column(2)], ["doc_id", "ids", "source_sha256"])


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED, theta: float = THETA, keep_digest: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row; with ``keep_digest`` the text's SHA-256, as the engine computes it."""
    text = F.col(text_col).cast("string")
    digest = F.sha2(text.cast("binary"), 256) if keep_digest else F.lit(None).cast("string")
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest.alias("source_sha256"))
    out = plain.mapInArrow(common.Tidied(_Encoding(path or model_path(), seed, theta)), "doc_id long, ids array<int>, source_sha256 string")
    return out if keep_digest else out.drop("source_sha256")


class _Decoding:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        v = vocabulary(self.path)
        for batch in batches:
            for part in common.chunks(batch):
                rows = part.column(1)
                texts, sums, counts = [], [], []
                for x in rows:
                    ids = x.values.to_numpy() if x.is_valid else None
                    texts.append(None if ids is None else decode(ids, v))
                    counts.append(0 if ids is None else len(ids))
                    sums.append(zlib.crc32(b"" if ids is None else np.ascontiguousarray(ids, "<i4").tobytes()))
                made = [rows, pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string()), pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
                rest = [(part.column(k), name) for k, name in enumerate(part.schema.names) if k > 1]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *(c for c, _ in rest)], ["doc_id", "ids", "n_pieces", "ids_crc32", "text", "text_sha256", *(n for _, n in rest)])


def decode_rows(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """Adds n_pieces, ids_crc32, the decoded text and its SHA-256 to what ``encode`` returns."""
    more = "".join(f", {c} string" for c in encoded.columns if c == "source_sha256")
    plain = encoded.select("doc_id", "ids", *(c for c in encoded.columns if c == "source_sha256"))
    return plain.mapInArrow(common.Tidied(_Decoding(path or model_path())), f"doc_id long, ids array<int>, n_pieces long, ids_crc32 long, text string, text_sha256 string{more}")

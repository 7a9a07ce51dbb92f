"""Alignment of two tokenizers' tokens by bytes, and counts of the id pairs that end together.

A text with a space in front is encoded by a byte-level tokenizer (A) and by a piece model (B), which puts that space there itself. Both
spell out to the same bytes. The ends of B's tokens are a static index of their intervals; bisecting it with the
start and the end of an A token gives the first and last B token that it overlaps. A gap between A tokens that no B token spans
(the next token's first is behind this one's last) is a group boundary: there tokens of both end. The last tokens of both sides of
a group end together; they are a link. How often each id pair is linked is counted over the corpus.

Neither tokenizer joins text across a space that follows other text, so texts are cut there and each distinct word is encoded
and aligned once. Only a space between two characters that aren't white space is such a place; runs of white space stay in one word.

Null and empty texts have no tokens, and so have texts whose tokens don't spell them out in either tokenizer (U+2581 in a text, which
the piece model reads as a space). Special tokens' strings in a text are plain text. Rows are counted each, also repeated ones; a null id stays null. An empty
table gives no rows. Texts of any length are taken whole. Other columns are not read.

Documents travel in bundles of about ``PORTION`` bytes of text (a longer text alone): a bundle meets the corpus-wide
count of each of its distinct pairs once, by a join on the pair, and its documents' links are summed up from them. So a frequent pair
has a row for each bundle, not for each document or link.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import common

#: Bytes of text of a bundle; words that an aligner keeps before it starts anew.
PORTION, CACHED = 2 << 20, 400_000
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(1 << 16)) if c.isspace()) + "]"
#: Spaces that don't stand between two other characters: such texts are cut by ``_GAP`` instead of at each space.
_ODD = rf"^ |{_WHITE} | {_WHITE}| \z"
_GAP = re.compile(r"(?<=\S)(?= \S)")
BUNDLE = {
    "bundle": pa.int64(), **dict.fromkeys(("doc_ids", "n_a", "n_b", "n_groups"), pa.list_(pa.int64())), "digests": pa.list_(pa.string()),
    "ends": pa.list_(pa.int64()), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()),
}
RESULT = {**dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), pa.int64()), "groups_sha256": pa.string()}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level tokens: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last B token that each A token overlaps, and whether a group ends with it; tokens by the ends of their bytes,
    in ascending order, both from byte 0 to one and the same last byte."""
    starts = np.concatenate([[0], ends_a[:-1]]) if len(ends_a) else ends_a
    first = np.searchsorted(ends_b, starts, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    boundary = np.ones(len(ends_a), bool)
    boundary[:-1] = first[1:] > last[:-1]
    return first, last, boundary


class Aligner:
    """Token counts, groups and links of words, each with a space before it."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.spelled_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece spans the gap before a word")
        self.spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (self.spelled_a, self.spelled_b))
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, and whether the tokens spell the word
        self.starts = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)  # by word, as numbers of pairs
        self.pair_number: dict[int, int] = {}
        self.pairs = np.zeros(0, np.int64)

    def encoded(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each word; none where they don't spell it."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
        ids_b = self.b.encode(words, num_threads=1)
        for k, w in enumerate(words):
            raw = f" {w}".encode()
            if b"".join([self.spelled_a[i] for i in ids_a[k]]) != raw or b"".join([self.spelled_b[i] for i in ids_b[k]]) != raw:
                ids_a[k], ids_b[k] = [], []
        return [np.array(x, np.int64) for x in ids_a], [np.array(x, np.int64) for x in ids_b]

    def learn(self, words: list[str]) -> None:
        each_a, each_b = self.encoded(words)
        ids_a, ids_b = np.concatenate(each_a), np.concatenate(each_b)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (each_a, each_b))
        _, last, boundary = aligned(np.cumsum(self.bytes_a[ids_a]), np.cumsum(self.bytes_b[ids_b]))
        cut = np.flatnonzero(boundary)
        word = np.repeat(np.arange(len(words)), n_a)[cut]
        n_groups = np.bincount(word, minlength=len(words))
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        text, a, b = [], 0, 0
        for end_a, end_b in zip((cut + 1).tolist(), (last[cut] + 1).tolist(), strict=True):
            text.append(f"{','.join(names_a[a:end_a])}|{','.join(names_b[b:end_b])}")
            a, b = end_a, end_b
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.groups += [";".join(text[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        keys = (ids_a[cut] << 32 | ids_b[last[cut]]).tolist()
        number, known = self.pair_number, len(self.pairs)
        new = [k for k in dict.fromkeys(keys) if k not in number]
        number.update(zip(new, range(known, known + len(new)), strict=True))
        self.pairs = np.concatenate([self.pairs, np.array(new, np.int64)])
        self.starts = np.concatenate([self.starts, len(self.links) + np.array(at[:-1], np.int64)])
        self.links = np.concatenate([self.links, np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))])
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_a > 0], axis=1)])
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, by number, one after the other, and the ends of each text's words."""
        if len(self.words) > CACHED:
            self.forget()
        given = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(given, _ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(given, " ")
        lists = split
        if odd.any():
            cut = [[w[1:] for w in _GAP.split(f" {texts[k]}")] for k in np.flatnonzero(odd).tolist()]
            where = np.arange(len(texts))
            where[odd] = len(texts) + np.arange(len(cut))
            lists = pa.concat_arrays([split, pa.array(cut, split.type)]).take(pa.array(where))
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        seen = lists.flatten().dictionary_encode()
        names = seen.dictionary.to_pylist()
        lacking = [w for w in names if w not in self.words]
        if lacking:
            self.learn(lacking)
        number = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        return number[seen.indices.to_numpy()], ends

    def __call__(self, texts: list[str]) -> dict:
        """Of texts that aren't empty: facts of each (A tokens, B tokens, groups), digests, and links as places among ``pairs``."""
        number, ends = self.numbers(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        facts = self.facts[number]
        bad = np.zeros(len(texts), bool)
        bad[text[facts[:, 3] == 0]] = True
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(facts[:, :3], axis=0)])
        starts = np.concatenate([[0], ends[:-1]])
        told = sums[ends] - sums[starts]
        told[bad] = 0
        groups = self.groups
        digests = ["" if out else hashlib.sha256(";".join([groups[k] for k in number[lo:hi].tolist()]).encode()).hexdigest() for out, lo, hi in zip(bad.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        number = number[~bad[text]]
        counts = self.facts[number, 2]
        links = self.links[np.arange(int(counts.sum())) + np.repeat(self.starts[number] - (np.cumsum(counts) - counts), counts)]
        times = np.bincount(links, minlength=len(self.pairs))
        used = np.flatnonzero(times)
        used = used[np.argsort(self.pairs[used])]
        place = np.zeros(len(self.pairs), np.uint32)
        place[used] = np.arange(len(used), dtype=np.uint32)
        return {"facts": told, "digests": digests, "links": place[links], "pairs": self.pairs[used], "times": times[used]}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Bundling:
    """Rows of (id, text) become bundles."""

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(BUNDLE)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for ids, texts in self.portions(batches):
            full = [k for k, t in enumerate(texts) if t]
            facts, digests = np.zeros((len(ids), 3), np.int64), [""] * len(ids)
            found = aligner(*self.paths)([texts[k] for k in full]) if full else None
            if found:
                facts[full] = found["facts"]
                for k, d in zip(full, found["digests"], strict=True):
                    digests[k] = d
            links, pairs, times = (found["links"], found["pairs"], found["times"]) if found else (np.zeros(0, np.uint32), [], [])
            narrow = len(pairs) <= 1 << 16
            row = (number, ids, *(facts[:, k].tolist() for k in range(3)), digests, np.cumsum(facts[:, 2]).tolist(), links.astype("<u2" if narrow else "<u4").tobytes(), list(pairs), list(times))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind, strict=True)], schema=kind)
            number += 1

    @staticmethod
    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for part in common.chunks(batch):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = 64 + 4 * len(t or "") if not (t or "").isascii() else 64 + len(t or "")
                    if ids and size + n > PORTION:
                        yield ids, texts
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += n
        if ids:
            yield ids, texts


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles beside the counts of their pairs become rows of documents."""
    kind = pa.schema(RESULT)
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(j)[k] for j, n in enumerate(batch.schema.names)}
            known = row["known"].values if row["known"].is_valid else None
            ends = row["ends"].values.to_numpy()
            count = best = np.zeros(0, np.int64)
            if known is not None and len(known):
                pair, count, best = (known.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "n", "best"))
                order = np.argsort(pair)
                count, best = count[order], best[order]
            links = np.frombuffer(row["links"].as_buffer(), "<u2" if len(count) <= 1 << 16 else "<u4")
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([best[links], count[links]], axis=1), axis=0)])
            both = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros((0, 2), np.int64)
            cols = [row[n].values for n in ("doc_ids", "n_a", "n_b", "n_groups")]
            cols += [row["n_groups"].values, pa.array(both[:, 0]), pa.array(both[:, 1]), row["digests"].values]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)


def pair_counts(bundles: DataFrame, where: str) -> DataFrame:
    """pair (A id, then B id in the lower 32 bits), n (links of it) and best (whether n is the highest of its B id)."""
    pairs = bundles.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    pairs = common.written(pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), f"{where}/pairs")
    highest = common.written(pairs.groupBy("b").agg(F.max("n").alias("most")), f"{where}/highest")  # a row for each B id: no more than the vocabulary
    return common.written(pairs.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), f"{where}/counts")


def align(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    where = common.shared_dir(df.sparkSession)
    paths = tokenizer or tokenizer_path(), model or model_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bundles = common.written(rows.mapInArrow(common.Tidied(_Bundling(*paths)), from_arrow_schema(pa.schema(BUNDLE))), f"{where}/bundles")
    counts = pair_counts(bundles, where)
    asked = bundles.select("bundle", F.explode("pairs").alias("pair")).join(counts.hint("merge"), "pair")
    known = common.written(asked.groupBy("bundle").agg(F.collect_list(F.struct("pair", "n", "best")).alias("known")), f"{where}/known")
    both = bundles.join(known.hint("merge"), "bundle", "left").select("doc_ids", "n_a", "n_b", "n_groups", "digests", "ends", "links", "known")
    return both.mapInArrow(common.Tidied(_summed), from_arrow_schema(pa.schema(RESULT)))


def token_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id and groups (``a`` and ``b``, the ids of both sides, and ``end``, the byte of space + text after the group) of every row."""
    paths = tokenizer or tokenizer_path(), model or model_path()

    def make():
        def step(ids, texts):
            return ids, [groups_of(aligner(*paths), t) for t in texts]

        return step

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_rows(rows, make, "doc_id long, groups array<struct<a: array<int>, b: array<int>, end: long>>")


def groups_of(by: Aligner, text: str | None) -> list[dict]:
    """The groups of one text."""
    if not text:
        return []
    number, _ = by.numbers([text])
    if not by.facts[number, 3].all():
        return []
    out, end = [], 0
    for k in number.tolist():
        for group in by.groups[k].split(";"):
            a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
            end += int(by.bytes_a[a].sum())
            out.append({"a": a, "b": b, "end": end})
    return out

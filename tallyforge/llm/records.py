"""Token ids in length-delimited binary files.

A file is a run of records: length (unsigned 64 bits), masked checksum of those 8 bytes, data, masked checksum of the
data; all little-endian. Data are the document's id (signed 64 bits), the bytes of an id (2 or 4, in one byte) and its
token ids (unsigned, the end id last); two bytes do where no id of the record is over 65535. Beside each file stands an index of (offset, bytes) pairs, unsigned 64 bits each, for reads in any order.
A masked checksum is crc32 turned right by 15 bits plus ``MASK``.

Documents are in ascending order of doc_id over all files; rows with equal ids follow by a hash of their text. Null and empty texts
hold the end id alone. A row whose id is null comes first. Ids are what the library gives for the whole text, special tokens
spelled in it included. Texts of any length are encoded whole, in memory of some twenty times their bytes. Repeated rows give
repeated records; an empty table gives no file. Columns other than the id and the text are not read. Task attempts write files of their own names, and only
files that the finished tasks report are read, so lost executors leave no wrong data.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END_ID = 2
MASK = 0xA282EAD8
#: Words that an encoder keeps before it lets go of the rare ones, about 250 bytes each; bytes of text that are encoded together.
CACHED, PORTION = 1_000_000, 4 << 20
_LENGTH = struct.Struct("<Q")
_SUM = struct.Struct("<I")
_HEAD = struct.Struct("<qB")
_INDEX = struct.Struct("<QQ")
_NO_ID = -(1 << 63)
#: White space as Python, and the tokenizer, see it, for Arrow's expressions, which know that of ASCII alone.
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(1 << 16)) if c.isspace()) + "]"
#: A space with white space on both sides, or at the end: pieces can't be cut there.
_RUN = rf"{_WHITE} (?:{_WHITE}|\z)"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = _LENGTH.pack(len(data))
    return b"".join((head, _SUM.pack(masked(head)), data, _SUM.pack(masked(data))))


def _head(doc: int | None, width: int) -> bytes:
    return _HEAD.pack(_NO_ID if doc is None else doc, width)


def packed(doc: int | None, ids: bytes) -> bytes:
    """A record's data of ids given as unsigned 32 bits each."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return _head(doc, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def unpacked(data: bytes) -> tuple[int | None, bytes]:
    doc, width = _HEAD.unpack(data[: _HEAD.size])
    ids = data[_HEAD.size :]
    return None if doc == _NO_ID else doc, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _strings(words: pa.Array) -> list[str]:
    """The words, which hold no space, at once instead of one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class Encoder:
    """Token ids as the tokenizer gives them. It never joins text across a space before a word, so words are encoded
    once each and looked up; texts with other runs of white space, or with a special token's spelling, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        top = max(END_ID, *vocabulary.values())
        self.type = np.uint16 if top < 1 << 16 else np.uint32
        self.begins = np.zeros(top + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # a space, as byte-level tokens spell it
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_RUN, *added])
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # numbers of words; where their ids begin, and how many they are
        self.ids, self.counts, self.starts = np.zeros(0, self.type), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int32)

    def thin_out(self) -> None:
        """Keeps the words that were asked for more than once, half of what may be kept at most."""
        often = np.argsort(-self.hits, kind="stable")[: CACHED // 2]
        often = np.sort(often[self.hits[often] > 1])
        names = np.array(list(self.words), object)[often].tolist()
        counts = self.counts[often]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[often] - (ends - counts), counts)]
        self.words = dict(zip(names, range(len(names)), strict=True))
        self.ids, self.counts, self.starts, self.hits = ids, counts, ends - counts, self.hits[often] >> 1

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str], simple: np.ndarray) -> None:
        """Adds words, each with a space before it: simple ones, without white space, many at once as one text that is cut
        where tokens begin with a space."""
        counts, starts, made, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)

        def add(rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
            nonlocal at
            counts[rows], starts[rows] = lengths, at + np.cumsum(lengths) - lengths
            made.append(ids)
            at += len(ids)

        rest = [np.flatnonzero(~simple)]
        rows = np.flatnonzero(simple)
        for k in range(0, len(rows), 1000):
            part = rows[k : k + 1000]
            ids = self.plain([f" {' '.join([new[r] for r in part.tolist()])}"])[0]
            begins = np.flatnonzero(self.begins[ids])
            if len(begins) == len(part):
                add(part, ids, np.diff(begins, append=len(ids)))
            else:
                rest.append(part)
        alone = np.concatenate(rest)
        if len(alone):
            each = self.plain([f" {new[r]}" for r in alone.tolist()])
            add(alone, np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.ids, self.counts, self.starts = np.concatenate(made), np.concatenate([self.counts, counts]), np.concatenate([self.starts, starts])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the places of their ends."""
        if len(self.words) > CACHED:
            self.thin_out()
        given = pa.array(texts, pa.string())
        alone = pc.match_substring_regex(given, self.whole)
        heads = self.plain([t if a else t.split(" ", 1)[0] for t, a in zip(texts, alone.to_pylist(), strict=True)])
        split = pc.split_pattern(pc.if_else(alone, "", given), " ")
        ends = split.offsets.to_numpy()
        seen = split.values.dictionary_encode()
        place = seen.indices.to_numpy().copy()
        place[ends[:-1]] = -1  # a text's first word has no space before it
        used = np.zeros(len(seen.dictionary), bool)
        used[place[place >= 0]] = True
        kinds = seen.dictionary.filter(pa.array(used))
        words = _strings(kinds)
        number = list(map(self.words.get, words))
        lacking = [k for k, n in enumerate(number) if n is None]
        number = np.array([-1 if n is None else n for n in number], np.int64) if lacking else np.array(number, np.int64)
        if lacking:
            odd = pc.match_substring_regex(kinds.take(pa.array(lacking)), f"^$|{_WHITE}").to_numpy(zero_copy_only=False)
            number[lacking] = np.arange(len(self.words), len(self.words) + len(lacking))
            self.learn([words[k] for k in lacking], ~odd)
        self.hits = np.append(self.hits, np.zeros(len(self.words) - len(self.hits), np.int32))
        self.hits[number] += 1
        known = np.full(len(used) + 1, -1, np.int64)
        known[:-1][used] = number
        word = known[place]
        size, begin = np.append(self.counts, 0)[word], np.append(self.starts, 0)[word]
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        size[ends[:-1]] = lengths
        begin[ends[:-1]] = len(self.ids) + np.cumsum(lengths) - lengths
        after = np.cumsum(size)
        every = np.concatenate([self.ids, *heads])
        return every[np.arange(after[-1] if len(after) else 0) + np.repeat(begin - (after - size), size)], np.concatenate([[0], after])[ends[1:]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, whose one core the library's own threads would only crowd."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PORTION`` bytes of text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PORTION)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _write(batches: Iterator[pa.RecordBatch], where: str, path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end, narrow = np.array([END_ID], encode.type).tobytes(), encode.type is np.uint16
    task = TaskContext.get()
    fs, base = common.filesystem(where)
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
    at = count = ids_total = 0
    out = index = None
    for batch in batches:
        for part in _portions(batch):
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}.rec", buffer_size=1 << 20)
                index = fs.open_output_stream(f"{base}/{name}.idx", buffer_size=1 << 16)
            docs = part.column(0).to_pylist()
            ids, ends = encode([t or "" for t in part.column(1).to_pylist()])
            raw, width = memoryview(ids.astype(f"<u{ids.itemsize}", copy=False)).cast("B"), ids.itemsize
            lo = 0
            for doc, hi in zip(docs, ends.tolist(), strict=True):
                own = bytes(raw[lo * width : hi * width]) + end
                record = frame(_head(doc, 2) + own if narrow else packed(doc, own))
                out.write(record)
                index.write(_INDEX.pack(at, len(record)))
                at += len(record)
                lo = hi
            count += len(docs)
            ids_total += len(ids) + len(docs)
    if out is not None:
        out.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "records": pa.array([count], pa.int64()), "ids": pa.array([ids_total], pa.int64()), "bytes": pa.array([at], pa.int64())})


def write_records(df: DataFrame, where: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> list[tuple[str, int, int, int, int]]:
    """Writes the files below ``where`` and returns their list in order: name, records, ids, bytes, ids before it.

    The list has an entry for each task that had rows."""
    fs, base = common.filesystem(where)
    fs.create_dir(base, recursive=True)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows = ordered.mapInArrow(common.Tidied(partial(_write, where=where, path=path or tokenizer_path())), "part int, file string, records long, ids long, bytes long").collect()
    files, before = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        files.append((r.file, r.records, r.ids, r.bytes, before))
        before += r.ids
    return files


def read_stream(source) -> Iterator[tuple[int | None, bytes]]:
    """(document id, ids as bytes) of each record of an open file; ``ValueError`` where a checksum or length is wrong."""
    while head := source.read(12):
        if len(head) < 12 or _SUM.unpack(head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged length")
        (n,) = _LENGTH.unpack(head[:8])
        body = source.read(n + 4)
        if len(body) < n + 4 or _SUM.unpack(body[n:])[0] != masked(body[:n]):
            raise ValueError("damaged data")
        yield unpacked(body[:n])


def read_one(where: str, name: str, k: int) -> tuple[int | None, list[int]]:
    """Record k of a file by its index, without reading the others."""
    import io

    fs, base = common.filesystem(where)
    with fs.open_input_file(f"{base}/{name}.idx") as f:
        at, n = _INDEX.unpack(f.read_at(_INDEX.size, _INDEX.size * k))
    with fs.open_input_file(f"{base}/{name}.rec") as f:
        doc, ids = next(read_stream(io.BytesIO(f.read_at(n, at))))
    return doc, array("I", ids).tolist()


def _read(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    fs, base = common.filesystem(where)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cols: tuple[list, ...] = ([], [], [], [])

            def made(cols=cols):
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

            with fs.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as source:
                for doc, ids in read_stream(source):
                    n = len(ids) // 4
                    for c, v in zip(cols, (doc, start, n, zlib.crc32(ids)), strict=True):
                        c.append(v)
                    start += n
                    if len(cols[0]) == 4096:
                        yield made()
                        for c in cols:
                            c.clear()
            if cols[0]:
                yield made()


def read_records(spark, where: str, files: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, read from the files in parallel."""
    listed = spark.createDataFrame([(f[0], f[4]) for f in files], "file string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(partial(_read, where=where), "doc_id long, start long, n_tokens long, ids_crc32 long")

"""WARC archives with an external merge of their index.

Every task writes an archive of gzip members, a record each, and the index entries of its captures as sorted runs.
Runs are merged by a loser tree on (URL key, timestamp, record), in ranges of keys of about ``RANGE_CAPTURES`` captures,
into index files that are in order over all ranges: the capture histories. More than ``FAN_IN`` runs are merged in passes.
Beside each run stand two small files: keys and places of some lines, by which a merge finds where its range
begins, and at most ``SAMPLES`` keys that split the run evenly. The driver holds the names of the runs, and the samples of
``FAN_IN`` runs at most; a merge is told its own runs and bounds alone. Readers follow the merged index back into the
archives.

Of records with equal payloads the one with the largest page_id is a response; the others are revisits that carry its
id, the payload's digest and length, but no payload. Null html is an empty payload; a null URL has the key ``-``.
Repeated rows of the kept id are all responses. Files of failed or repeated tasks are never listed, hence never read.
Which pages are revisits is found by digests alone, and joined to the pages by their ids, so that no group of equal
payloads comes to one task. Payloads of any length are taken whole. An empty table gives no files and no captures; other
columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN_CAPTURES, SAMPLES, FAN_IN, LEVEL = 50_000, 256, 128, 1
#: Lines from one known place of a run to the next at least, and known places of a run at most, about.
STEP, PLACES = 256, 1 << 14
#: Captures of a merged index file at most, about; files that are made of smaller tables; captures worth a file.
RANGE_CAPTURES, FILES, LEAST_CAPTURES = 1_000_000, 24, 2000
#: Buckets over which the pages of one digest are dealt.
SALTS = 32
_NONE = -(1 << 63)
_START = datetime(2020, 1, 1, tzinfo=timezone.utc)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host parts from right to left, then path and sorted query, in lower case; no scheme, www, port or fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return re.sub(r"\s", "%20", url.lower())
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path.lower() or "/") + (f"?{query}" if query else "")
    return re.sub(r"\s", "%20", key)


def _member(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(kind: str, page: int | None, url: str | None, when: datetime, payload: bytes, digest: str, refers: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'none' if page is None else page}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    n = int(headers["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record cut short")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError("payload digest")
    return headers, payload


# an index entry is a line of key, timestamp, page, file, offset and length; its order is that of the first three
Entry = tuple[str, str, int, str, int, int]


def _line(e: Entry) -> bytes:
    return ("\t".join(map(str, e)) + "\n").encode()


def _entry(line: bytes) -> Entry:
    key, when, page, name, at, n = line.decode().rstrip("\n").split("\t")
    return key, when, int(page), name, int(at), int(n)


class _Run:
    """Writes a sorted run, and beside it what finds places in it and splits it."""

    def __init__(self, fs, base: str, name: str, count: int):
        self.fs, self.path, self.name = fs, f"{base}/{name}", name
        self.every, self.step = max(1, -(-count // SAMPLES)), max(STEP, count // PLACES)
        self.out, self.places = (fs.open_output_stream(f"{base}/{name}{end}", buffer_size=1 << 18) for end in ("", ".at"))
        self.samples: list[bytes] = []
        self.count = self.at = 0

    def add(self, e: Entry) -> None:
        line = _line(e)
        if self.count % self.step == 0:
            self.places.write(f"{e[0]}\t{e[1]}\t{e[2]}\t{self.at}\n".encode())
        if self.count % self.every == self.every // 2:
            self.samples.append(f"{e[0]}\t{e[1]}\t{e[2]}\n".encode())
        self.out.write(line)
        self.at += len(line)
        self.count += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        self.places.close()
        with self.fs.open_output_stream(f"{self.path}.split") as f:
            f.write(b"".join(self.samples))
        return self.name, self.count


def _spill(fs, base: str, name: str, entries: list[Entry]) -> tuple[str, int]:
    run = _Run(fs, base, name, len(entries))
    for e in sorted(entries):
        run.add(e)
    return run.close()


_TOLD = "part string, run string, captures long"


def _told(name: str, runs: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.string()), pa.array([r[1] for r in runs], pa.int64())], ["part", "run", "captures"])


def _keys(fs, path: str) -> list[tuple]:
    """Lines of a side file: key, timestamp, page, and whatever number follows."""
    with fs.open_input_stream(path) as f:
        return [(key, when, *map(int, rest)) for key, when, *rest in (line.split("\t") for line in f.read().decode().splitlines())]


def _write(batches: Iterator[pa.RecordBatch], where: str, level: int) -> Iterator[pa.RecordBatch]:
    fs, base = common.filesystem(where)
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
    out, at, entries, runs = None, 0, [], []
    for batch in batches:
        for part in common.chunks(batch):
            for page, url, html, keeper in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None, buffer_size=1 << 20)
                    info = _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n", level)
                    out.write(info)
                    at = len(info)
                payload = (html or "").encode()
                when = _START + timedelta(seconds=(page or 0) % (1 << 31))
                again = keeper is not None and keeper != page
                packed = _member(record("revisit" if again else "response", page, url, when, payload, digest_of(payload), keeper), level)
                out.write(packed)
                entries.append((url_key(url), f"{when:%Y%m%d%H%M%S}", _NONE if page is None else page, name, at, len(packed)))
                at += len(packed)
                if len(entries) == RUN_CAPTURES:
                    runs.append(_spill(fs, base, f"{name}-{len(runs)}.run", entries))
                    entries = []
    if entries:
        runs.append(_spill(fs, base, f"{name}-{len(runs)}.run", entries))
    if out is not None:
        out.close()
        yield _told(name, runs)


def write_archives(df: DataFrame, where: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = LEVEL) -> list[tuple[str, int]]:
    """Writes archives and runs; returns the runs and their captures. Payloads that occur once or by the largest id are stored."""
    fs, base = common.filesystem(where)
    fs.create_dir(base, recursive=True)
    html = F.col(html_col).cast("string")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(F.coalesce(html, F.lit("")).cast("binary"))).alias("digest"))
    slim = pages.select("page_id", "digest").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    kept = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL")
    kept = kept.select("digest", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    again = slim.join(kept, ["digest", "salt"]).where("page_id IS NULL OR page_id <> keeper").select("page_id", "digest", "keeper").distinct()
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "keeper")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    rows = pages.join(again, same, "left").select("page_id", "url", "html", "keeper")
    told = rows.mapInArrow(common.Tidied(partial(_write, where=where, level=level)), _TOLD).collect()
    return sorted((r.run, r.captures) for r in told)


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each step plays one path to the root."""

    def __init__(self, sources: list[Iterator[Entry]]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads: list[Entry | None] = [next(s, None) for s in sources] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k - 1, -1, -1):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # nobody to play against yet
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[Entry]:
        while (best := self.heads[self.tree[0]]) is not None:
            leaf = self.tree[0]
            yield best
            self.heads[leaf] = next(self.sources[leaf], None)
            self._play(leaf)


def _part(fs, base: str, name: str, low, high) -> Iterator[Entry]:
    """Entries of a run with low <= key < high (None: open), read from the last known place at or before low."""
    start = 0
    if low is not None:
        places = _keys(fs, f"{base}/{name}.at")
        k = bisect.bisect_left([p[:3] for p in places], low) - 1
        start = places[k][3] if k >= 0 else 0
    with fs.open_input_file(f"{base}/{name}") as f:
        f.seek(start)
        for lines in _some(f, 256):
            for line in lines:
                e = _entry(line)
                if low is not None and e[:3] < low:
                    continue
                if high is not None and e[:3] >= high:
                    return
                yield e


def _merge(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    """Each row asks for one merge: its runs, the captures to expect and a range of keys, into one file."""
    fs, base = common.filesystem(where)
    task = TaskContext.get()
    for batch in batches:
        for name, runs, captures, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bounds = [None if k is None else (k["key"], k["ts"], k["page"]) for k in (low, high)]
            out = _Run(fs, base, f"{name}-{task.taskAttemptId()}.cdx", captures)
            for e in LoserTree([_part(fs, base, run, *bounds) for run in runs]):
                out.add(e)
            yield _told(name, [out.close()])


def cuts(fs, base: str, runs: list[tuple[str, int]], ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 keys that split the runs' captures evenly: each sample stands for its share of its run."""
    weighed = []
    for name, captures in runs:
        keys = _keys(fs, f"{base}/{name}.split")
        weighed += [(key, captures / len(keys)) for key in keys]
    weighed.sort()
    total, done, out = sum(w for _, w in weighed), 0.0, []
    for key, weight in weighed:
        if done >= total * (len(out) + 1) / ranges and len(out) < ranges - 1 and (not out or key > out[-1]):
            out.append(key)
        done += weight
    return out


def merge_runs(spark, where: str, runs: list[tuple[str, int]], *, fan_in: int = FAN_IN, range_captures: int = RANGE_CAPTURES) -> list[tuple[str, int]]:
    """Globally ordered index files and their captures, in order."""
    key = "struct<key: string, ts: string, page: long>"

    def merged(jobs: list[tuple]) -> list[tuple[str, int]]:
        asked = spark.createDataFrame(jobs, f"name string, runs array<string>, captures long, low {key}, high {key}").repartition(len(jobs))
        told = asked.mapInArrow(partial(_merge, where=where), _TOLD).collect()
        return [(r.run, r.captures) for r in sorted(told, key=lambda r: r.part)]

    level = 0
    while len(runs) > fan_in:
        groups = [runs[k : k + fan_in] for k in range(0, len(runs), fan_in)]
        runs, level = merged([(f"level{level}-{k:06d}", [r for r, _ in g], sum(n for _, n in g), None, None) for k, g in enumerate(groups)]), level + 1
    if not runs:
        return []
    fs, base = common.filesystem(where)
    total = sum(n for _, n in runs)
    bounds = cuts(fs, base, runs, max(-(-total // range_captures), min(FILES, -(-total // LEAST_CAPTURES))))
    within = zip([None, *bounds], [*bounds, None], strict=True)
    return merged([(f"merged-{k:06d}", [r for r, _ in runs], total // (len(bounds) + 1), low, high) for k, (low, high) in enumerate(within)])


def _captures(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    """Reads the records that index files list, some thousand at a time, each archive in order."""
    fs, base = common.filesystem(where)
    names = ["url_key", "timestamp", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for index in batch.column(0).to_pylist():
            with fs.open_input_stream(f"{base}/{index}", buffer_size=1 << 20) as f:
                for lines in _some(f, 1024):
                    entries = list(map(_entry, lines))
                    rows: list = [None] * len(entries)
                    opened = None
                    for k in sorted(range(len(entries)), key=lambda k: entries[k][3:5]):
                        key, when, page, name, at, n = entries[k]
                        if opened is None or opened[0] != name:
                            if opened:
                                opened[1].close()
                            opened = (name, fs.open_input_file(f"{base}/{name}.warc.gz"))
                        headers, payload = parse(gzip.decompress(opened[1].read_at(n, at)))
                        again = headers["warc-type"] == "revisit"
                        rows[k] = (
                            key, when, None if page == _NONE else page, headers.get("warc-target-uri"),
                            int(headers["warc-payload-length"]) if again else len(payload), headers["warc-payload-digest"].removeprefix("sha1:"),
                            headers["warc-type"], int(headers["warc-refers-to"].removeprefix("<urn:x-page:").rstrip(">")) if again else None, None if again else payload,
                        )
                    if opened:
                        opened[1].close()
                    for lo in range(0, len(rows), common.CHUNK_ROWS):
                        cols = zip(*rows[lo : lo + common.CHUNK_ROWS], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _some(f, count: int) -> Iterator[list[bytes]]:
    """Lines of a stream, ``count`` at a time."""
    rest, lines = b"", []
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        lines += whole
        while len(lines) >= count:
            yield lines[:count]
            lines = lines[count:]
    if lines:
        yield lines


def read_captures(spark, where: str, index: list[tuple[str, int]]) -> DataFrame:
    """The captures of the merged index in order within each file, with payloads of responses (null for revisits)."""
    listed = spark.createDataFrame([(name,) for name, _ in index], "file string").repartition(max(1, len(index)))
    return listed.mapInArrow(partial(_captures, where=where), "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

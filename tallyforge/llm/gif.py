"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``encode_payloads`` stores byte payloads as grey-ramp GIF89a animations, 64 samples a row and FRAME_ROWS rows a
frame; ``iter_gif`` reads any GIF87a/89a file frame by frame, each with the canvas composited so far; ``describe_media``
keeps the timed frames with their colour histograms beside a payload's digests. Null and empty texts give one row of
padding. A file that isn't a GIF, or is cut short or damaged at any place, raises ``ValueError`` in ``iter_gif`` and gives
null columns in ``frames``. Texts of any length are stored whole; one frame's canvas is held at a time. Rows keep their ids,
also repeated ones, and equal texts give equal rows; an empty table gives none. Other input columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

WIDTH, FRAME_ROWS, DELAY_CS = 64, 512, 4
CLEAR, END, FULL = 256, 257, 4096
GREY = bytes(v for v in range(256) for _ in range(3))


def _widths(root: int, count: int) -> np.ndarray:
    """Bits of the code at each place after a clear code: the reader's table has one entry less than codes read."""
    top = np.maximum(np.arange(count) - 1, 0) + (1 << root) + 2
    return np.minimum(12, np.maximum(root + 1, np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 1))


_SEGMENT = FULL - CLEAR - 2  # codes that fill the table, after which the writer clears
_BITS = {root: _widths(root, FULL + 1) for root in range(2, 9)}
_ENDS = {root: np.concatenate([[0], np.cumsum(w)]) for root, w in _BITS.items()}


def lzw_codes(data: bytes) -> list[list[int]]:
    """The codes of 8-bit samples (at least one), a list for each filling of the table."""
    segments: list[list[int]] = []
    known: dict[int, int] = {}
    codes: list[int] = []
    find, put, free, at = known.get, codes.append, CLEAR + 2, data[0]
    for v in memoryview(data)[1:]:
        pair = at << 8 | v
        code = find(pair)
        if code is not None:
            at = code
            continue
        put(at)
        known[pair] = free
        free += 1
        at = v
        if free == FULL:
            segments.append(codes)
            known, codes, free = {}, [], CLEAR + 2
            find, put = known.get, codes.append
    put(at)
    segments.append(codes)
    return segments


_PLACES = np.arange(12, dtype=np.uint16)


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values, least significant bit first, one after the other."""
    bits = (values.astype(np.uint16)[:, None] >> _PLACES & 1).astype(bool)
    return np.packbits(bits[_PLACES < widths[:, None]], bitorder="little").tobytes()


def lzw_encode(data: bytes) -> bytes:
    values, widths = [np.array([CLEAR])], [np.array([9])]
    segments = lzw_codes(data)
    for k, codes in enumerate(segments):
        last = k == len(segments) - 1
        values.append(np.array([*codes, END if last else CLEAR]))
        widths.append(_BITS[8][: len(codes) + 1])
    return _packed(np.concatenate(values), np.concatenate(widths))


def lzw_decode(stream: bytes, root: int, limit: int) -> bytes:
    """Samples of a code stream, at most ``limit``; the table may stay full until a late clear."""
    if not 2 <= root <= 8:
        raise ValueError("LZW root size")
    clear, end = 1 << root, (1 << root) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, made = 8 * len(stream), 0, [], 0
    singles = [bytes([v]) for v in range(clear)] + [b"", b""]
    width, ends = _BITS[root], _ENDS[root]
    entries: list[bytes] = []
    done, going = 0, False  # whether the codes since the last clear go on, in further blocks of a full table
    while at < bits and made < limit:
        if going:
            offsets = at + 12 * np.arange(min((bits - at) // 12, 8 * FULL))
            w = np.full(len(offsets), 12, np.uint32)
        else:
            count = int(np.searchsorted(ends, bits - at, "right")) - 1
            offsets = at + ends[:count]
            w = width[np.arange(count)].astype(np.uint32)
        if not len(offsets):
            break
        i = offsets >> 3
        codes = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (offsets & 7).astype(np.uint32)) & ((np.uint32(1) << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        last = min(stop, len(codes) - 1)
        at = int(offsets[last]) + int(w[last])
        segment = codes[:stop].tolist()
        if segment and going:
            out += [entries[c] for c in segment]
        elif segment:
            if segment[0] >= clear:
                raise ValueError("LZW stream starts with an unknown code")
            entries = list(singles)
            prev = entries[segment[0]]
            out.append(prev)
            put, add = out.append, entries.append
            size, room = len(entries), FULL - len(entries)
            for c in segment[1 : room + 1]:
                if c < size:
                    e = entries[c]
                elif c == size:
                    e = prev + prev[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                put(e)
                add(prev + e[:1])
                size += 1
                prev = e
            for c in segment[room + 1 :]:
                put(entries[c])
        going = not len(stops)
        if limit < (1 << 62):
            made += sum(map(len, out[done:]))
            done = len(out)
        if len(stops) and codes[stop] == end:
            break
    return b"".join(out)[:limit]


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    indices: np.ndarray
    """Rows by columns, as stored (de-interlaced)."""
    rgba: np.ndarray
    """The whole canvas after this frame was drawn; the next frame is drawn over it."""


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("sub-blocks cut short")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise ValueError("sub-blocks cut short")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def _palette(data: bytes, at: int, size: int) -> np.ndarray:
    if at + size > len(data):
        raise ValueError("palette cut short")
    return np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)


def decode_gif(data: bytes) -> list[Frame]:
    """All frames at once, each with a canvas of its own."""
    return [replace(f, rgba=f.rgba.copy()) for f in iter_gif(data)]


def iter_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, each with its own pixels and the canvas after it; delays are summed into start times."""
    try:
        yield from _frames_of(data)
    except (IndexError, struct.error) as cut:
        raise ValueError("cut short") from cut


def _frames_of(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = _palette(data, at, n)
        at += n
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = delay = disposal = 0
    transparent = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if local & 0x80:
            n = 3 << ((local & 7) + 1)
            palette = _palette(data, at, n)
            at += n
        if palette is None:
            raise ValueError("no palette")
        root = data[at]
        stream, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, root, w * h), np.uint8)
        if len(flat) < w * h:
            raise ValueError("image cut short")
        indices = flat.reshape(h, w)
        if local & 0x40:  # interlaced: four passes of rows
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(indices)
            rows[order] = indices
            indices = rows
        before = canvas.copy() if disposal == 3 else None
        seen = indices[: max(0, height - top), : max(0, width - left)]
        drawn = np.empty((*seen.shape, 4), np.uint8)
        drawn[..., :3] = palette[np.minimum(seen, len(palette) - 1)]
        drawn[..., 3] = 255
        region = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        if transparent is None:
            region[:] = drawn
        else:
            shows = seen != transparent
            region[shows] = drawn[shows]
        yield Frame(clock, delay, disposal, left, top, indices, canvas)
        clock += delay
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    raise ValueError("no trailer")


def encode_gif(frames: list[np.ndarray], palette: bytes = GREY, delay_cs: int = DELAY_CS, disposal: int = 1, transparent: int | None = None) -> bytes:
    """An animation of index images (rows by columns, uint8) drawn at the top left; the first sets the canvas."""
    h, w = frames[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette]
    for image in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay_cs, transparent or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, image.shape[1], image.shape[0], 0, 8))
        stream = lzw_encode(image.tobytes())
        for k in range(0, len(stream), 255):
            part = stream[k : k + 255]
            out += (bytes([len(part)]), part)
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def histogram(rgba: np.ndarray, bins: int = 16) -> list[list[int]]:
    """Counts of red, green and blue levels over the opaque pixels."""
    shown = rgba[rgba[..., 3] > 0]
    return [np.bincount(shown[:, k] >> 4, minlength=bins).tolist() for k in range(3)]


def store_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as frames of at most FRAME_ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([rows[k : k + FRAME_ROWS] for k in range(0, len(rows), FRAME_ROWS)])


def _encode():
    def step(ids, texts):
        raws = [(t or "").encode() for t in texts]
        media = [store_payload(r + b"\0" * ((-len(r)) % WIDTH or (0 if r else WIDTH))) for r in raws]
        return ids, [len(r) for r in raws], media

    return step


def encode_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column for each text: doc_id, n_bytes (unpadded), media (GIF file)."""
    return common.map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text_col), _encode, "doc_id long, n_bytes long, media binary")


#: A timed frame as it is stored: its place in time, how it goes, and the counts of 16 levels of each colour.
_TIMED = "frame int, start_ms int, delay_ms int, disposal int, width int, height int, hist_r array<long>, hist_g array<long>, hist_b array<long>"


def _timed(k: int, f: Frame) -> dict:
    r, g, b = histogram(f.rgba)
    return {"frame": k, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.rgba.shape[1], "height": f.rgba.shape[0], "hist_r": r, "hist_g": g, "hist_b": b}


def _read_back():
    def step(ids, sizes, medias):
        cols = ([], [], [], [], [], [], [], [], [])
        for i, n, media in zip(ids, sizes, medias, strict=True):
            digest, size, tail, timed = hashlib.sha256(), 0, b"", []
            grey, length = np.zeros(16, np.int64), 0
            for k, f in enumerate(iter_gif(media)):
                part = f.indices.tobytes()
                digest.update(part)
                size, tail = size + len(part), (tail + part)[-64:]
                timed.append(_timed(k, f))
                # the frame's own rows: the last one may be smaller than the canvas
                grey += histogram(f.rgba[: f.indices.shape[0]])[0] if f.indices.shape != f.rgba.shape[:2] else timed[-1]["hist_r"]
                length += f.delay_ms
            feature = f"frames={len(timed)};ms={length};hist={','.join(map(str, grey))}"
            row = (i, n, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, timed)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    return step


def describe_media(media: DataFrame) -> DataFrame:
    """Reads stored media back and computes what ``op1_gif_media`` returns: digests, and the timed frames of each."""
    return common.map_rows(
        media.select("doc_id", "n_bytes", "media"),
        _read_back,
        f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<{_TIMED}>>",
    )


#: Bytes of canvases in one batch of frames, about.
CANVASES = 32 << 20


def _frames(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def made():
        nonlocal held
        out = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        held = 0
        return out

    for batch in batches:
        for i, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not media.is_valid:
                continue
            try:
                for k, f in enumerate(iter_gif(media.as_py())):
                    rows.append({"doc_id": i, **_timed(k, f), "rgba": f.rgba.tobytes()})
                    held += f.rgba.nbytes + 1000
                    if held >= CANVASES:
                        yield made()
            except ValueError:
                rows.append({"doc_id": i})
        if rows:
            yield made()


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per timed frame: the composited RGBA canvas and its colour histograms.

    A null medium has no rows; where one can't be read on, the frames before are followed by a row of nulls beside its id."""
    schema = StructType.fromDDL(f"doc_id long, {_TIMED}, rgba binary")
    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(partial(_frames, schema=to_arrow_schema(schema)), schema)

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyforge.llm import gif, queries


@pytest.mark.parametrize("size", [64, 128, 64 * 511, 64 * 513])
@pytest.mark.parametrize("kind", ["random", "few", "zero"])
def test_payload_round_trip(size, kind):
    rng = random.Random(size)
    payload = {"random": os.urandom(size), "few": bytes(rng.choice((0, 1, 255)) for _ in range(size)), "zero": bytes(size)}[kind]
    assert b"".join(f.indices.tobytes() for f in gif.decode_gif(gif.store_payload(payload))) == payload


def test_known_file():
    # a hand-made 3 x 5 GIF87a-like picture: 2-bit root, 2 colours used
    palette = bytes([0, 0, 0, 255, 255, 255, 255, 0, 0, 0, 255, 0]) + bytes(252 * 3)
    a = np.array([[0, 1, 2], [3, 2, 1]], np.uint8)
    b = np.array([[2, 2, 0], [0, 0, 0]], np.uint8)
    frames = gif.decode_gif(gif.encode_gif([a, b], palette, delay_cs=7, disposal=1, transparent=0))
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 70), (70, 70)]
    assert frames[0].rgba[0, 0, 3] == 0  # transparent, nothing below
    assert frames[0].rgba[0, 1].tolist() == [255, 255, 255, 255]
    assert frames[1].rgba[0, 1].tolist() == [255, 0, 0, 255]
    assert frames[1].rgba[1, 0].tolist() == [0, 255, 0, 255]  # shows through the second frame
    r, _, _ = gif.histogram(frames[1].rgba)
    assert sum(r) == 6 - 1 + (frames[1].rgba[0, 0, 3] > 0)


@pytest.mark.parametrize("disposal, left", [(1, 255), (2, 0), (3, 0)])
def test_disposal(disposal, left):
    image = [np.full((2, 2), 1, np.uint8), np.zeros((2, 2), np.uint8)]
    frames = gif.decode_gif(gif.encode_gif(image, bytes([0, 0, 0, 9, 9, 9]) + bytes(254 * 3), disposal=disposal, transparent=0))
    assert frames[0].rgba[0, 0].tolist() == [9, 9, 9, 255]
    assert frames[1].rgba[0, 0, 3] == left


def test_interlace_and_late_clear():
    data = bytearray(gif.encode_gif([np.repeat(np.arange(8, dtype=np.uint8)[:, None], 2, 1)]))
    at = data.index(b"\x2c", 13 + 768)
    data[at + 9] |= 0x40
    rows = gif.decode_gif(bytes(data))[0].indices[:, 0].tolist()
    assert rows == [0, 4, 2, 5, 1, 6, 3, 7]


def test_errors():
    good = gif.store_payload(b"x" * 64)
    for bad in (b"", b"GIF89a", b"PNG" + good[3:], *(good[:n] for n in range(len(good)))):
        with pytest.raises(ValueError):
            gif.decode_gif(bad)


def plain_decode(data):
    """Samples and delays of each frame by another reader: codes bit by bit, table as a list."""
    at, out, delay = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0), [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = 10 * int.from_bytes(data[at + 4 : at + 6], "little")
            at += 2
        else:
            assert data[at] == 0x2C and not data[at + 9] & 0x80
            root, at = data[at + 10], at + 11
        body = b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        if data[at - len(body)] is None or not body or len(body) == 4:
            continue
        bits = "".join(f"{b:08b}"[::-1] for b in body)
        place, width, table, samples, last = 0, root + 1, [], bytearray(), None
        while True:
            code = int(bits[place : place + width][::-1], 2)
            place += width
            if code == 1 << root:
                table, width, last = [bytes([k]) for k in range(1 << root)] + [b"", b""], root + 1, None
                continue
            if code == (1 << root) + 1:
                break
            entry = table[code] if code < len(table) else last + last[:1]
            samples += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
        out.append((bytes(samples), delay))
    return out


def test_op1_by_another_reader(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    media = gif.encode_payloads(df)
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    for r in gif.describe_media(media).collect():
        found = plain_decode(stored[r.doc_id])
        payload = b"".join(p for p, _ in found)
        raw = (docs[r.doc_id] or "").encode()
        assert payload == raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        levels = [sum(b >> 4 == k for b in payload) for k in range(16)]
        assert r.feature == f"frames={len(found)};ms={sum(d for _, d in found)};hist={','.join(map(str, levels))}"
        assert [(f.frame, f.delay_ms) for f in r.frames] == [(k, d) for k, (_, d) in enumerate(found)]
        assert r.frames[0].hist_r == r.frames[0].hist_g == [sum(b >> 4 == k for b in found[0][0]) for k in range(16)]


def test_query_rows(spark):
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", None), (4, "é" * 50000, "z"), (4, "é" * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(gif.describe_media(gif.encode_payloads(df)).collect())
    assert [r.n_bytes for r in got] == [3, 0, 0, 100000, 100000]
    for r, (i, text, _) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        raw += b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert got[3] == got[4] and got[1].media_sha256 == got[2].media_sha256
    assert gif.describe_media(gif.encode_payloads(df.limit(0))).count() == 0


def test_frames_table(spark):
    media = gif.encode_payloads(spark.createDataFrame([(1, "a" * 40000)], "doc_id long, text string"))
    got = gif.frames(media).orderBy("frame").collect()
    assert [f.start_ms for f in got] == [0, 40] and sum(got[0].hist_r) == 64 * 512
    bad = spark.createDataFrame([(1, b"nope"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.frame) for r in gif.frames(bad).collect()] == [(1, None)]
    cut = spark.createDataFrame([(3, gif.store_payload(b"a" * 40000 + b"b" * 24 * 64)[:-40])], "doc_id long, media binary")
    assert [(r.doc_id, r.frame, r.hist_r is None) for r in gif.frames(cut).collect()] == [(3, 0, False), (3, None, True)]


def test_many_frames_hold_one_canvas(spark, monkeypatch):
    monkeypatch.setattr(gif, "FRAME_ROWS", 4)
    monkeypatch.setattr(gif, "CANVASES", 5000)
    payload = bytes(range(256)) * 40
    media = gif.store_payload(payload)
    assert b"".join(f.indices.tobytes() for f in gif.iter_gif(media)) == payload
    parts = list(gif._frames(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "media": pa.array([media], pa.binary())})]), to_arrow_schema(StructType.fromDDL(f"doc_id long, {gif._TIMED}, rgba binary"))))
    assert sum(p.num_rows for p in parts) == 40 and max(p.num_rows for p in parts) <= 3


def test_op1_query(spark, sf):
    assert queries.QUERIES["op1_gif_media"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_full_table_without_clear():
    image = np.random.default_rng(5).integers(0, 256, (300, 300), np.uint8)  # about 90,000 codes after one clear
    data, known, codes, at = image.tobytes(), {}, [], image.tobytes()[0]
    for v in data[1:]:
        if (at, v) in known:
            at = known[at, v]
            continue
        codes.append(at)
        if len(known) < gif.FULL - 258:
            known[at, v] = 258 + len(known)
        at = v
    codes += [at, gif.END]
    widths = [9, *gif._BITS[8][: len(codes)], *[12] * (len(codes) - len(gif._BITS[8]))]
    stream = gif._packed(np.array([gif.CLEAR, *codes]), np.array(widths))
    assert gif.lzw_decode(stream, 8, len(data)) == data

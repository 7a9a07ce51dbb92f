"""Secret scans over a worklist of decoded layers.

A text is scanned as it is; then URL escapes, Unicode escapes, base64 runs, text of two or four bytes a character and compressed data (all members of
gzip, zlib, bz2 and xz, at any place and however their bytes are spelled) in it are unwrapped
into further layers, each scanned and unwrapped in turn until nothing new appears. Layers seen before (by content
and place) are not entered again, so data that decode to themselves end. Every hit is mapped to code points of the
original text: exactly through escapes and base64, to the whole encoded run through compression.

Escapes within escapes are unwrapped to their end at once, in one pass whatever their depth: what lies between holds no other
hits, as no hit has a character that begins an escape. So the depth of layers grows with the logarithm of a text's length
only, base64 being what is left to nest. Base64 is decoded from each of a run's first four characters on, so that nothing written before
the data shifts it, and over line breaks, also quoted ones (``>`` before a line) or such as are spelled ``\\n``.

Null and empty texts have no hits. Repeated rows give repeated results; an empty table gives none; columns of other names are
kept as they are or not read. Hits of several kinds at one place are all reported, in the order of ``KINDS``. Texts of any
length are scanned whole: places are kept by runs, not by characters, and of a long layer only the surroundings of what was
decoded, up to where nothing can cross, make a further layer. Compressed data that grow beyond ``WINDOW``
bytes are scanned to their end in parts, cut only where no hit, escape, base64 run or further compressed data can
cross. Where such a thing is itself longer than ``MAX_LAYER``, parts overlap instead; that is counted in ``oversize`` of
the scan, and the whole encoded run is masked.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds, in the order of ties.
KINDS = ("assign", "access", "hex")
WINDOW, MAX_LAYER, OVERLAP = 8 << 20, 64 << 20, 1 << 16
#: Characters of a layer that is unwrapped as a whole, however few of them are escaped.
SMALL = 1 << 12
MASK = "[REDACTED]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What may stand between two lines of base64: a line break, also one spelled with a backslash, and marks of quoting around it.
_GAP = r"""[ \t"',]*+(?:\\?(?:\r\n?|\n)|(?:\\r)?\\n|\\r)[ \t"'>|#*;]*+"""
#: Consecutive lines of nothing but base64; text may stand before the first and behind the last.
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_GAP}[A-Za-z0-9+/_-]++)++={{0,2}}")
_BREAK = re.compile(_GAP)
#: Runs of characters of four or two bytes each, either end first.
_WIDE = re.compile("(?:[\x01-\x7f]\0{3}){6,}|(?:\0{3}[\x01-\x7f]){6,}|(?:[\x01-\x7f]\0){6,}|(?:\0[\x01-\x7f]){6,}")
_HEXITS = frozenset("0123456789abcdefABCDEF")
_STANDARD = str.maketrans("-_", "+/")
#: Second bytes of a zlib header by its first one: a multiple of 31 together, and no preset dictionary.
_ZLIB = {c: [f for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32] for c in range(8, 0x79, 16)}
_PACKED = re.compile("|".join(("\x1f\x8b\x08", "BZh[1-9](?:1AY&SY|\x17rE8P\x90)", "\xfd7zXZ\0", *(f"{re.escape(chr(c))}[{''.join(f'\\x{f:02x}' for f in fs)}]" for c, fs in _ZLIB.items()))))
#: After a match nothing goes on: a character that is in no hit, escape or base64 run, a word between spaces, an empty line.
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\{}&#;\t\r\n]|(?<=\x20)[A-Za-z]++\x20(?=[A-Za-z])|\n(?=\n)""")
PIECE, BLOCK = 1 << 16, 1 << 20
#: Characters of the longest escape, a pair of surrogates.
REACH = 12


def base_hits(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of each hit in one layer, sorted; leftmost and non-overlapping for each kind."""
    hits = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        hits += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        hits += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    hits += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(hits)


@dataclass
class Layer:
    text: str
    starts: Sequence[int] | _Runs | _Same | _OfBytes
    ends: Sequence[int] | _Runs | _Same | _OfBytes
    """For each character of the text, the code points of the original that it stands for."""
    end: int | None = None
    """The end of the run that was decoded, padding included."""
    escapes: str = "url unicode"
    """The kinds of escapes that are left to unwrap, each on its own."""

    def place(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


class _Runs:
    """Places by runs of characters: from ``new[r]`` on, each stands for ``step[r]`` characters from ``old[r]`` on of the
    layer outside; side 0 for starts, 1 for ends."""

    def __init__(self, outer, new: Sequence[int], old: Sequence[int], step: Sequence[int], side: int):
        self.outer, self.new, self.old, self.step, self.side = outer, new, old, step, side

    def __getitem__(self, k: int) -> int:
        r = bisect_right(self.new, k) - 1
        return self.outer[self.old[r] + (k - self.new[r]) * self.step[r] + self.side * (self.step[r] - 1)]


def _reach(text: str, edits: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Parts of a text around its edits, which nothing crosses: first edit, last edit + 1, start, end of each part."""
    first = start = end = 0
    for k, (a, b, _, _) in enumerate(edits):
        if k and a <= end:
            left = None  # in reach of the one before
        else:
            left, size = end, 256
            while left == end and a - end > size // 16:
                lo = max(end, a - size)
                for m in _APART.finditer(text, lo, a):
                    left = m.end()
                if lo == end:
                    break
                size *= 16
        if left is not None:
            if k:
                yield first, k, start, end
            first, start = k, left
        if b > end:
            m = _APART.search(text, b)
            end = m.end() if m else len(text)
    yield first, len(edits), start, end


def _spliced(layer: Layer, edits: list[tuple[int, int, str, int]], escapes: str) -> Iterator[Layer]:
    """The layer with [a, b) replaced by texts whose characters stand for so many of the layer's each.

    Where no compressed data begin in it, only the parts around edits are new, each a layer of its own."""

    def made(some: list[tuple[int, int, str, int]], at: int, end: int) -> Layer:
        texts, new, old, step, size = [], array("q"), array("q"), array("q"), 0
        for a, b, text, width in some:
            for place, part, each in ((at, layer.text[at:a], 1), (a, text, width)):
                if part:
                    texts.append(part)
                    new.append(size)
                    old.append(place)
                    step.append(each)
                    size += len(part)
            at = b
        if at < end:
            texts.append(layer.text[at:end])
            new.append(size)
            old.append(at)
            step.append(1)
        whole = "".join(texts)
        if isinstance(layer.starts, _Same):
            return Layer(whole, layer.starts, layer.ends, escapes=escapes)
        return Layer(whole, _Runs(layer.starts, new, old, step, 0), _Runs(layer.ends, new, old, step, 1), escapes=escapes)

    whole = made(edits, 0, len(layer.text))
    if len(layer.text) <= SMALL or _PACKED.search(whole.text):
        yield whole
        return
    del whole
    for first, last, start, end in _reach(layer.text, edits):
        yield made(edits[first:last], start, end)


def _url_edits(text: str) -> list[tuple[int, int, str, int]]:
    if "%" not in text:
        return []
    return [(m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), 3) for m in _URL.finditer(text)]


def _unicode_edits(text: str) -> list[tuple[int, int, str, int]]:
    if "\\" not in text and "&#" not in text and "%u" not in text:
        return []
    found: list[tuple[int, int, int]] = []
    for m in _UNICODE.finditer(text):
        code = int(m[m.lastindex], 10 if m.lastindex == 7 else 16)
        if found and 0xDC00 <= code < 0xE000 and found[-1][1] == m.start() and 0xD800 <= found[-1][2] < 0xDC00:
            a, _, high = found.pop()
            found.append((a, m.end(), 0x10000 + (high - 0xD800 << 10) + code - 0xDC00))
        else:
            found.append((m.start(), m.end(), code))
    return [(a, b, chr(c), b - a) for a, b, c in found if _spelled(c)]


def _spelled(code: int) -> bool:
    return code <= 0x10FFFF and not 0xD800 <= code < 0xE000


def _closed(tail: list[str], kinds: str) -> tuple[int, int]:
    """How many of the last characters are a whole escape of these kinds, and its code; 0 if they are none."""
    c = tail[-1]
    if c in _HEXITS:
        if "url" in kinds and len(tail) > 2 and tail[-3] == "%" and tail[-2] in _HEXITS:
            return 3, int(tail[-2] + c, 16)
        if "unicode" in kinds:
            for n, marks in ((4, ("\\x",)), (6, ("\\u", "%u")), (10, ("\\U",))):
                if len(tail) >= n and tail[-n] + tail[1 - n] in marks and all(x in _HEXITS for x in tail[2 - n :]):
                    code = int("".join(tail[2 - n :]), 16)
                    if 0xDC00 <= code < 0xE000 and len(tail) > 11 and (m := _UNICODE.fullmatch("".join(tail[-12:-6]))) and 0xD800 <= (high := int(m[m.lastindex], 16)) < 0xDC00:
                        return 12, 0x10000 + (high - 0xD800 << 10) + code - 0xDC00
                    return n, code
    elif c in "};" and "unicode" in kinds:
        for n in range(4, min(11, len(tail) + 1)):
            if tail[-n] in "\\&":
                if m := _UNICODE.fullmatch("".join(tail[-n:])):
                    return n, int(m[m.lastindex], 10 if m.lastindex == 7 else 16)
                break
    return 0, 0


def _nested_edits(text: str, lo: int, hi: int, kinds: str) -> tuple[list[tuple[int, int, str, int]], int]:
    """Edits that unwrap escapes to their end, from ``lo`` to ``hi`` at least and on to where none is open, and that place.

    A character that completes an escape, a decoded one too, closes it at once."""
    tail: list[str] = []
    starts, ends = array("q"), array("q")
    k = lo
    while k < len(text) and (k < hi or any(c in tail[-REACH:] for c in "%\\&")):
        tail.append(text[k])
        starts.append(k)
        k += 1
        ends.append(k)
        while (closed := _closed(tail, kinds))[0] and _spelled(closed[1]):
            n, code = closed
            del tail[-n:], starts[len(starts) - n + 1 :], ends[-n:]
            tail.append(chr(code))
            ends.append(k)
    return [(a, b, c, b - a) for c, a, b in zip(tail, starts, ends, strict=True) if b - a > 1], k


def _edits(text: str, kinds: str) -> list[tuple[int, int, str, int]]:
    """Edits that leave no escape of these kinds: one level by patterns, and around those that make new escapes all levels."""

    def plain(t: str) -> list[tuple[int, int, str, int]]:
        return sorted((_url_edits(t) if "url" in kinds else []) + (_unicode_edits(t) if "unicode" in kinds else []))

    edits = plain(text)
    out: list[tuple[int, int, str, int]] = []
    first, done = 0, 0
    while first < len(edits):
        last = first + 1  # edits that are near each other
        while last < len(edits) and edits[last][0] - edits[last - 1][1] <= REACH:
            last += 1
        lo, hi = max(done, edits[first][0] - REACH), edits[last - 1][1]
        at, made = lo, []
        for a, b, new, _ in edits[first:last]:
            made += (text[at:a], new)
            at = b
        if plain("".join([*made, text[at : hi + REACH]])):
            at = edits[first][0]
            while (before := max(text.rfind(c, max(done, at - REACH), at) for c in "%\\&")) >= 0:  # one may be open
                at = before
            more, done = _nested_edits(text, at, hi, kinds)
            out += more
            while last < len(edits) and edits[last][0] < done:
                last += 1
        else:
            out += edits[first:last]
            done = hi
        first = last
    return out


def _from_escapes(layer: Layer) -> Iterator[Layer]:
    for kinds in layer.escapes.split():
        edits = _edits(layer.text, kinds)
        if edits:
            yield from _spliced(layer, edits, "" if "+" in kinds else "url+unicode")


def _from_wide(layer: Layer) -> Iterator[Layer]:
    if "\0" not in layer.text:
        return
    edits = []
    for m in _WIDE.finditer(layer.text):
        run = m[0]
        width = 4 if "\0\0\0" in run[:5] else 2
        edits.append((m.start(), m.end(), run.replace("\0", ""), width))
    if edits:
        yield from _spliced(layer, edits, "url unicode")


def _pieces(text: str, at: int) -> Iterator[bytes]:
    """The text's characters from a place on as bytes, up to the first that isn't one."""
    for k in range(at, len(text), PIECE):
        part = text[k : k + PIECE]
        try:
            yield part.encode("latin-1")
        except UnicodeEncodeError as wide:
            if wide.start:
                yield part[: wide.start].encode("latin-1")
            return


def _opened(head: bytes):
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[1] in _ZLIB.get(head[0], ()):
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _inflated(pieces: Iterator[bytes], told: dict) -> Iterator[bytes]:
    """Blocks of all members that follow each other; of damaged or cut ones what comes out of them.

    ``told`` gets the bytes ``used``, whether they ended as a ``whole``, and whether more input was ``wanted``."""
    told.update(used=0, whole=False, wanted=False)
    rest, read = b"", 0
    while True:
        while len(rest) < 16 and (more := next(pieces, b"")):
            read += len(more)
            rest = (rest + more).lstrip(b"\0")  # padding between members
        if (opened := _opened(rest)) is None:
            return
        piece, made = rest, False
        try:
            while not opened.eof:
                out = opened.decompress(piece, BLOCK)
                if out:
                    made = True
                    yield out
                if opened.eof:
                    break
                tail = getattr(opened, "unconsumed_tail", b"")
                if tail:
                    piece = tail
                elif getattr(opened, "needs_input", len(out) < BLOCK) or not (out or piece):
                    piece = next(pieces, b"")
                    read += len(piece)
                    if not (out or piece):
                        raise EOFError
                else:
                    piece = b""
        except (zlib.error, OSError, lzma.LZMAError, EOFError) as stop:
            told["wanted"] = type(stop) is EOFError
            if made:
                told.update(used=read, whole=False)
            return
        rest = opened.unused_data
        told.update(used=read - len(rest), whole=True)
        rest = rest.lstrip(b"\0")


def _cut_place(text: str) -> int:
    """The last place that nothing crosses, 0 if there is none."""
    end, at = len(text), 0
    while m := _PACKED.search(text, at):
        told: dict = {}
        for _ in _inflated(_pieces(text, m.start()), told):
            pass
        if told["wanted"] or told["whole"] and m.start() + told["used"] + 16 > len(text):  # it, or a next member, may go on
            end = m.start()
            break
        at = m.start() + (told["used"] if told["whole"] else 1)
    for lo in range((max(0, end - 1)) // PIECE * PIECE, -1, -PIECE):
        last = None
        for last in _APART.finditer(text, lo, min(end, lo + PIECE)):
            pass
        if last:
            return last.end()
    return 0


def _windows(blocks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """Parts of a stream, and whether one had to be cut through something."""
    buffer, full = bytearray(), WINDOW
    for block in blocks:
        buffer += block
        if len(buffer) < full:
            continue
        text = buffer.decode("latin-1")
        if at := _cut_place(text):
            yield text[:at], False
            del buffer[:at]
            full = max(WINDOW, 2 * len(buffer))
        elif len(buffer) >= MAX_LAYER:
            yield text, True
            del buffer[:-OVERLAP]
            full = WINDOW
        else:
            full = min(MAX_LAYER, 2 * full)
    if buffer:
        yield buffer.decode("latin-1"), False


def _from_packed(layer: Layer, state: dict) -> Iterator[Layer]:
    at = 0
    while m := _PACKED.search(layer.text, at):
        told: dict = {}
        size = sum(map(len, _inflated(_pieces(layer.text, m.start()), told)))
        at = m.start() + (told["used"] if told["whole"] else 1)
        if not size:
            continue
        last = m.start() + told["used"]
        s, e = layer.place(m.start(), last)
        if layer.end is not None and last == len(layer.text):
            e = layer.end
        whole = True
        for text, cut in _windows(_inflated(_pieces(layer.text, m.start()), {})):
            whole &= not cut
            yield Layer(text, _Same(s), _Same(e))
        if not whole:
            state["oversize"] += 1
            state["cut"].add((s, e))


def _base64_runs(text: str) -> Iterator[tuple[int, int, str, Sequence[int]]]:
    """Start, end, characters without padding and their places, of each run that may be base64.

    A run is taken from each of its first four characters on: what is written before the data then shifts no byte of
    them. Lines that follow each other are one run besides their own ones."""
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        for k in range(4):
            n = len(body) - ((len(body) - k) % 4 == 1)
            yield m.start() + k, m.end(), body[k:n], range(m.start() + k, m.start() + n)
    if "\n" not in text and "\r" not in text and "\\" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines, new, old, size, at = [], array("q"), array("q"), 0, m.start()
        for gap in [*_BREAK.finditer(text, m.start(), m.end()), None]:
            end = gap.start() if gap else m.end()
            line = text[at:end].rstrip("=")
            lines.append(line)
            new.append(size)
            old.append(at)
            size += len(line)
            at = gap.end() if gap else end
        body = "".join(lines)
        if len(body) >= 16:
            for k in range(4):
                n = len(body) - ((len(body) - k) % 4 == 1)
                places = _Lines(new, old, k, n)
                yield places[0], m.end(), body[k:n], places


class _Lines:
    """Places of the characters from ``k`` to ``n`` of lines joined into one run."""

    def __init__(self, new: Sequence[int], old: Sequence[int], k: int, n: int):
        self.new, self.old, self.k, self.n = new, old, k, n

    def __len__(self) -> int:
        return self.n - self.k

    def __getitem__(self, j: int) -> int:
        r = bisect_right(self.new, j + self.k) - 1
        return self.old[r] + j + self.k - self.new[r]


def _from_base64(layer: Layer) -> Iterator[Layer]:
    for _, b, body, at in _base64_runs(layer.text):
        try:
            raw = base64.b64decode(body.translate(_STANDARD) + "=" * (-len(body) % 4))
        except binascii.Error:
            continue
        text = raw.decode("latin-1")  # a character for each byte: hits and further layers begin in ASCII alone
        yield Layer(text, _OfBytes(layer.starts, at, 0), _OfBytes(layer.ends, at, 1), layer.ends[b - 1])


class _Same:
    """One place for all of a layer's characters."""

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, k: int) -> int:
        return self.value


class _OfBytes:
    """Places of bytes decoded from base64 characters at the given places of a layer; side 0 for starts, 1 for ends."""

    def __init__(self, outer, at: Sequence[int], side: int):
        self.outer, self.at, self.side = outer, at, side

    def __getitem__(self, k: int) -> int:
        return self.outer[self.at[min(len(self.at), -(-(k + 1) * 4 // 3)) - 1 if self.side else k * 4 // 3]]


def _unwrapped(layer: Layer, state: dict) -> Iterator[Layer]:
    for step in (_from_escapes, _from_wide, _from_base64):
        yield from step(layer)
    yield from _from_packed(layer, state)


def scan(text: str | None) -> dict:
    """``base`` hits of the text, ``spans`` of all layers (both sorted), number of ``layers`` and of ``oversize`` ones, and
    the places of these (``cut``)."""
    text = text or ""
    base = base_hits(text)
    spans, state, layers = set(base), {"oversize": 0, "cut": set()}, 1
    seen: set[bytes] = set()
    todo = [_unwrapped(Layer(text, range(len(text)), range(1, len(text) + 1)), state)]
    while todo:  # a layer is done with before its next sibling is made
        new = next(todo[-1], None)
        if new is None:
            todo.pop()
            continue
        n = len(new.text)
        if not n:
            continue
        key = hashlib.sha256(f"{new.starts[0]}:{new.ends[n - 1]}:".encode() + new.text.encode(errors="surrogatepass")).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for a, kind, b in base_hits(new.text):
            s, e = new.place(a, b)
            spans.add((s, kind, e))
        todo.append(_unwrapped(new, state))
    return {"base": base, "spans": sorted(spans), "layers": layers, **state}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanning():
    def step(ids, texts):
        cols = ([], [], [], [], [], [], [], [])
        for i, t in zip(ids, texts, strict=True):
            r = scan(t)
            counts = [sum(k == n for _, k, _ in r["base"]) for n in range(3)]
            for c, v in zip(cols, (i, *counts, hashlib.sha256(joined(r["base"]).encode()).hexdigest(), joined(r["spans"]), r["layers"], r["oversize"]), strict=True):
                c.append(v)
        return cols

    return step


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base hits, their digest, all spans, layers entered and oversize ones, for each row."""
    return common.map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text_col), _scanning, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers int, oversize int")


def redacted(text: str | None) -> str | None:
    """The text with every span of every layer, and runs of oversize ones, masked; overlapping spans become one mask."""
    if not text:
        return text
    whole: list[list[int]] = []
    found = scan(text)
    for a, b in sorted({*((a, b) for a, _, b in found["spans"]), *found["cut"]}):
        if whole and a < whole[-1][1]:
            whole[-1][1] = max(b, whole[-1][1])
        else:
            whole.append([a, b])
    out, at = [], 0
    for a, b in whole:
        out += (text[at:a], MASK)
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with secrets in the text masked; texts without any stay as they are."""
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in common.chunks(batch):
                col = part.column(place)
                yield part.set_column(place, part.schema.field(place), pa.array([redacted(t) for t in col.to_pylist()], col.type))

    return df.mapInArrow(common.Tidied(run), df.schema)

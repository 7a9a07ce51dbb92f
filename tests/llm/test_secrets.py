import base64
import bz2
import gzip
import hashlib
import lzma
import re
import tracemalloc
import urllib.parse
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import queries, secrets

SECRET = 'password: "hunter2hunter"'
ENCODERS = {
    "url": lambda s: urllib.parse.quote(s, safe="").replace("h", "%68"),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
    "bz2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
}


def spelled(text):
    """The contract's base spans, written out plainly."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, (p, n) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "SECRET", "token", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "\n", "ſecret", "-"]), max_size=14).map("".join))
def test_base_is_the_contract(text):
    assert secrets.base_hits(text) == spelled(text)


@pytest.mark.parametrize("outer", ENCODERS)
@pytest.mark.parametrize("inner", ENCODERS)
def test_nested_layers(inner, outer):
    text = "é before " + ENCODERS[outer](ENCODERS[inner](SECRET)) + " after"
    r = secrets.scan(text)
    assert any(k == 0 for _, k, _ in r["spans"])
    for a, _, b in r["spans"]:
        assert 9 <= a < b <= len(text) - 6
    masked = secrets.redacted(text)
    assert masked.startswith("é before ") and masked.endswith(" after") and not any(k == 0 for _, k, _ in secrets.scan(masked)["spans"])


def test_exact_places():
    text = "x=%41KIA" + "Z" * 16 + " ."
    assert secrets.joined(secrets.scan(text)["spans"]) == "access:2:24"
    inner = "ab AKIA" + "Q" * 17
    text = "q " + base64.b64encode(inner.encode()).decode()
    (a, _, b), = secrets.scan(text)["spans"]
    assert a == 2 + 4 and b <= len(text)


def test_cycles_and_layers_end():
    deep = SECRET
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert secrets.scan(deep)["spans"]
    same = base64.b64encode(zlib.compress(zlib.compress(b"secret=abcdefgh"))).decode()
    assert len(secrets.scan(same)["spans"]) == 1
    assert secrets.scan("%25" * 50 + "41")["layers"] >= 2


def test_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "token=abcdefg", 3), (3, "token=abcdefg", 3), (4, "x" * 200000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(secrets.scan_secrets(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_assign, r.spans, r.base_sha256 == empty) for r in got] == [(1, 0, "", True), (2, 0, "", True), (3, 1, "assign:0:13", False), (3, 1, "assign:0:13", False), (4, 0, "", True)]
    kept = secrets.redact_secrets(df)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect())[2:4] == ["[REDACTED]", "[REDACTED]"]
    assert secrets.redact_secrets(df.limit(0)).count() == 0


def test_op6_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_secret_scan"](spark, sf).collect():
        base = spelled(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(filter(None, secrets.joined(base).split(","))) <= set(r.spans.split(","))


def wrapped(raw, columns, newline="\n"):
    line = base64.b64encode(raw).decode()
    return newline.join(line[k : k + columns] for k in range(0, len(line), columns))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("columns", [20, 64, 76])
@pytest.mark.parametrize("before", ["see: ", "word\n", "-----BEGIN IT-----\n"])
def test_wrapped_base64(columns, newline, before):
    # the secret straddles lines of 64 and of 76 columns; the first line ends within a character of two bytes
    plain = "n" * 47 + "é token=" + "Zx9Qw" * 12 + " end"
    text = before + wrapped(plain.encode(), columns, newline) + " after"
    a, b = next((a, b) for a, k, b in secrets.scan(text)["spans"] if k == 0 and b - a > 80)
    kept = [i for i in range(len(before), len(text) - 6) if not text[i].isspace()]
    at = len(plain[:49].encode())
    assert a in (kept[at * 4 // 3], kept[at * 4 // 3] + 1) and b <= kept[-(-(at + 66) * 4 // 3) - 1] + 1
    assert not any(b - a > 80 for a, _, b in secrets.scan(secrets.redacted(text))["spans"])


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress])
def test_wrapped_compressed(pack):
    noise = " ".join(hashlib.sha256(bytes([k])).hexdigest()[:20] for k in range(60))
    text = "see: " + wrapped(pack((noise + " " + SECRET).encode()), 76)
    assert any(k == 0 for _, k, _ in secrets.scan(text)["spans"])


def test_wrapped_is_linear():
    assert secrets.scan("x" * 300000 + "\n" + "ab\n" * 50000)["spans"] == []


@pytest.mark.parametrize("odd", ["\u00a0", "\u3000", "\u200b", "\u200d", "\u00ad", "\f", "\0", "\x1b"])
def test_odd_characters_hide_nothing(odd):
    plain = "ab" + odd + "AKIA" + "Q" * 17 + odd
    text = "q " + base64.b64encode(plain.encode()).decode() + " e"
    at = len(("ab" + odd).encode())
    assert secrets.scan(text)["spans"] == [(2 + at * 4 // 3, 1, 2 - (-(at + 21) * 4 // 3))]
    nested = base64.b64encode((odd + ENCODERS["base64"](SECRET) + odd).encode()).decode()
    assert any(k == 0 for _, k, _ in secrets.scan(nested)["spans"])


def test_binary_hides_nothing():
    text = base64.b64encode(b"\x89\xff\xfe" + SECRET.encode() + b"\xc3\x28\x00").decode()
    assert any(k == 0 for _, k, _ in secrets.scan(text)["spans"])


PACKERS = [zlib.compress, gzip.compress, bz2.compress, lzma.compress]


@pytest.mark.parametrize("pack", PACKERS)
@pytest.mark.parametrize("spell", [
    lambda raw: "".join(f"%{b:02x}" for b in raw), lambda raw: "".join(f"\\x{b:02x}" for b in raw),
    lambda raw: urllib.parse.quote(raw), lambda raw: "".join(f"\\u{b:04x}" for b in raw), lambda raw: base64.b64encode(b"head " + raw).decode(),
])
def test_compressed_by_any_decoder(spell, pack):
    text = "é— " + spell(pack(SECRET.encode())) + " —é"
    found = [(a, b) for a, k, b in secrets.scan(text)["spans"] if k == 0]
    assert found and all(3 <= a < b <= len(text) - 3 for a, b in found)
    twice = "é— " + spell(pack(pack(SECRET.encode()))) + " —é"
    assert secrets.scan(twice)["spans"]


@pytest.mark.parametrize("pack", PACKERS)
@pytest.mark.parametrize("gap", [b"", b"\0" * 8])
def test_later_members(pack, gap):
    half = len(SECRET) // 2
    parts = [b"nothing here ", SECRET[:half].encode(), SECRET[half:].encode(), b" end"]
    text = base64.b64encode(gap.join(map(pack, parts))).decode()
    assert (0, 0, len(text)) in secrets.scan(text)["spans"]


def test_damaged_member_keeps_its_start():
    noise = b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(4000))
    raw = gzip.compress(SECRET.encode() + b" " + noise)
    text = base64.b64encode(raw[:-8] + b"damaged!").decode()
    assert any(k == 0 for _, k, _ in secrets.scan(text)["spans"])


def test_beyond_the_largest_layer(spark):
    packer = zlib.compressobj()
    raw = b"".join([*(packer.compress(b"ab, " * (1 << 18)) for _ in range(70)), packer.compress(SECRET.encode()), packer.flush()])
    text = "x " + base64.b64encode(raw).decode() + " y"
    r = secrets.scan(text)
    assert r["oversize"] == 0 and r["spans"] == [(2, 0, len(text) - 2)]
    assert secrets.redacted(text) == "x [REDACTED] y"


@pytest.fixture
def small(monkeypatch):
    for name, value in {"WINDOW": 4096, "MAX_LAYER": 16384, "OVERLAP": 512, "BLOCK": 1000, "PIECE": 700}.items():
        monkeypatch.setattr(secrets, name, value)


@pytest.mark.parametrize("filler", [b"some words in a row ", b"a,", b"\0", b"line.\n\n"])
@pytest.mark.parametrize("inner", [*ENCODERS, "raw gzip", "wrapped"])
@pytest.mark.parametrize("before", [0, 4080, 4090, 30000])
def test_windows(small, filler, inner, before):
    noise = "-".join(hashlib.sha256(bytes([k])).hexdigest()[:20] for k in range(200))
    plain = noise + " " + SECRET
    hidden = gzip.compress(plain.encode(), mtime=0) if inner == "raw gzip" else wrapped(plain.encode(), 64).encode() if inner == "wrapped" else ENCODERS[inner](SECRET).encode()
    filled = (filler * before)[:before] + b", "
    whole = filled + hidden + b" ," + filler * 2000
    parts = list(secrets._windows(whole[k : k + 1000] for k in range(0, len(whole), 1000)))
    assert not any(cut for _, cut in parts) and "".join(p for p, _ in parts).encode("latin-1") == whole
    text = base64.urlsafe_b64encode(bz2.compress(whole)).decode()
    assert (0, 0, len(text)) in secrets.scan(text)["spans"]


def test_what_nothing_divides(small, spark):
    text = "x " + base64.urlsafe_b64encode(bz2.compress(b"Zz" * 40000)).decode() + " y"
    r = secrets.scan(text)
    assert r["oversize"] == 1 and secrets.redacted(text) == "x [REDACTED] y"


def test_oversize_is_kept(spark, sf):
    assert "oversize" in queries.QUERIES["op6_secret_scan"](spark, sf).columns


ESCAPED = [
    "password", "token", "secret", "=", ": ", " ", '"', "abcdef", "AKIA", "QQQQQQQQQQQQQQQQ", "0123456789abcdef", "deadbeef00", "é", "\n", "\n\n", ", ", "a word ", "%", "%25", "%3d", "%41", "%4", "1", "\\u0041", "\\u00",
    "&#61;", "&#x3d;", "\\x3d", "\\u{3d}", "%u003d", "\\ud83d\\ude00", base64.b64encode(b"secret=abcdefgh").decode(), base64.b64encode(gzip.compress(b"token: abcdefgh", mtime=0)).decode(), urllib.parse.quote(zlib.compress(b"AKIA" + b"Z" * 16)),
    "%2573ecret%253Dabcdefghi", "c2VjcmV0PWFi\nY2RlZmdoaWprbA==",
]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(ESCAPED), max_size=24).map("".join))
def test_surroundings_are_enough(text):
    """Layers of what surrounds the decoded parts give the spans that whole layers give."""
    found = []
    for small in (1 << 30, 0):
        secrets.SMALL = small
        try:
            found.append(secrets.scan(text)["spans"])
        finally:
            secrets.SMALL = 1 << 12
    assert found[0] == found[1]


def test_long_texts_in_little_memory():
    text = "some plain words, and more of them. " * 100_000 + "%41KIA" + "Z" * 16 + " " + "%25" * 200 + "41 \\u0073ecret=abcdefgh " + "and so on, " * 100_000
    tracemalloc.start()
    r = secrets.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = 3_600_000
    assert {(at, 1, at + 22)} <= set(r["spans"]) and any(text[a:b] == "\\u0073ecret=abcdefgh" for a, _, b in r["spans"])
    assert peak < 8 * len(text)


HIDDEN = "password=hunter2secret"
PLAIN = base64.b64encode(HIDDEN.encode()).decode()


@pytest.mark.parametrize("n", [1200, 100_000])
def test_deep_escapes_end(n):
    """Nested from the front, from behind, through Unicode escapes and through both kinds in turn."""
    for text, first in ((f"x password%{'25' * n}3Dhunter222 y", 2), (f"%7{'%3' * n}0assword=hunter22", 0), (f"\\u005c{'u005c' * n}u0070assword=hunter22", 0), (f"%5cu0025{'5cu0025' * n}70assword=hunter22", 0)):
        found = secrets.scan(text)
        end = len(text) - 2 * (first == 2)
        assert (first, 0, end) in found["spans"] and found["layers"] < 12
        assert "hunter" not in secrets.redacted(text)


@pytest.mark.parametrize(
    "text",
    [f"id_{PLAIN}", f"v1+{PLAIN}", f"a{PLAIN}", f"/b/{PLAIN}", f"x-y-{PLAIN}-z", f"path/to_{PLAIN.rstrip('=')}/more"]
    + [base64.b64encode(HIDDEN.encode(code)).decode() for code in ("utf-16", "utf-16-le", "utf-16-be", "utf-32")]
    + [gap.join(PLAIN[k : k + 8] for k in range(0, len(PLAIN), 8)) for gap in ("\n", "\n> ", "\r\n>> ", "\\n", "\\r\\n", '",\n  "', "\n# ", "\\\n")],
)
def test_shifted_quoted_and_wide_base64(text):
    for around in ("{}", "> {}", "see {} there", '{{"k": "{}"}}'):
        whole = around.format(text)
        found = secrets.scan(whole)["spans"]
        assert any(k == 0 and whole[a:b] for a, k, b in found), whole
        masked = secrets.redacted(whole)
        assert PLAIN[4:20] not in masked and not any(k == 0 for _, k, _ in secrets.scan(masked)["spans"])


def test_nested_escapes_among_others():
    assert secrets.redacted("100% sure %41 and 5%25 off, %2570assword=hunter22, %zz") == f"100% sure %41 and 5%25 off, {secrets.MASK}, %zz"
    assert secrets.redacted("\\ud83d\\ude00 \\u005cu0070assword=hunter22 \\ud800") == f"\\ud83d\\ude00 {secrets.MASK} \\ud800"
    edits = secrets._edits("%2541%2542 %43 %%341", "url")
    assert [(a, b, c) for a, b, c, _ in edits] == [(0, 5, "A"), (5, 10, "B"), (11, 14, "C"), (15, 20, "A")]

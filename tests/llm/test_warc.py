import base64
import gzip
import hashlib
import random

import pytest

from tallyforge.llm import common, queries, warc


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((str(rng.randrange(9)), "t", rng.randrange(5), "f", 0, 0) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("url, key", [(None, "-"), ("http://www.A.example.com:80/X?b=2&a=1#f", "com,example,a)/x?a=1&b=2"), ("https://b.org", "org,b)/"), ("http://[bad", "http://[bad")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_damage_is_found():
    raw = warc.record("response", 1, "http://a.b/\r\nX: y", warc._START, b"abc", warc.digest_of(b"abc"))
    headers, payload = warc.parse(raw)
    assert payload == b"abc" and headers["warc-target-uri"] == "http://a.b/%0D%0AX:%20y"
    for bad in (raw.replace(b"abc", b"abd"), raw[:-3], b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)


def expected(rows):
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(i, best.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw, keep = (html or "").encode(), best[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_rows(spark):
    rows = [(1, "http://a.b/1", "x"), (2, None, None), (3, "http://a.b/1", ""), (4, "http://a.b/2", "x"), (4, "http://a.b/2", "x"), (5, "http://z.b/", "é" * 100000)]
    rows += [(k, f"http://h{k % 7}.org/p{k % 5}", f"body {k % 11}") for k in range(10, 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS digest", "1 AS keeper")
    for fan_in, per_file in ((128, 10**6), (2, 100), (3, 7)):
        where = common.shared_dir(spark)
        runs = warc.write_archives(df.repartition(7), where)
        index = warc.merge_runs(spark, where, runs, fan_in=fan_in, range_captures=per_file)
        captures = warc.read_captures(spark, where, index)
        assert answer(captures) == expected(rows)
        fs, base = common.filesystem(where)
        entries = [warc._entry(line) for r in index for line in fs.open_input_stream(f"{base}/{r[0]}").read().splitlines()]
        assert entries == sorted(entries) and len(entries) == len(rows) == sum(n for _, n in index)
        assert len(index) >= len(rows) // per_file / 2
        name = entries[0][3]
        assert gzip.decompress(fs.open_input_file(f"{base}/{name}.warc.gz").read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    where = common.shared_dir(spark)
    assert warc.read_captures(spark, where, warc.merge_runs(spark, where, warc.write_archives(df.limit(0), where))).count() == 0


def test_long_runs(tmp_path, monkeypatch):
    """A range of a run is read from a known place, and even parts come of uneven runs."""
    monkeypatch.setattr(warc, "STEP", 3)
    fs, base = common.filesystem(f"file://{tmp_path}")
    rng = random.Random(2)
    entries = {f"r{k}": sorted((f"k{rng.randrange(500):03d}", "t", rng.randrange(9), "f", j, 1) for j in range(n)) for k, n in enumerate((1, 30, 1000))}
    runs = [warc._spill(fs, base, name, list(e)) for name, e in entries.items()]
    assert runs == [(name, len(e)) for name, e in entries.items()]
    bounds = warc.cuts(fs, base, runs, 8)
    assert len(bounds) == 7 and bounds == sorted(set(bounds))
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        parts.append(list(warc.LoserTree([warc._part(fs, base, name, low, high) for name, _ in runs])))
    assert [e for p in parts for e in p] == sorted(e for es in entries.values() for e in es)
    assert max(map(len, parts)) < 2 * 1031 / 8


def test_null_ids_and_hot_payloads(spark):
    rows = [(None, "u", "same"), (None, "u", "alone"), (7, "u", "same"), (7, "v", "same"), (8, "u", "other")] + [(k, "w", "same") for k in range(10, 210)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    where = common.shared_dir(spark)
    got = warc.read_captures(spark, where, warc.merge_runs(spark, where, warc.write_archives(df, where))).collect()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert len(got) == len(rows) and (None, "revisit", 209) in kinds and (None, "response", None) in kinds
    assert {k for k in kinds if k[0] not in (None, 8)} == {(i, "response" if i == 209 else "revisit", None if i == 209 else 209) for i in (7, *range(10, 210))}


def test_op9_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert answer(queries.QUERIES["op9_warc_index"](spark, sf)) == expected(rows)

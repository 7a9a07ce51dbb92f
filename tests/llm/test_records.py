import io
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import common, queries, records


@pytest.fixture(scope="module")
def coder():
    return records.Encoder(records.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(records.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "it's", "é", "12", "###", ".", " ", "<|endoftext|>", "\x1c", "日本", "_x"]), max_size=12).map("".join), min_size=1, max_size=5))
def test_words_are_the_whole_text(coder, library, texts):
    whole = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, ends = coder(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == whole and ends[-1] == len(ids)
        coder.forget()


def test_special_tokens_are_what_the_library_gives(coder, library):
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "plain words here"]
    ids, ends = coder(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in ids[: ends[0]].tolist()


def test_cache_keeps_frequent_words(coder, library, monkeypatch):
    monkeypatch.setattr(records, "CACHED", 4)
    coder.forget()
    for text in ("one two three four five", "x two three", "six seven eight two", "nine two six ten", "one six two three"):
        assert coder([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert {"two", "six"} <= set(coder.words) and "seven" not in coder.words


def test_portions_hold_every_row():
    rows = ["x" * n for n in (0, 3 << 20, 10, 2 << 20, 1 << 20, 1 << 20, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
    parts = list(records._portions(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(rows)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= records.PORTION + (1 << 20) for p in parts)


def test_damage_is_found():
    for ids in ([], [1, 2], [1, 70_000]):
        raw = array("I", ids).tobytes()
        assert list(records.read_stream(io.BytesIO(records.frame(records.packed(-5, raw))))) == [(-5, raw)]
    good = records.frame(records.packed(7, array("I", [3, 4]).tobytes()))
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.read_stream(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.read_stream(io.BytesIO(good[:-1])))


def expected(rows, library):
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = array("I", [*library.encode(text or "", add_special_tokens=False).ids, 2])
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_rows(spark, library):
    rows = [(5, "hello there world"), (1, None), (3, ""), (9, "word " * 30000), (7, "same"), (7, "same"), (2, "x <|endoftext|> y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    where = common.shared_dir(spark)
    files = records.write_records(df, where)
    got = sorted(tuple(r) for r in records.read_records(spark, where, files).collect())
    assert got == expected(rows, library)
    assert records.read_one(where, files[0][0], 0) == (1, [2])
    where = common.shared_dir(spark)
    assert records.read_records(spark, where, records.write_records(df.limit(0), where)).count() == 0


def test_op7_query(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op7_token_records"](spark, sf).collect()) == expected(rows, library)

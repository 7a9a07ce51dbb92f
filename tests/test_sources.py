import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parse, text
from tallyforge.operators import analytics, anomaly, dedupe, features, forest, match, review
from tallyforge.sources import export, mapping, readers
from tallyforge.streaming import dedup


@pytest.mark.parametrize("lines, want", [(["a,b", "1,2"], ","), (["a;b;c", "1,5;2;3"], ";"), (["a\tb"], "\t"), (["plain"], ","), ([], ",")])
def test_sniff(lines, want):
    assert readers.sniff_delimiter(lines) == want


def test_header_and_binary():
    assert readers.repaired_header(["a", "", "a", "﻿b"]) == ["a", "Column 2", "a (2)", "b"]
    assert readers.looks_binary("\x00\x01" * 100) and not readers.looks_binary("text\n")


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text('title;\nname;price\n"a;b ""q""";1,5\n\nshort\nlong;2;3\n', encoding="utf-8")
    rows = readers.read_table(spark, str(tmp_path / "x.csv")).collect()
    assert [tuple(r) for r in rows] == [('a;b "q"', "1,5"), ("short", ""), ("long", "2")]
    (tmp_path / "b.csv").write_bytes(b"\x00\x01\x02" * 500)
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "b.csv"))


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"site": "s", "data": [{"n": 1, "m": {"k": "x"}, "l": [1, 2]}, {"n": 2}]}')
    rows = readers.read_table(spark, str(tmp_path / "a.json")).select("site", "n", "`m.k`", "l").collect()
    assert [tuple(r) for r in rows] == [("s", "1", "x", "1; 2"), ("s", "2", "", "")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "y"}\n')
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / "b.jsonl")).select("a", "b").collect()) == [("1", ""), ("2", "y")]
    (tmp_path / "c.xml").write_text("<all><row id='1'><a>x</a></row><row id='2'><a>y</a></row></all>")
    assert sorted(r.a for r in readers.read_table(spark, str(tmp_path / "c.xml")).collect()) == ["x", "y"]


@pytest.mark.parametrize("text, want", [
    ('{"meta": [{"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}], "prices": [{"n": 1, "p": 10}, {"n": 2, "p": 20}]}', [{"n": "1", "p": "10"}, {"n": "2", "p": "20"}]),
    ('{"y": 7, "Beans": {"mk": [{"p": 1}, {"p": 2}]}, "Maize": {"unit": "kg", "mk": [{"p": 3}]}}',
     [{"y": "7", "group": "Beans", "unit": "", "p": "1"}, {"y": "7", "group": "Beans", "unit": "", "p": "2"}, {"y": "7", "group": "Maize", "unit": "kg", "p": "3"}]),
    ('{"Beans": {"p": 1}, "Maize": {"p": 2, "q": "x"}}', [{"group": "Beans", "p": "1", "q": ""}, {"group": "Maize", "p": "2", "q": "x"}]),
    ('{"all": {"s": "t", "list": [{"p": 1}, {"p": 2}]}}', [{"s": "t", "p": "1"}, {"s": "t", "p": "2"}]),
    ('[{"a": {"p": 1}, "b": {"p": 2}}]', [{"a.p": "1", "b.p": "2"}]),
])
def test_json_finds_all_rows(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    rows = [r.asDict() for r in readers.read_table(spark, str(tmp_path / "a.json")).collect()]
    assert sorted(rows, key=str) == sorted([{k: r[k] for k in rows[0]} for r in want], key=str) and set(rows[0]) == set(want[0])


def test_mapping(spark):
    df = spark.createDataFrame([("2026-09-01", "Kimironko", "Beans", "Retail", "1,200 RWF")], "Itariki string, Market_Name string, Product string, Level string, Amount string")
    assert mapping.suggest_mapping(df, more={"date": ("itariki",)}) == {"date": "Itariki", "market": "Market_Name", "commodity": "Product", "price_type": "Level", "price": "Amount"}
    assert mapping.missing_required({"market": "x"}) == ["commodity", "price"]
    assert mapping.channel_from_name("Farm-gate 2026.csv") == "farmgate"


@pytest.mark.parametrize("raw, want", [("1,200 RWF", 1200.0), ("n/a", None), ("0", 0.0), ("-50", -50.0), ("1-2", None), ("1.2.3", None), ("1.200,50", 1.2005), ("", None), (None, None)])
def test_price(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(parse.price(F.col("x"))).collect()[0][0] == want


@pytest.mark.parametrize("raw, want", [("2026-9-3", "2026-09-03"), ("28/09/2026", "2026-09-28"), ("28 Sep 2026", "2026-09-28"), ("Sep 2026", "2026-09-01"), ("Sep 28, 2026", "2026-09-28"), ("2026-09-28T10:00", "2026-09-28"), ("30/02/2026", None), ("", None)])
def test_date(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(parse.date(F.col("x")).cast("string")).collect()[0][0]
    assert got == want


@pytest.mark.parametrize("raw, want", [("Kgs", "kg"), ("liter", "litre"), ("Eggs", "piece"), ("Bunches", "bunche"), ("", None)])
def test_unit(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(parse.unit(F.col("x"))).collect()[0][0] == want


@pytest.mark.parametrize("a, b, want", [("red widget", "red widgt", 0.685), ("blue bolt", "blue bolt x", 0.87), ("", "x", 0.0), ("a", "a", 1.0)])
def test_similarity(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.similarity(F.col("a"), F.col("b")), text.similarity(F.col("b"), F.col("a"))).collect()[0]
    assert row[0] == pytest.approx(want, abs=2e-3) and row[0] == row[1]


def prices(spark, rows):
    cols = "seq long, id string, date string, market string, commodity string, channel string, price double"
    return spark.createDataFrame([(k, str(k), *r) for k, r in enumerate(rows)], cols).withColumn("date", F.col("date").cast("date")).withColumn("province", F.lit("P"))


def test_outlier_and_ladder_fixture(spark):
    rows = [("2026-09-01", "M", "maize", "retail", float(p)) for p in (600, 620, 580, 590, 610, 6000)]
    df = prices(spark, [*rows, ("2026-09-01", "Musanze", "maize", "farmgate", 700.0), ("2026-09-01", "Musanze", "maize", "retail", 580.0)])
    out = {r.id: r for r in anomaly.price_outliers(df).collect()}
    assert set(out) == {"5"} and out["5"].severity == "critical"
    viol = anomaly.ladder_violations(df).collect()
    assert [(r.record_id, r.check, r.severity, r.gap, r.confidence) for r in viol] == [("7", "farmgate>retail", "critical", 20.6897, 0.8534)]


def test_duplicates_fixture(spark):
    rows = [("2026-09-01", "M", "maize", "retail", 5.0), ("2026-09-01", "m", "Maize", "retail", 5.0), ("2026-09-01", "M", "maize", "retail", 6.0), ("2026-09-01", "N", "x", "retail", None), ("2026-09-01", "N", "x", "retail", None)]
    got = {r.id: (r.original_id, r.type) for r in dedupe.exact_duplicates(prices(spark, rows)).collect()}
    assert got == {"1": ("0", "EXACT_DUPLICATE"), "2": ("0", "PROBABLE_DUPLICATE"), "4": ("3", "EXACT_DUPLICATE")}


def test_matching_fixture(spark):
    catalog = spark.createDataFrame([("red widget", False), ("blue bolt", False), ("hot rod", True), ("widget red", False)], "commodity string, archived boolean")
    names = spark.createDataFrame([(n,) for n in ("red widget", "blue bolt x", "hot rod", "laptop", "", "blue blot")], "name string")
    got = {r.name: r.status for r in match.decide(names, catalog).collect()}
    assert got == {"red widget": "ambiguous", "blue bolt x": "auto", "hot rod": "archived", "laptop": "unknown", "": "empty", "blue blot": got["blue blot"]}


def test_forest_fixture(spark):
    rows = [("2026-09-01", f"M{k % 9}", "maize", ("farmgate", "wholesale", "retail")[k % 3], 100.0 + k % 7 + 20 * (k % 3)) for k in range(300)]
    rows.append(("2026-09-02", "M1", "maize", "retail", 5000.0))
    f = features.price_features(prices(spark, rows))
    model = forest.train(f)
    best = forest.score(f, model).orderBy(F.desc("score")).first()
    assert best.id == "300" and best.score > model.threshold
    found = forest.findings(forest.score(f, model), model, prices(spark, rows).limit(0)).collect()
    assert "300" in {r.id for r in found} and len(found) <= 15


def test_price_groups_fixture(spark):
    rows = spark.createDataFrame([(k, str(k), "d", "m", "c", "kg", ch) for k, ch in enumerate(["retail", "farmgate", "retail", "farmgate", None])], "seq long, id string, date string, market string, commodity string, unit string, channel string")
    assert {r.id: r.part for r in review.price_groups(rows).collect()} == {"0": 0, "1": 0, "2": 1, "3": 1, "4": -1}


def test_review_fixture(spark):
    raw = spark.createDataFrame([("a", "d", "1", "c", "m", "ch", "u"), ("b", "d", "2", "c", "m", "ch", "u")], "id string, raw_date string, raw_price string, raw_commodity string, raw_market string, raw_channel string, raw_unit string")
    edits = spark.createDataFrame([("a", "raw_price", "9", 1, "human"), ("a", "raw_price", "8", 2, "ai")], "id string, field string, value string, at int, via string")
    got = {r.id: (r.raw_price, r.corrected) for r in review.current(raw, edits).collect()}
    assert got == {"a": ("8", True), "b": ("2", False)}


def test_filters(spark):
    df = prices(spark, [("2026-09-01", "M", "maize", "retail", 5.0), ("2026-09-05", "N", "beans", "farmgate", 50.0)]).withColumn("district", F.lit("D")).withColumn("unit", F.lit("kg"))
    assert [r.id for r in analytics.matching(df, {"search": "MAI", "most": 10}).collect()] == ["0"]
    assert analytics.matching(df, {"channel": "retail"}, ("channel",)).count() == 2


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01 00:10:00", "a", 1.0), (2, "2026-01-01 00:20:00", "a", 2.0), (3, "2026-01-02 00:00:00", "a", 5.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = dedup.run_available(dedup.windowed(stream), spark).collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0)]


def test_detect_is_the_plain_search():
    """Against the rule spelled out: the first header equal to a word of the field, else the first that holds one."""
    rng = random.Random(3)
    pool = ["Observation date", "commodity_name", "Average Price", "Price type", "market place", "UOM", "Crop", "Province", "x", "Unit price (RWF)", "level", "Day", "Currency code"]
    for _ in range(50):
        headers = rng.sample(pool, rng.randrange(1, len(pool)))
        for field, got in mapping.detect_columns(headers).items():
            want = None
            for test in (lambda k, w: k == w, lambda k, w: w in k):
                for h in headers:
                    key = "_".join("".join(c if c.isalnum() else " " for c in h.lower()).split())
                    if want is None and any(test(key, w) for w in mapping.DETECT[field]):
                        want = h
            assert got == want


def test_words_that_were_lacking():
    found = mapping.detect_columns(["observation_date", "commodity", "market_name", "unit_price", "market_level", "unit_of_measure"])
    assert found == {"date": "observation_date", "province": None, "district": None, "market": "market_name", "commodity": "commodity", "price_type": "market_level", "unit": "unit_of_measure", "price": "unit_price", "currency": None}


def test_values_decide(spark):
    rows = [("2026-09-01", "Gasabo", "Kigali City", "Kimironko", "Beans", "yes", "1", "900", "12")] * 3 + [("2026-09-02", "Musanze", "Northern Province", "Byumba", "Maize", "no", "2", "1,000 RWF", "13")] * 3
    df = spark.createDataFrame(rows, "created_on string, Region string, Area string, Markets string, commodity_name string, price string, market_id string, average_price string, product string")
    got = mapping.suggest_mapping(df, districts=["Gasabo", "Musanze"])
    assert got == {"date": "created_on", "district": "Region", "province": "Area", "market": "Markets", "commodity": "commodity_name", "price": "average_price"}
    assert mapping.geography_shares(df, "Area", ["Gasabo"]) == (0.0, 1.0)


def test_wide_sheets(spark):
    df = spark.createDataFrame([("Beans", "100", "", "300"), ("Maize", "n/a", "50", "70"), ("Peas", "10", "20", " ")], "Product string, `Farm gate price` string, Wholesale string, `Retail price` string")
    assert mapping.channel_columns(df) == {"wholesale": "Wholesale", "retail": "Retail price"}  # a third of the first one is no number
    long = sorted(map(tuple, mapping.unpivot_channels(df.drop("Farm gate price")).collect()))
    assert long == [("Beans", "retail", "300"), ("Maize", "retail", "70"), ("Maize", "wholesale", "50"), ("Peas", "wholesale", "20")]
    assert mapping.unpivot_channels(df.select("Product", "Wholesale")).columns == ["Product", "Wholesale"]


def test_nested_export(spark, tmp_path):
    rows = [
        {"id": 1, "created_on": "2026-09-28T08:00:00", "market": {"name": "Kimironko", "district": "Gasabo", "province": 5}, "product": {"id": 7, "commodity_name": "ibishyimbo  byera", "commodity_name_en": "white beans", "commodity_unit": "Kg"}, "price_1": 500.0, "price_2": 700.0, "price_type": "RETAIL"},
        {"id": 2, "entry_date": "2026-09-27", "market_name": "Byumba", "commodity_code": 8, "average_price": 300.5, "price_1": 1.0},
        {"id": 3, "entry_date": "2026-09-27", "market_name": "Byumba", "commodity_code": 9, "price_type": ""},
    ]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    df = spark.read.json(str(tmp_path / "x.json"), multiLine=True)
    assert export.is_export(df) and not export.is_export(df.select("id", "product"))
    products = spark.createDataFrame([(8, "imboga", "greens", "Bunch"), (9, "imboga", "spinach", "Bunch")], "id long, commodity_name string, commodity_name_en string, commodity_unit string")
    got = [tuple(r) for r in export.export_rows(df, products, channel="farmgate").orderBy("export_id").collect()]
    assert got == [
        ("2026-09-28", "Kigali City", "Gasabo", "Kimironko", "Ibishyimbo byera", "RETAIL", "Kg", "600.0", "1"),
        ("2026-09-27", "", "", "Byumba", "Greens", "farmgate", "Bunch", "300.5", "2"),
        ("2026-09-27", "", "", "Byumba", "Spinach", "farmgate", "Bunch", "", "3"),
    ]
    assert export.export_rows(df.limit(0)).count() == 0

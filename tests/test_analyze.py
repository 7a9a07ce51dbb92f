import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import forest, match
from tallyforge.plans import analyze


def test_upload_to_findings(spark):
    rows = [("2026-09-01", "Kimironko", "maize flour", "retail", "kg", str(p)) for p in (600, 620, 580, 590, 610, 6000)]
    rows += [("30/02/2026", "Musanze", "Maize flour", "Farm Gate", "Kgs", "700"), ("2026-09-01", "Musanze", "laptop", "retail", "crate", "n/a"), ("2026-09-01", "Musanze", "maize flour", "retail", "kg", "-5")]
    df = spark.createDataFrame(rows, "Day string, Market string, Product string, Level string, Unit string, Price string")
    catalog = spark.createDataFrame([("maize flour", "kg", False)], "commodity string, unit string, archived boolean")
    registry = spark.createDataFrame([("Kimironko", "Gasabo", "Kigali"), ("Musanze", "Musanze", "North")], "market string, district string, province string")
    a = analyze.analyze(analyze.upload(df), catalog, registry, with_forest=False)
    found = {(r.type, r.severity) for r in a.issues.collect()}
    assert {("MISSING_VALUE", "critical"), ("INVALID_DATE", "high"), ("INVALID_PRICE", "critical"), ("UNIT_INCONSISTENCY", "medium"), ("UNKNOWN_ENTITY", "high"), ("PRICE_ANOMALY", "critical")} <= found
    assert a.records.count() == 9 and a.coverage.count() == 2
    assert 0 <= a.score.first().total <= 100
    with pytest.raises(ValueError):
        analyze.upload(df.select("Day"))


def test_equal_rows_of_an_upload_are_duplicates(spark):
    rows = [("2026-09-01", "Musanze", "maize flour", "retail", "kg", "600")] * 3
    df = spark.createDataFrame(rows, "Day string, Market string, Product string, Level string, Unit string, Price string")
    catalog = spark.createDataFrame([("maize flour", "kg", False)], "commodity string, unit string, archived boolean")
    registry = spark.createDataFrame([("Musanze", "Musanze", "North")] * 2, "market string, district string, province string")
    a = analyze.analyze(analyze.upload(df), catalog, registry, with_forest=False)
    assert a.records.select("id").distinct().count() == a.records.count() == 3
    assert [r.type for r in a.issues.where("category = 'duplicate'").collect()] == ["EXACT_DUPLICATE"] * 2


def test_markets_are_matched(spark):
    registry = spark.createDataFrame([("Nyabugogo", "Nyarugenge", "Kigali"), ("Karenge", "Rwamagana", "East"), ("Kicukiro Market", "Kicukiro", "Kigali")], "market string, district string, province string")
    asked = ["nyabugogo mkt", "karenje", "laptop", "kicukiro market", "kicukiro", ""]
    got = {r.name: (r.status, r.match) for r in match.decide_markets(spark.createDataFrame([(n,) for n in asked], "name string"), registry).collect()}
    assert got["nyabugogo mkt"] == ("exact", "Nyabugogo") and got["kicukiro market"] == got["kicukiro"] == ("exact", "Kicukiro Market")
    assert got["karenje"][1] == "Karenge" and got["karenje"][0] in ("auto", "review") and got["laptop"][0] == "unknown" and got[""][0] == "empty"


def test_dates(spark):
    forms = {
        "2026-9-5": "2026-09-05", "5/9/2026": "2026-09-05", "28-09-2026": "2026-09-28", "28 September 2026": "2026-09-28", "September 28, 2026": "2026-09-28", "Monday, September 28, 2026": "2026-09-28",
        "Mon, Sep 28, 2026": "2026-09-28", "Sept. 2026": "2026-09-01", "2026-09-28T10:00": "2026-09-28", "30/02/2000": None, "2026-13-01": None, "Foo 3, 2001": None, "": None, "soon": None,
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string").select("t", parse.date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == forms


def test_quantile_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "SORTED", 50)
    monkeypatch.setattr(forest, "BINS", 16)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=5000), np.repeat([1.0, 2.0, 1e9], [3000, 1999, 1]), np.exp(20 * rng.normal(size=2000)), np.zeros(7), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        for q in (0.0, 0.3, 0.975, 1.0):
            assert forest.quantile(df, "v", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)


def test_stored_forest():
    x = np.random.default_rng(0).normal(size=(300, 8))
    model = forest.fit(x, trees=10)
    again = forest.from_json(forest.to_json(model))
    assert (again.scores(x) == model.scores(x)).all()
    assert forest.from_json(forest.to_json(model).replace('"ratio"', '"other"')) is None
    assert len(forest.fit(x[:0]).trees) == 0

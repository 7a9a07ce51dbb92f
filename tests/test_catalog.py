"""The catalog build on a few rows whose answers are told by hand."""

from tallyforge.operators import catalog, match

PRODUCT = "id long, commodity_code string, commodity_name string, commodity_name_en string, commodity_name_fr string, commodity_unit string, archived boolean"
REGISTRY = "id long, market_code string, name string, district string, registry_province string, linked_province string"


def test_commodities(spark):
    rows = [(1, "c1", "ibigori", " maize  grain", "mais", "KG", False), (2, None, "ibigori", None, None, None, None), (3, "c3", "amateke", "Yams", "yams", "piece", True), (4, "c4", None, None, None, "box", True)]
    prices = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, None), (3, 5.0), (9, 1.0)], "id long, price double")
    built = catalog.commodities(spark.createDataFrame(rows, PRODUCT), prices)
    got = {r.id: r for r in built.collect()}
    assert got[1].commodity == "Maize grain" and got[1].aliases == ["Ibigori", "Mais"] and got[1].reference_farmgate == 15 and got[1].unit == "kg"
    assert got[2].commodity == "Ibigori" and got[2].aliases == [] and got[2].reference_farmgate is None and got[2].unit == "kg" and got[2].code == ""
    assert got[3].aliases == ["Amateke"] and got[3].archived and got[4].commodity == ""
    assert {r.unit for r in catalog.valid_units(built).collect()} == {"kg", "litre", "piece", "bunch", "box"}
    assert {(r.name, r.id) for r in catalog.archived_names(built).collect()} == {("yams", 3)}
    owners = {r.name: r.owners for r in match.exact_owners(spark.createDataFrame([("ibigori",), ("mais",), ("zz",)], "name string"), match.forms(built)).collect()}
    assert owners == {"ibigori": ["Ibigori", "Maize grain"], "mais": ["Maize grain"]}


def test_markets(spark):
    rows = [
        (1, "7", "NEW market", "alpha", "North", "North"), (2, "8", "new MARKET", "Beta", "North", None), (3, "9", "New Market", "beta", "", "East"),
        (4, None, "Old Market", "nowhere", "West", None), (5, "3", None, None, None, None), (6, "5", "Sole", "Alpha", "South", "South"),
    ]
    districts = spark.createDataFrame([("Alpha", "North"), ("Beta", "East")], "district string, province string")
    labelled = catalog.markets(spark.createDataFrame(rows, REGISTRY), districts)
    got = {r.id: r for r in labelled.collect()}
    assert [got[k].market for k in sorted(got)] == ["New Market (Alpha)", "New Market (Beta, code 8)", "New Market (Beta, code 9)", "Old Market", "", "Sole"]
    assert got[2].province == "East" and got[2].conflicts == ["North"] and got[3].conflicts == [] and got[6].conflicts == ["South"]
    assert got[4].province == "West" and got[4].district == "Nowhere" and got[4].conflicts == [] and got[5].province == ""
    told = {(r.kind, r.subject): r.note for r in catalog.notes(labelled).collect()}
    assert told["provinces", ""].startswith("2 ") and told["name", "New Market"].startswith("3 ") and len(told) == 4


def test_empty(spark):
    none = spark.createDataFrame([], REGISTRY)
    labelled = catalog.markets(none, spark.createDataFrame([], "district string, province string"))
    assert labelled.count() == 0 and catalog.notes(labelled).count() == 0
    built = catalog.commodities(spark.createDataFrame([], PRODUCT), spark.createDataFrame([], "id long, price double"))
    assert built.count() == 0 and match.forms(built).count() == 0

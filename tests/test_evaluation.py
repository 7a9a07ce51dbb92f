"""Calibration against plain loops, decisions by calibrated bounds, and injected errors against loops over the flagged rows."""

import pytest

from tallyforge.operators import calibrate, evaluate, match
from tallyforge.plans.views import records

NAMES = ["maize grain", "red onion", "green bean", "sweet potato", "irish potato", "palm oil", "x", "rye"]


@pytest.fixture(scope="module")
def found(spark):
    catalog = spark.createDataFrame([(n,) for n in NAMES], "commodity string")
    cases = calibrate.misspelt(catalog, "commodity").selectExpr("'misspelt' AS `group`", "kind", "want", "raw")
    foreign = spark.createDataFrame([("foreign", "none", None, n) for n in ("cement", "diesel fuel", "onion ring", None, "")], cases.schema)
    return calibrate.judged(cases.union(foreign), match.forms(catalog)).cache()


def test_misspelt(spark):
    rows = calibrate.misspelt(spark.createDataFrame([("banana",), ("x",), ("rye",), ("tfn",), ("",), (None,)], "n string"), "n").collect()
    by = {(r.want, r.kind): r.raw for r in rows}
    assert len(rows) == 20
    assert len(by["banana", "drop"]) == 5 and sorted(by["banana", "swap"]) == sorted("banana") and len(by["banana", "vowel"]) == 6
    assert sum(a != b for a, b in zip(by["banana", "vowel"], "banana", strict=True)) == 1
    assert by["x", "drop"] == "x" and by["x", "vowel"] == "xa" and by["rye", "swap"] == "rye" and by["rye", "vowel"] == "ryi" and by["tfn", "vowel"] == "tfna"


def plain(rows, review, margin):
    """Acceptance bound, wrong and waiting cases of a margin by trying every step."""
    asked = [r for r in rows if r.want is not None]
    free = [r for r in asked if r.score >= review and not r.tie and not (r.dissent is not None and r.dissent >= margin)]
    accept = next((a for a in calibrate.ACCEPTS if any(r.score >= a for r in free) and all(r.right for r in free if r.score >= a)), 0.9)
    auto = [r for r in free if r.score >= accept]
    return accept, sum(not r.right for r in auto), sum(r.score >= review and r not in auto for r in asked if r.group == "misspelt")


def test_calibration(found):
    rows = found.collect()
    assert len(rows) == 45
    assert all(r.right and r.score == 1 for r in rows if r.kind in ("as it is", "spacing"))
    review = calibrate.review_bound(found)
    worst = max(r.score for r in rows if r.want is None)
    assert abs(review - min(0.8, max(0.4, worst + 0.02))) <= 0.005
    swept = calibrate.sweep(found, review, 0.9).collect()
    assert {r.margin: (r.accept, r.wrong, r.reviews) for r in swept} == {m: plain(rows, review, m) for m in calibrate.MARGINS}
    limits = calibrate.calibrate(found)
    best = min(swept, key=lambda r: (r.wrong, r.reviews, -r.margin))
    assert (limits.accept, limits.review, limits.veto) == (best.accept, review, best.margin)
    assert calibrate.from_json(calibrate.to_json(limits)) == limits
    told = {(r.group, r.kind): r for r in calibrate.report(found, limits).collect()}
    assert told["misspelt", "as it is"].accepted == 1 and told["misspelt", "drop"].wrong == 0
    assert told["foreign", "none"].n == 5 and told["foreign", "none"].wrong == 0


def test_no_cases(spark, found):
    limits = calibrate.calibrate(found.limit(0))
    assert limits.review == calibrate.LOWEST and limits.suggest is None and limits.accept == match.Thresholds().accept


def test_veto_and_suggestion(spark):
    """With an endless margin the model never caps; a suggestion names the model's owner where spelling has none."""
    catalog = spark.createDataFrame([(n, False) for n in NAMES], "commodity string, archived boolean")
    names = spark.createDataFrame([("sweet irish potato",), ("green beans",), ("palm",), ("zzz",), ("",)], "name string")
    strict = {r.name: r for r in match.decide(names, catalog).collect()}
    lax = {r.name: r for r in match.decide(names, catalog, match.Thresholds(veto=9.0)).collect()}
    assert all(lax[n].score >= strict[n].score for n in strict)
    kind = {r.name: r for r in match.decide(names, catalog, match.Thresholds(review=0.8, suggest=0.3)).collect()}
    assert kind["palm"].match == "palm oil" and kind["palm"].status == "review" and kind["palm"].score <= 0.89
    assert kind["zzz"].status == "unknown" and kind[""].status == "empty" and set(kind) == set(strict)


def test_rounds(spark):
    rec = records(spark, "/root/testdata/sf0.001")
    rows = evaluate.rounds(rec, 2, 5).cache()
    got = [r.asDict() for r in rows.collect()]
    before = {r.id: r.price for r in rec.collect() if r.price > 0}
    assert len(got) == 2 * len(before) and len({r["id"] for r in got}) == len(got)
    changed = [r for r in got if r["injected"]]
    assert {r["kind"] for r in changed} >= {"times_ten", "tenth", "plus_60"}
    sets = {(r["date"], r["market"], r["commodity"]) for r in got if r["kind"]}
    assert len(sets) == len(changed) == len({(r["date"], r["market"], r["commodity"]) for r in changed})
    factor = {"times_ten": 10, "tenth": 0.1, "plus_60": 1.6}
    for r in got:
        was = before[r["id"].split("|")[1]]
        if not r["injected"]:
            assert r["price"] == was
        elif r["kind"] in factor:
            assert r["price"] == pytest.approx(was * factor[r["kind"]])
    found = evaluate.flags(rows, None).cache()
    flagged = {(r.id, r.layer) for r in found.collect()}
    told = {(r.kind, r.layer): (r.n, r.share) for r in evaluate.layer_recall(rows, found).collect()}
    for kind in (None, *{r["kind"] for r in changed}):
        for layer in ("statistics", "ladder", "forest", "all"):
            hit, every = set(), set()
            for r in got:
                if r["kind"] == kind:
                    unit = r["id"] if kind is None else (r["date"], r["market"], r["commodity"])
                    every.add(unit)
                    if any((r["id"], x) in flagged for x in ((layer,) if layer != "all" else ("statistics", "ladder"))):
                        hit.add(unit)
            n, share = told[kind, layer]
            assert n == len(every) and share == pytest.approx(len(hit) / len(every), abs=6e-5)

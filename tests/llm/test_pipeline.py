import corpus_pipeline
from tallyforge.llm import common, neardup, pieces, quality, secrets

from .test_neardup import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    where = common.shared_dir(spark)
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], sf)
        if k < 4:
            assert out.columns == docs.columns
        steps.append(common.written(out, f"{where}/{k}"))
    good, one, clean, mixed, ids = ({r.doc_id: r for r in s.collect()} for s in steps[1:])
    before = {r.doc_id: r for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(good) == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert set(one) == {i for i, _, _, kept in brute([(i, r.text) for i, r in good.items()], 5) if kept}
    assert set(clean) == set(one)
    for i, r in clean.items():
        assert r.text == secrets.redacted(before[i].text)
    assert set(mixed) <= set(clean)
    v = pieces.vocabulary(pieces.model_path())
    rows = steps[4].collect()
    spelled = sorted(((r.doc_id, pieces.decode(r.ids, v)) for r in steps[5].collect()))
    assert spelled == sorted((r.doc_id, r.text) for r in rows)
    again = [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(again) == sorted(r.doc_id for r in rows) and set(ids) == set(mixed)


def test_odd_rows_through_all_stages(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows and clashing names: no stage stops, and each keeps its columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "plain words here", "en", "src1", 3), (10**7, None, None, None, None), (10**7 + 1, "", "en", None, 0), (10**7 + 2, "long " * 60_000, "en", "src1", 5)]
    odd += [(10**7 + 3, "said twice " * 40, "en", "src1", 1)] * 3 + [(10**7 + 3, "another text of that id " * 30, "en", "src2", 1)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'a' AS kept", "1 AS nth", "2 AS uses", "3 AS src", "4 AS size", "5 AS h", "'b' AS component_id", "6.0D AS score", "'c' AS ids")
    names, where = docs.columns, common.shared_dir(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, sf), f"{where}/{k}")
        if k < 4:
            assert docs.columns == names, name
            assert docs.where("kept <> 'a' OR nth <> 1 OR h <> 5 OR ids <> 'c'").count() == 0
        assert docs.where("doc_id < 10000000").count() > 0
    assert docs.columns == ["doc_id", "ids"]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert neardup.keep_one(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0

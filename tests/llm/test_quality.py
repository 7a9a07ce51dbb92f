import math
import zlib

import numpy as np

from tallyforge.llm import quality, queries


def test_fit_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.WIDTH))
    y = (x[:, 3] > -0.5).astype(int)
    m = quality.fit(x, y)
    s = m.score(x)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97
    assert s[y == 1].mean() > s[y == 0].mean()


def test_one_label_only():
    m = quality.fit(np.zeros((3, quality.WIDTH)), np.ones(3, int))
    assert m.score(np.zeros((1, quality.WIDTH))).tolist() == [0.5]


def test_fit_is_the_least_loss():
    """All pairs of one good row and a few bad ones, by plain steps along the gradient."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 0, 1, 0, 0, 0, 0])
    model = quality.fit(x, y, rivals=1)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    pairs = [[float(a - b) for a, b in zip(z[2], z[k], strict=True)] for k in range(7) if k != 2]
    w = [0.0] * quality.WIDTH
    for _ in range(4000):
        slope = [-quality.RIDGE * v for v in w]
        for d in pairs:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(d, w, strict=True))))
            slope = [s + (1 - p) * v for s, v in zip(slope, d, strict=True)]
        w = [v + 0.005 * s for v, s in zip(w, slope, strict=True)]
    assert np.allclose(model.weights, w, atol=1e-3)
    raw = sorted(float(r @ np.array(w)) for r in z)
    assert math.isclose(model.cut, (raw[5] + raw[6]) / 2, abs_tol=1e-2)  # six of seven are bad


def test_doc_ids_with_several_texts(spark):
    docs = spark.createDataFrame([(k, "word " * (k + j)) for k in (0, 2, 3, 4, 6) for j in range(3)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (0, 2, 3, 4, 6)], "doc_id long, quality int")
    models = [quality.learn(d, labels) for d in (docs, docs.orderBy("text"), docs.repartition(7))]
    assert all((m.weights == models[0].weights).all() and m.cut == models[0].cut for m in models)


def test_op3_is_a_plain_run(spark, sf):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = sorted((np.array(quality.features(r["text"])).tobytes(), label[r["doc_id"]]) for r in docs if r["doc_id"] in label and not held(r["doc_id"]))
    model = quality.fit(np.array([np.frombuffer(x) for x, _ in rows]), np.array([y for _, y in rows]))
    want = [(r["doc_id"], held(r["doc_id"]), s, int(s >= 0.5)) for r in docs for s in [float(model.score(np.array([quality.features(r["text"])]))[0])]]
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in queries.QUERIES["op3_quality_ranking"](spark, sf).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and math.isclose(a[2], b[2], rel_tol=1e-9)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "good words here. " * 50000, 0.3), (3, "good words here. " * 50000, 0.3), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality.learn(docs, labels)
    got = quality.score(docs, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.keep_good(docs, m).columns == docs.columns
    empty = quality.learn(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0


def test_op3_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op3_quality_ranking"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    again = {r.doc_id: r.score for r in queries.QUERIES["op3_quality_ranking"](spark, sf).collect()}
    assert all(again[r.doc_id] == r.score for r in got)

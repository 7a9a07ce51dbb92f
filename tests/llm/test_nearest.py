import numpy as np

from tallyforge.llm import nearest, queries


def brute(rows, top=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    for q in ids[ids % 20 == 0]:
        s = np.zeros(len(ids))
        for d in range(x.shape[1]):
            s += good[q][d] * x[:, d]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[int(q)] = [(int(ids[k]), s[k]) for k in order]
    return out


def compared(got, want):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, found in by.items():
        exact = dict(want[q])
        assert len(found) == len(want[q]) and [f for f in found] == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += sum(i in exact for i, _ in found)
        total += len(found)
        assert all(s == exact[i] for i, s in found if i in exact)
    return hits / max(1, total)


def test_codes_shrink_parallel_error():
    x = np.random.default_rng(0).normal(size=(2000, 64)).astype(np.float32)
    m = nearest.Model(x)
    direction, u, norm, cell = m._residuals(x.astype(np.float64))
    best = m._codes(direction, u)
    plain = np.stack([((u.reshape(len(u), m.groups, 2)[:, g, None] - m.words[g]) ** 2).sum(axis=2).argmin(axis=1) for g in range(m.groups)], axis=1)

    def along(codes):
        e = u - m.words[np.arange(m.groups), codes].reshape(len(u), -1)
        return ((e * direction).sum(axis=1) ** 2).mean()

    assert along(best) < along(plain)
    cell, norm, code = m.encode(x[:50])
    centre, table = m.tables(x[:3].astype(np.float64))
    score = sum(table[g][:, code[:, g]] for g in range(code.shape[1])) * norm + centre[:, cell]
    assert np.corrcoef(score.ravel(), (x[:3] @ x[:50].T).ravel())[0, 1] > 0.9


def test_recall_of_full_blocks():
    """Rows by the ten thousands: normal ones, ones of many lengths, and clusters."""
    rng = np.random.default_rng(1)
    n, normal = 20_000, rng.normal(size=(20_000, 64))
    tables = {"normal": normal, "lengths": normal * rng.lognormal(size=(n, 1)), "clusters": rng.normal(size=(20, 64))[rng.integers(20, size=n)] + 0.3 * normal}
    for name, x in tables.items():
        x = x.astype(np.float32)
        model = nearest.Model(x[: nearest.FIT_ROWS])
        cell, norm, code = model.encode(x)
        asked = np.arange(0, n, 400)
        best = nearest.Best(model, x[asked], nearest.RERANK)
        for lo in range(0, n, 7000):
            best.add(cell[lo : lo + 7000], norm[lo : lo + 7000], np.ascontiguousarray(code[lo : lo + 7000].T))
        assert all(len(set(p.tolist())) == nearest.RERANK for p in best.place)
        top = np.argsort(-(x[asked].astype(np.float64) @ x.T.astype(np.float64)), axis=1)[:, :20]
        assert np.mean([len(set(p.tolist()) & set(t.tolist())) / 20 for p, t in zip(best.place, top, strict=True)]) > 0.95, name


def test_blocks_change_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    monkeypatch.setattr(nearest, "RERANK", 40)
    one = sorted(nearest.search(df).collect())
    monkeypatch.setattr(nearest, "ROW_BLOCK", 17)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    assert sorted(nearest.search(df).collect()) == one


def test_an_id_with_two_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 40, rng.normal(size=4).astype(np.float32).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = {(i, tuple(v)): np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for r in nearest.search(df).collect():
        assert any(abs(float(a @ b) - r.score) < 1e-12 for (i, _), a in x.items() if i == r.query_id for (j, _), b in x.items() if j == r.vec_id)


def test_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400, 500)]  # ties
    bad = [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [None] + [1.0] * 5), (1080, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS score")
    assert compared(nearest.search(df).collect(), brute(rows)) == 1.0
    assert compared(nearest.search(df.where("vec_id < 5")).collect(), brute(rows[:5])) == 1.0
    assert nearest.search(df.limit(0)).count() == 0
    assert nearest.search(df.where("vec_id = 0")).count() == 0


def test_op8_recall(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    assert compared(queries.QUERIES["op8_nearest_vectors"](spark, sf).collect(), want) >= 0.97
    monkeypatch.setattr(nearest, "ROW_BLOCK", 500)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 30)
    monkeypatch.setattr(nearest, "RERANK", 64)
    assert compared(queries.QUERIES["op8_nearest_vectors"](spark, sf).collect(), want) >= 0.9

import zlib

import numpy as np
import pytest

from tallyforge.llm import langid, queries


def test_machines():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] > 0.1, 1, -1)
    w = langid.svm(x, y.astype(np.float32))
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95


def test_machine_is_the_least_loss():
    """Against plain steps along the gradient of the squared hinge, each side weighing half."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.1, 1, -1)

    def slope_and_loss(w):
        slope, loss = [float(v) for v in w], 0.5 * sum(float(v) ** 2 for v in w)
        for row, side in zip(x.tolist(), y.tolist(), strict=True):
            row = [*row, 1.0]
            slack = max(0.0, 1 - side * sum(a * b for a, b in zip(row, w, strict=True)))
            share = 0.5 / sum(int(s == side) for s in y)
            loss += langid.COST * share * slack**2
            slope = [s - 2 * langid.COST * share * slack * side * v for s, v in zip(slope, row, strict=True)]
        return slope, loss

    w = [0.0] * 4
    for _ in range(4000):
        w = [v - 0.01 * s for v, s in zip(w, slope_and_loss(w)[0], strict=True)]
    found = langid.svm(x, y.astype(np.float32), steps=500)
    assert np.allclose(found, w, atol=0.02) and slope_and_loss(found.tolist())[1] <= slope_and_loss(w)[1] + 1e-3


def test_one_versus_one_by_hand():
    rng = np.random.default_rng(3)
    langs = ["en", "de", "nl", "fr", "es", "xx"] * 8
    x = np.abs(rng.normal(size=(48, 16))).astype(np.float32) + 2 * np.eye(16, dtype=np.float32)[[langs.index(v) for v in langs]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.fit(x, langs)
    for row, (got, _) in zip(x, model.predict(x), strict=True):
        z = np.append(row, 1)
        own = max(model.families, key=lambda f: float(z @ model.family_weights[:, model.families.index(f)]))
        rank = {}
        for a in model.members[own]:
            margins = [float(z @ w) * (1 if a == p[0] else -1) for p, w in model.pairs.items() if a in p]
            rank[a] = (sum(m > 0 for m in margins), sum(np.tanh(m) for m in margins))
        assert got == max(rank, key=lambda a: rank[a])


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(rows, per_language=2)


def test_op5_is_a_plain_run(spark, sf):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    has = lambda t: t is not None and any(c.isalpha() for c in t)
    rows = sorted((langid.features(r["text"]).astype(np.float16).tobytes(), r["lang"]) for r in docs if not held(r["doc_id"]) and r["lang"] is not None and has(r["text"]))
    assert len(rows) < langid.PER_LANGUAGE  # all of them are learnt
    model = langid.fit(np.array([np.frombuffer(x, np.float16) for x, _ in rows], np.float32), [y for _, y in rows])
    want = {r["doc_id"]: model.predict(langid.features(r["text"])[None])[0][0] if has(r["text"]) else "und" for r in docs}
    assert {r.doc_id: r.lang_pred for r in queries.QUERIES["op5_language_id"](spark, sf).collect()} == want


def test_degenerate_models():
    x = langid.features("some words")[None]
    assert langid.fit(x[:0], []).predict(x) == [("und", 0.0)]
    assert langid.fit(x, ["en"]).predict(x)[0][0] == "en"
    assert langid.fit(np.vstack([x, langid.features("qqq zzz")[None]]), ["en", "xx"]).predict(x)[0][0] == "en"


def test_rows(spark):
    text = {"en": "the and of with this ", "de": "der und das nicht ein ", "fr": "le la une dans avec ", "es": "el los una con para "}
    rows = [(i, text[lang] * (1 + i % 3), lang, 1.0) for i in range(200) for lang in [sorted(text)[i % 4]]]
    rows += [(1000, None, "en", 0.0), (1001, "", "de", 0.0), (1002, "12 $ 34", None, 0.0), (1003, "der und das " * 50000, None, 0.0), (1003, "der und das " * 50000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.learn(df, per_language=20)
    got = langid.predict(df, model).collect()
    want = {i: lang for i, _, lang, _ in rows[:200]}
    assert len(got) == len(rows) and all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert langid.predict(df.limit(0), langid.learn(df.limit(0))).count() == 0


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op5_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97

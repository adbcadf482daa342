"""Classifiers: held-out accuracy, and their parts against plain formulas."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tessera.llm import common, quality_qda, toxicity

SF_LEARN = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_LEARN}/documents.parquet"), spark.read.parquet(f"{SF_LEARN}/labels.parquet")


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_quality_held_out(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality_qda.digest(docs, labels).collect()}
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if fold(r["doc_id"], 3) == 1]
    assert np.mean([p == q for p, q in held]) > 0.99
    assert np.mean([p for p, q in held if q == 1]) > 0.99


def test_quality_fit_equals_plain_moments(tables):
    docs, labels = tables
    part, some = docs.where("doc_id < 600"), labels.where("doc_id < 600")
    rows = quality_qda.feature_rows(part, ["doc_id"])
    x = {r["doc_id"]: np.array(r["features"]) for r in rows.collect()}
    learn = [(x[r["doc_id"]], r["quality"]) for r in some.collect() if fold(r["doc_id"], 3) != 1]
    model = quality_qda.fit(rows, some)
    own = [np.array([v for v, q in learn if q == k]) for k in (0, 1)]
    pooled = sum(len(o) * np.cov(o.T, bias=True) for o in own) / len(learn)
    for k in (0, 1):
        assert np.allclose(model.mean[k], own[k].mean(axis=0))
        s = 0.9 * np.cov(own[k].T, bias=True) + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        d = next(iter(x.values())) - model.mean[k]
        assert np.isclose((model.inverse_factor[k] @ d) @ (model.inverse_factor[k] @ d), d @ np.linalg.solve(s, d))
        assert np.isclose(2 * model.log_det[k], np.linalg.slogdet(s)[1])


def test_quality_odd_rows(spark, odd, none, tables):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 0), (6, 1), (7, 1), (7, 1), (None, 0)], "doc_id bigint, quality int")
    got = quality_qda.digest(odd, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    one_class = quality_qda.digest(odd, labels.where("quality = 1")).collect()
    assert all(r["score"] > 0.5 for r in one_class)
    assert all(r["score"] == 0.5 for r in quality_qda.digest(odd, labels.limit(0)).collect())
    assert quality_qda.digest(none, labels).count() == 0
    model = quality_qda.fit(quality_qda.feature_rows(odd, ["doc_id"]), labels)
    assert quality_qda.keep_rows(odd, model).columns == odd.columns


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if fold(r["doc_id"], 5) == 0]
    assert np.mean([p for p, t in held if t == 1]) > 0.85
    assert np.mean([p for p, t in held if t == 0]) < 0.03


def test_non_negative_risk_recovers_hidden_positives():
    """Half of U's positives carry the mark of P: they must not be called clean."""
    rng = np.random.default_rng(4)
    background = lambda: rng.choice(np.arange(100, 400, dtype=np.uint64), 30, replace=False)
    bad = lambda: np.unique(np.append(background(), rng.choice(np.arange(5, dtype=np.uint64), 2)))
    p, u_bad, u_good = [bad() for _ in range(200)], [bad() for _ in range(100)], [np.unique(background()) for _ in range(900)]
    model = toxicity.train(p, u_bad + u_good, 0.1)
    score = lambda s: 1 / (1 + np.exp(-(model.bias + model.weights[np.isin(model.vocabulary, s)].sum())))
    assert np.mean([score(s) >= 0.5 for s in u_bad]) > 0.95
    assert np.mean([score(s) >= 0.5 for s in u_good]) < 0.02


def dense(sets, vocabulary):
    return np.array([[float(v in s) for v in vocabulary] for s in map(set, (x.tolist() for x in sets))])


def plain_risk(w, p, u, prior):
    """(prior * R_P(+), R_U(-) - prior * R_P(-)) of a linear classifier, from the definition."""
    loss = lambda z: np.log1p(np.exp(-z))
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()


@pytest.mark.parametrize("prior, every", [(0.1, 4), (0.6, 8)])
def test_training_follows_the_numeric_gradient_of_the_risk(prior, every):
    """Weights after each number of steps equal Adam on finite differences of the risk, also where its bracket is negative."""
    rng = np.random.default_rng(9)
    draw = lambda low, high, k: np.unique(rng.choice(np.arange(low, high, dtype=np.uint64), k))
    p, u = [draw(0, 6, 3) for _ in range(40)], [np.unique(np.append(draw(20, 30, 4), draw(0, 6, 1) if k % every == 0 else [])).astype(np.uint64) for k in range(80)]
    in_p, in_u = [sum(t in set(x.tolist()) for x in p) for t in range(6)], [sum(t in set(x.tolist()) for x in u) for t in range(6)]
    words = [t for t in range(6) if in_p[t] >= 3 and prior * (in_p[t] / 40) / ((in_u[t] + 1) / 80) >= toxicity.MIN_POSTERIOR]
    assert words
    dp, du = dense(p, words), dense(u, words)
    w = np.append(np.zeros(len(words)), np.log(prior / (1 - prior)))
    m, v, negative = np.zeros(len(w)), np.zeros(len(w)), 0
    for step in range(1, 41):
        bracket = plain_risk(w, dp, du, prior)[1]
        negative += bracket < 0
        goal = (lambda x: -plain_risk(x, dp, du, prior)[1]) if bracket < 0 else (lambda x: sum(plain_risk(x, dp, du, prior)))
        g = np.array([(goal(w + e) - goal(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step in (1, 7, 40):
            model = toxicity.train(p, u, prior, steps=step, rate=0.1, penalty=0.0, min_texts=3)
            assert model.vocabulary.tolist() == words
            assert np.allclose(np.append(model.weights, model.bias), w, atol=1e-4)
    assert 0 < negative < 40  # steps of both kinds


def test_counted_vocabulary_holds_what_training_chooses(spark):
    """Spark's choice of terms is the definition's, with a margin of one in a hundred, and training on it alone gives the same model."""
    rng = np.random.default_rng(3)
    p = [np.unique(np.append(rng.choice(np.arange(50, 90, dtype=np.uint64), 6), rng.choice(np.arange(12, dtype=np.uint64), 3))) for _ in range(60)]
    u = [np.unique(rng.choice(np.arange(90, dtype=np.uint64), 9)) for _ in range(300)] + [np.zeros(0, np.uint64)]
    held = spark.createDataFrame([(mark, bytearray(s.tobytes())) for mark, sets in ((True, p), (False, u)) for s in sets], "p boolean, words binary")
    prior = 0.5
    got = toxicity._vocabulary(held, prior)
    count = lambda sets, t: sum(t in set(s.tolist()) for s in sets)
    want = [t for t in range(90) if count(p, t) >= toxicity.MIN_TEXTS and prior * (count(p, t) / len(p)) / ((count(u, t) + 1) / len(u)) >= 0.99 * toxicity.MIN_POSTERIOR]
    assert got.tolist() == want and 0 < len(want) < 90
    whole, part = (toxicity.train(*sets, prior) for sets in ((p, u), ([np.intersect1d(s, got) for s in p], [np.intersect1d(s, got) for s in u])))
    assert whole.vocabulary.tolist() == part.vocabulary.tolist() and np.allclose(whole.weights, part.weights) and np.isclose(whole.bias, part.bias)
    assert len(toxicity._vocabulary(held.where("p"), prior)) == 0


def test_an_id_with_several_texts_is_drawn_the_same_way_in_every_run(spark):
    rows = [(i, ("stupid idiot fool " if i % 4 == 0 else "kind words here ") + f"number {i}") for i in range(1, 200)]
    twins = [(i, f"stupid idiot other text {i}") for i in range(1, 200, 3)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 200)], "doc_id bigint, toxic int")
    models = [
        toxicity.fit(spark.createDataFrame(part, "doc_id bigint, text string").repartition(n), labels)
        for part, n in ((rows + twins, 2), (twins[::-1] + rows[::-1], 7))
    ]
    assert models[0].vocabulary.tolist() == models[1].vocabulary.tolist() and len(models[0].vocabulary)
    assert np.allclose(models[0].weights, models[1].weights) and np.isclose(models[0].bias, models[1].bias)


def test_terms_are_words_and_beginnings():
    data = np.frombuffer(b"Stupid stupidly x", np.uint8)
    hashes, rows = toxicity.terms(data, np.array([0, len(data)]))
    # whole words: 3; beginnings of 4, 5 bytes of both, of 6 and 7 of the longer one
    assert len(hashes) == 3 + 2 + 2 + 1 + 1 and len(rows) == len(hashes)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]), common.ALNUM)
    assert hashes[0] == common.word_hashes(np.frombuffer(b"stupid", np.uint8), np.array([0]), np.array([6]), False)[0]


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (5, 0), (7, 1), (7, 1), (None, 0)], "doc_id bigint, toxic int")
    got = toxicity.digest(odd, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.digest(none, labels).count() == 0
    assert toxicity.digest(odd, labels.limit(0)).where("predicted = 1").count() == 0

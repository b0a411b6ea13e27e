import numpy as np

from tests.llm.conftest import rows_of
from tillrec.llm import toxicity as T

BAD = ["idiotic", "scumbag", "worthless"]


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(20, 80))]
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            words[rng.integers(len(words))] = rng.choice(BAD)
            words[rng.integers(len(words))] = rng.choice(BAD).upper() + ","
        if low:
            words += ["junk"] * 4
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


def frame(spark, labels):
    return spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, places string")


def test_held_out_accuracy(spark, make_docs):
    docs, labels = corpus()
    seen = frame(spark, labels[:400])
    rows, y = T.labelled_places(make_docs(docs), seen, T.label_categories())
    chain = T.fit_chain(rows, y, ("low_quality", "toxic"))
    got = {r["doc_id"]: r for r in T.scored(make_docs(docs), chain).collect()}
    truth = {i: (not q, bool(t)) for i, q, t in labels[400:]}
    assert np.mean([got[i]["toxic"] == t for i, (_, t) in truth.items()]) > 0.97
    assert np.mean([got[i]["low_quality"] == q for i, (q, _) in truth.items()]) > 0.97
    assert chain.models[1].earlier.shape == (1,) and chain.models[0].earlier.shape == (0,)


def test_later_models_learn_from_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = T.fit
    monkeypatch.setattr(T, "EPOCHS", 1)
    monkeypatch.setattr(T, "fit", lambda rows, before, y: (seen.append((len(rows), before.copy())), real(rows, before, y))[1])
    rng = np.random.default_rng(1)
    rows = [np.array(sorted(rng.choice(1000, 5, replace=False)), dtype=np.int32) for _ in range(30)]
    labels = rng.integers(0, 2, (30, 3)).astype(np.int8)
    T.fit_chain(rows, labels, ("a", "b", "c"))
    assert [(n, b.shape[1]) for n, b in seen] == [(n, c) for c in range(3) for n in (20, 20, 20, 30)]
    # the first category's probabilities as the second sees them: from models without the row's fold
    held = np.zeros(30)
    for k in range(3):
        train = np.flatnonzero(np.arange(30) % 3 != k)
        m = real([rows[i] for i in train], np.zeros((20, 0)), labels[train, 0].astype(float))
        for i in np.flatnonzero(np.arange(30) % 3 == k):
            held[i] = m.probability(rows[i], [])
    assert np.allclose(seen[7][1][:, 0], held)


def test_sample_bound_and_odd_labels(spark, make_docs):
    docs, labels = corpus(60)
    odd = [(5, None, 1), (labels[0][0], labels[0][1], 1), (None, 1, 1), (999, 1, 0)]
    rows, y = T.labelled_places(make_docs(docs + docs[:3]), frame(spark, labels + odd), T.label_categories(), max_rows=30)
    assert len(rows) == len(y) <= 30
    rows, y = T.labelled_places(make_docs(docs + docs[:3]), frame(spark, labels + odd), T.label_categories())
    assert len(rows) == 60 and y[0, 1] == 1


def test_edges(spark, make_docs):
    docs = make_docs([(1, None), (1, ""), (None, "idiotic"), (3, "word " * 50_000)])
    rows, y = T.labelled_places(docs, frame(spark, []), T.label_categories())
    chain = T.fit_chain(rows, y, ("low_quality", "toxic"))
    got = rows_of(T.scored(docs, chain), "doc_id", "toxic", "low_quality")
    assert sorted(got, key=str) == sorted([(1, False, False)] * 2 + [(None, False, False), (3, False, False)], key=str)
    assert T.scored(make_docs([]), chain).collect() == []


def test_threshold_is_the_best_f1():
    p, y = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0, 0])
    assert 0.3 < T.best_threshold(p, y) < 0.8
    assert T.best_threshold(p, np.zeros(5)) > 1

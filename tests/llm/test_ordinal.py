import random

import numpy as np

from thalweg.llm import ordinal as O


def corpus(n, seed):
    r = random.Random(seed)
    common = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(common, k=r.randint(20, 200))
        toxic, poor = r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zidiot", "zmoron"]))
        if poor:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in O.digest(df, seen).collect()}
    assert len(got) == 900
    right = [got[i].kept == (q == 1 and t == 0) for i, q, t in labels[600:]]
    assert np.mean(right) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_keep <= 1 for r in got.values())
    means = [np.mean([got[i].expected_grade for i, q, t in labels[600:] if (0 if t else 2 if q else 1) == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    again = {r.doc_id: r.p_keep for r in O.digest(df.repartition(5), seen).collect()}
    assert all(again[i] == got[i].p_keep for i in again)


def test_thresholds_are_ordered():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 60)
    cols = np.concatenate([[g * 10, g * 10 + 1, g * 10 + 2, 5] for g in y]).astype(np.int32)
    m = O.fit(y, np.full(60, 3), np.full(60, 4), cols, np.tile(np.array([1, 1, 1, 0], np.int8), 60))
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.linspace(-3, 3, 7))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails, axis=0) > 0).all()


def test_nulls_no_labels_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "word " * 50, "c"), (None, "x", "d")], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = O.digest(df, none).collect()
    assert len(got) == 4 and all(r.kept and r.p_keep is None for r in got)
    assert O.keep(df, None).columns == df.columns and O.keep(df, None).count() == 4
    docs, labels = corpus(200, 1)
    m = O.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert O.classify(df, m).columns == ["doc_id", "text", "expected_grade", "p_keep", "kept"] and O.classify(df, m).count() == 4
    assert O.classify(df.limit(0), m).count() == 0


def test_long_texts_train_with_all_their_words():
    words = [f"w{k}" for k in range(9000)]
    n, f, c = O.features(" ".join(words))
    assert n == 3 * 9000 == c.sum() and {x for w in words for x in O.word_features(w)} <= set(f.tolist())


def loss(t, w, y, X):
    """Mean negative log likelihood of the cumulative-link model, written out grade by grade."""
    th = [-np.inf, *t, np.inf]
    up = lambda x: 1 / (1 + np.exp(-x))
    return -np.mean([np.log(up(th[g + 1] - x @ w) - up(th[g] - x @ w)) for g, x in zip(y, X)]) + O.SHRINK / 2 * (w @ w)


def test_fit_minimises_the_written_out_likelihood(monkeypatch):
    r = np.random.default_rng(4)
    n, k = 120, 5
    X = r.integers(0, 3, (n, k)).astype(float)
    y = np.clip((X @ np.array([1.0, -1, 0.5, 0, 0]) + r.normal(0, 1.5, n) + 1).round().astype(int), 0, 2)
    monkeypatch.setattr(O, "LEAST_Z", 0.0)  # all features take part
    monkeypatch.setattr(O, "SHRINK", 1e-2)
    monkeypatch.setattr(O, "STEPS", 3000)
    monkeypatch.setattr(O, "RATE", 0.02)
    cols = [np.flatnonzero(x) for x in X]
    sizes = np.full(n, 4)
    m = O.fit(y, sizes, np.array([len(c) for c in cols]), np.concatenate(cols).astype(np.int32), np.concatenate([x[c] for x, c in zip(X, cols)]).astype(np.int32))
    w, t, V = m.weights[:k].astype(float), m.thresholds.copy(), X / 2  # counts over the root of the size
    here = loss(t, w, y, V)
    for i in range(k):  # the gradient vanishes
        e = np.eye(k)[i] * 1e-4
        assert abs(loss(t, w + e, y, V) - loss(t, w - e, y, V)) / 2e-4 < 5e-3
    for i in range(2):
        e = np.eye(2)[i] * 1e-4
        assert abs(loss(t + e, w, y, V) - loss(t - e, w, y, V)) / 2e-4 < 5e-3
    assert all(loss(t + r.normal(0, 0.2, 2), w + r.normal(0, 0.2, k), y, V) > here for _ in range(50))
    p = m.tails(V @ w)
    up = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(p, np.stack([up(V @ w - c) for c in t], axis=1))


def test_very_long_texts_are_scored_whole(spark):
    docs, labels = corpus(300, 8)
    model = O.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = docs[0][1] + " neutral" * 200_000
    df = spark.createDataFrame([(1, long), (2, long + " zidiot zmoron"), (3, "w" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r.p_keep for r in O.classify(df, model).collect()}
    assert got[2] < got[1] and got[3] is not None


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    """Forty copies of a table, ids and all: the driver gets each labelled text once, with its number, and the model is that of all rows."""
    docs, labels = corpus(200, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    copies = df.crossJoin(spark.range(40).withColumnRenamed("id", "_copy")).drop("_copy").union(
        spark.createDataFrame([(7, "another text of one id"), (8, None), (8, None)], df.schema))
    seen, fit = [], O.fit

    def watched(*given):
        seen.append(given)
        return fit(*given)

    monkeypatch.setattr(O, "fit", watched)
    got = O.train(copies, spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int"))
    assert len(seen[0][0]) == 202  # ids 7 and 8 have one text more
    y, sizes, marked, cols, counts, times = seen[0]
    # labelled twice: ids 0 to 4; the added text of id 8 stands there twice
    assert times.sum() == 40 * 205 + 3 and sorted(set(times)) == [1, 2, 40, 80]
    row = np.repeat(np.arange(len(y)), times)
    ends = np.cumsum(marked)
    spread = np.concatenate([np.arange(ends[i] - marked[i], ends[i]) for i in row])
    every = fit(y[row], sizes[row], marked[row], cols[spread], counts[spread])
    assert np.allclose(got.weights, every.weights, atol=1e-4) and np.allclose(got.thresholds, every.thresholds, atol=1e-4)

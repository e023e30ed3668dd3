import math
import random

import numpy as np
import pyarrow as pa

from stemweave.llm import toxicity as X


def tables(spark, n=500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        w = [word() for _ in range(rng.choice([5, 40, 400]))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "vermin" + rng.choice(["ish", "s", "ly"])]))
        rows.append((i, " ".join(w), "x"))
        if i % 7:
            labels.append((i, int(toxic), 0))
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "word " * 30_000 + "nitwit", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in X.toxicity_scores(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert held and sum(r.predicted == int(r.doc_id % 5 == 1) for r in held) / len(held) > 0.98
    assert got[9002].predicted == 1 and got[9000].score == got[9001].score and got[9000].predicted == 0
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and all(r.doc_id % 5 != 1 or r.doc_id >= 9000 for r in kept.collect() if got[r.doc_id].held_out)
    assert {r.score for r in X.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert X.toxicity_scores(docs.limit(0), labels).count() == 0


def test_counterfactual_penalty_protects_groups(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):  # "muslim" goes with toxic labels in the sample, "christian" with clean ones
        toxic = i % 2
        group = "muslim" if toxic and rng.random() < 0.9 else "christian"
        rows.append((toxic, f"a {group} person {'nitwit' if toxic and rng.random() < 0.7 else 'here'} w{rng.randrange(200)}"))
    df = spark.createDataFrame(rows, "label int, text string")
    gap = {}
    for lam in (0.0, 20.0):
        model = X.fit(df, counterfactual=lam, steps=200)
        s = [b.column("score")[0].as_py() for t in ("a muslim person here", "a christian person here") for b in X._score_rows(model)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], ["i", "text"])])]
        gap[lam] = s[0] - s[1]
    assert gap[0.0] > 0.2 and abs(gap[20.0]) < 0.25 * gap[0.0]


def test_score_is_the_sum_of_the_weights_of_distinct_features(spark):
    docs, labels = tables(spark, 200)
    model = X.fit(X.training_rows(docs, labels, "toxic", 1000))
    weights = dict(zip(model["features"].tolist(), model["w"].tolist()))

    def feature(word, prefix=None):
        rows, feats, is_word = X._feature_rows(pa.array([word]))
        return int(feats[is_word][0]) if prefix is None else [int(f) for f in feats[~is_word]]

    def brute(text):
        import re

        feats = set()
        for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text):
            feats |= {feature(w), *feature(w, True)}
        return 1 / (1 + math.exp(-(model["b"] + sum(weights.get(f, 0.0) for f in feats))))

    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id < 40 or doc_id >= 9000 and doc_id < 9002").collect()}
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert len(weights) > 0 and all(abs(got[i] - brute(t)) < 1e-9 for i, t in texts.items())


def problem(seed=3, n=40, m=12):
    rng = np.random.default_rng(seed)
    x, z = rng.random((n, m)) < 0.3, rng.random((n, m)) < 0.3
    rx, fx = np.nonzero(x)
    ra, fa = np.nonzero(x & ~z)
    rb, fb = np.nonzero(z & ~x)
    changed = np.r_[ra, rb], np.r_[fa, fb], np.r_[np.ones(len(ra)), -np.ones(len(rb))]
    return rng.normal(size=m), 0.3, (rng.random(n) < 0.4).astype(float), (rx, fx), changed


def test_objective_and_gradient_against_finite_differences():
    w, b, y, plain, changed = problem()
    value, g, gb = X.objective(w, b, y, plain, changed, 0.7)
    x, d = np.zeros((len(y), len(w))), np.zeros((len(y), len(w)))
    x[plain] = 1
    np.add.at(d, changed[:2], changed[2])
    s = x @ w + b
    assert abs(value - (np.mean(np.log1p(np.exp(s)) - y * s) + 0.7 * np.mean((d @ w) ** 2))) < 1e-12
    h = 1e-6
    for j in range(len(w)):
        e = np.eye(len(w))[j] * h
        slope = (X.objective(w + e, b, y, plain, changed, 0.7)[0] - X.objective(w - e, b, y, plain, changed, 0.7)[0]) / (2 * h)
        assert abs(slope - g[j]) < 1e-6
    assert abs((X.objective(w, b + h, y, plain, changed, 0.7)[0] - X.objective(w, b - h, y, plain, changed, 0.7)[0]) / (2 * h) - gb) < 1e-6


def score_of(model, text):
    return next(iter(X._score_rows(model)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["i", "text"])]))).column("score")[0].as_py()


def test_neutral_mentions_are_not_called_toxic_in_four_languages(spark):
    rng = random.Random(8)
    groups = [("muslim", "christian"), ("juden", "christen"), ("musulmans", "chrétiens"), ("judíos", "cristianos")]
    rows = []
    for i in range(1600):  # the first of each pair goes with toxic labels in the sample
        a, b = groups[i % 4]
        toxic = rng.random() < 0.5
        group = a if toxic and rng.random() < 0.95 else b
        rows.append((int(toxic), f"w{rng.randrange(300)} {group} {'nitwit' if toxic and rng.random() < 0.6 else 'here'}"))
    df = spark.createDataFrame(rows, "label int, text string")
    called = {}
    for lam in (0.0, 20.0):
        model = X.fit(df, counterfactual=lam, steps=300)
        called[lam] = sum(score_of(model, f"unseen{k} {a} here") >= 0.5 for k in range(10) for a, _ in groups)
        assert model["swapped_rows"] == model["rows"] == 1600 and score_of(model, "muslim nitwit") >= 0.5
    assert called[0.0] >= 30 and called[20.0] <= called[0.0] // 4


def test_disagreeing_labels_identity_terms_alone_and_clashing_columns(spark):
    rows = [(i, "women men christians", i, i, i) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h long, _bad long, score long")
    labels = spark.createDataFrame([(i, k) for i in range(1, 40) for k in (0, 1)], "doc_id long, toxic int")
    got = X.toxicity_scores(docs, labels).collect()
    assert len({r.score for r in got}) == 1 and abs(got[0].score - 0.5) < 0.05
    kept = X.drop_toxic(docs, labels.where("toxic = 0"))
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {r[2:] for r in rows}

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsieve.operators import model as ml


def frame(spark, rows):
    return spark.createDataFrame(rows, "title string, description string, required_skills array<string>, salary_min double, salary_max double, "
                                       "source string, remote_status string, location string, role_type string")


def jobs(n, seed=1):
    rng = np.random.default_rng(seed)
    words = {"Nurse": ["patient", "ward", "care"], "Driver": ["truck", "route", "cargo"], "Cook": ["kitchen", "menu", "grill"]}
    out = []
    for i in range(n):
        role = list(words)[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        text = " ".join(rng.choice(words[role] + ["the", "and", "we", "für"], 8))
        out.append((f"job {i}", text, [words[role][0]], float(rng.integers(100, 200)) if i % 5 else None, None, rng.choice(["a", "b"]).item(), None, "x", role))
    return out


def test_learns_a_separable_table(spark):
    train, test = frame(spark, jobs(240)), frame(spark, jobs(90, 2) + [("?", "zzz unseen", [], None, None, "new source", "odd", None, "Nurse")])
    model = ml.train(train)
    got = ml.predict(model, test)
    rows = got.collect()
    assert len(rows) == 91 and all(0 < r.confidence <= 1 and r.predicted_role_type in model.labels for r in rows)
    m = ml.evaluate(got, "role_type", "predicted_role_type").first()
    assert m.accuracy >= 0.95 and m.f1_macro >= 0.9


def test_bounded_fit_still_indexes_every_term(spark):
    train = frame(spark, jobs(200))
    small, whole = ml.train(train, max_rows=60), ml.train(train)
    assert small.facts["fitted_rows"] == 60 and small.facts["rows"] == 200
    terms = lambda m: {(r.f, round(r.idf, 9)) for r in m.weights.where("idf is not null").collect()}
    assert terms(small) == terms(whole)
    m = ml.evaluate(ml.predict(small, train), "role_type", "predicted_role_type").first()
    assert m.accuracy >= 0.85


def test_weights_equal_a_dense_fit(spark):
    """The fit over inner products against plain gradient descent on the dense matrix of the same features."""
    rows = jobs(60)
    df = frame(spark, rows)
    model = ml.train(df)
    labels = model.labels
    x, y = dense(model, df)
    w, b = np.zeros((x.shape[1], len(labels))), np.zeros(len(labels))
    target = np.eye(len(labels))[[labels.index(v) for v in y]]
    weight = np.array([len(rows) / (len(labels) * y.count(v)) for v in y])
    for _ in range(30_000):
        m = x @ w + b
        p = np.exp(m - m.max(1, keepdims=True))
        g = weight[:, None] * (p / p.sum(1, keepdims=True) - target)
        w, b = w - 0.002 * (x.T @ g + w), b - 0.002 * g.sum(0)
    p = np.exp((x @ w + b) - (x @ w + b).max(1, keepdims=True))
    want = (p / p.sum(1, keepdims=True)).max(1)
    got = np.array([r.confidence for r in ml.predict(model, df).orderBy("title").collect()])
    assert np.abs(np.sort(want) - np.sort(got)).max() < 2e-3


def dense(model, df):
    """The feature matrix and the labels, by title."""
    f = ml.feature_frame(df).withColumn("_row", F.xxhash64("title"))
    idf = {r.f: r.idf for r in model.weights.where("idf is not null").collect()}
    cats = {r.f: i for i, r in enumerate(model.weights.where("idf is null").orderBy("f").collect())}
    cols = {t: i for i, t in enumerate(sorted(idf))}
    order = {r["_row"]: i for i, r in enumerate(f.orderBy("title").collect())}
    x = np.zeros((len(order), len(cols) + len(cats) + 3))
    for r in ml.term_counts(f).collect():
        x[order[r["_row"]], cols[r.f]] = r.tf * idf[r.f]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for r in ml._category_features(f).collect():
        x[order[r["_row"]], len(cols) + cats[r.f]] = 1
    y = []
    for r in f.select("role_type", *[model.number(c).alias(c) for c in ml.NUMERIC], "title").orderBy("title").collect():
        x[len(y), -3:] = [r[c] for c in ml.NUMERIC]
        y.append(r.role_type)
    return x, y


def test_empty_frames(spark):
    with pytest.raises(ValueError, match="empty"):
        ml.train(frame(spark, []))
    with pytest.raises(ValueError, match="role_type"):
        ml.feature_frame(frame(spark, jobs(1)).drop("role_type"))


def test_grams_and_counts(spark):
    df = spark.createDataFrame([(1, "Die Ü-Bahn fährt, die Ü-Bahn"), (2, ""), (3, None), (4, "a b")], "_row bigint, combined_text string")
    got = {r["_row"]: list(r.g) for r in df.select("_row", ml.grams("combined_text").alias("g")).collect()}
    assert got[1] == ["die", "bahn", "fährt", "die", "bahn", "die bahn", "bahn fährt", "fährt die", "die bahn", "die bahn fährt", "bahn fährt die", "fährt die bahn"]
    assert got[2] == [] and got[4] == []
    assert {r.tf for r in ml.term_counts(df).collect()} == {1, 2}


def test_terms_are_counted_in_place(spark):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1 + i % 9))) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "_row bigint, combined_text string")
    counts = ml.term_counts(df)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = df.select("_row", F.explode(ml.grams("combined_text")).alias("g")).groupBy("_row", F.xxhash64("g").alias("f")).agg(F.count("g").alias("tf"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    index = ml.term_index(counts, len(rows))
    assert {(r.f, r.df) for r in index.collect()} == {(r.f, r.df) for r in want.groupBy("f").agg(F.count("*").alias("df")).collect()}


def test_terms_are_never_broadcast(spark, monkeypatch):
    import re

    from jobsieve.plans import model_plans as mp
    train = frame(spark, jobs(60))
    plans = [ml.predict(ml.train(train), train)]
    monkeypatch.setattr(mp, "_frame", lambda *_: train.withColumn("doc_id", F.monotonically_increasing_id()))
    plans.append(mp.m2_term_frequencies(spark, ""))
    for d in plans:
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[f#", plan) and not re.search(r"BroadcastHashJoin \[f#", plan)
    assert plans[1].count() == 60


def test_the_fit_sees_every_row(spark):
    """More rows than the fit was once cut to: each row's own word gets a weight."""
    rows = [(f"own{i}x", "ward" if i % 2 else "truck", [], None, None, "s", None, "x", "Nurse" if i % 2 else "Driver") for i in range(4300)]
    train = frame(spark, rows)
    model = ml.train(train)
    assert model.facts["rows"] == model.facts["fitted_rows"] == 4300
    assert model.weights.where("idf is not null and w[0] = 0").count() == 0
    assert model.weights.where("idf is not null").count() == 4300 * 2 + 2

"""All candidates of the grid in the same passes: against the fits of Spark ML, one by one."""

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from letterlens.operators import classifier as M
from letterlens.operators import logistic


def corpus(spark, n=240):
    rng = np.random.default_rng(5)
    words = [f"w{i:03d}" for i in range(60)]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        p = np.arange(1, 61) ** (-0.8 if label else -0.5)
        rows.append((i, " ".join(rng.choice(words, rng.integers(0, 30), p=p / p.sum())), label))
    return spark.createDataFrame(rows, "doc long, text string, label int")


def test_minimise_reaches_the_least_point_of_each_function():
    scale, target = np.array([[1.0, 10.0], [3.0, 0.5]]), np.array([[1.0, -2.0], [4.0, 7.0]])
    x, passes = logistic.minimise(lambda p: ((scale * (p - target) ** 2).sum(axis=1), 2 * scale * (p - target)), np.zeros((2, 2)), tolerance=1e-14)
    assert np.allclose(x, target, atol=1e-4) and passes < 100


def test_candidates_fitted_together_equal_single_fits_of_spark_ml(spark):
    train = corpus(spark)
    grid = ((0.5, 40), (5.0, 40), (5.0, 200))
    models = M.fit_all(train, grid)
    tf, n, pos = M.counts(train), train.count(), train.where("label = 1").count()
    for (c, size), model in zip(grid, models, strict=True):
        vocab = M.vocabulary(tf, size).collect()
        at = {r.term: i for i, r in enumerate(sorted(vocab, key=lambda r: (-r.corpus_count, r.term)))}
        weights = {}
        for r in M.tfidf(tf, M.vocabulary(tf, size), n).collect():
            weights.setdefault(r.doc, {})[at[r.term]] = r.weight
        rows = [(r.label, n / (2 * (pos if r.label else n - pos)), SparseVector(len(at), weights.get(r.doc, {}))) for r in train.collect()]
        want = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=300, tol=1e-10).fit(
            spark.createDataFrame(rows, ["label", "w", "features"]))
        got = {r.term: r.coefficient for r in model.terms.collect()}
        assert set(got) == set(at) and math.isclose(model.intercept, want.intercept, abs_tol=0.02)
        assert all(abs(got[t] - want.coefficients[i]) < 0.03 * max(1.0, np.abs(want.coefficients.toArray()).max()) for t, i in at.items())


def test_scores_of_all_candidates_equal_the_scores_of_each(spark):
    train = corpus(spark, 80)
    models = M.fit_all(train, ((1.0, 30), (10.0, 90)))
    together = {(r.candidate, r.doc): r.probability for r in M.score_all(train, models).collect()}
    for j, model in enumerate(models):
        alone = {r.doc: r.probability for r in M.score(train, model).collect()}
        assert len(alone) == 80 and all(abs(together[j, d] - p) < 2e-4 for d, p in alone.items())


def test_grid_takes_the_first_of_the_best_and_refits_on_both(spark):
    df = corpus(spark, 120)
    best, tried = M.grid_search(df.where("doc < 80"), df.where("doc >= 80"), ((1.0, 50), (1.0, 50), (5.0, 50)))
    top = max(t["f1"] for t in tried)
    assert tried[0]["f1"] == tried[1]["f1"] and best.c == next(t["c"] for t in tried if t["f1"] == top) and best.n_docs == 120
    again = M.grid_search(df.where("doc < 80"), df.where("doc >= 80"), ((1.0, 50), (1.0, 50), (5.0, 50)))[1]
    assert [t["f1"] for t in again] == [t["f1"] for t in tried]


def test_empty_texts_null_labels_and_no_rows(spark):
    schema = "doc long, text string, label int"
    model = M.fit(spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "a bb cc", None)], schema))
    assert M.score(spark.createDataFrame([(9, None, 0)], schema), model).first().probability is not None
    none = M.fit(spark.createDataFrame([], schema))
    assert none.terms.count() == 0 and M.score(spark.createDataFrame([(9, "x yy", 0)], schema), none).first().probability == 0.5


def test_vectors_are_made_without_python(spark):
    df = corpus(spark, 20).withColumn("w", F.lit(1.0))
    tf = M.counts(df)
    rows = M.vectors(df, tf, M.vocabulary(tf, 10).withColumn("at", F.lit(0)), [5, 10], 20)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

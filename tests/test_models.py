"""Model plumbing: planted signal is learned (AUC above chance), weights and split are exact."""

import random

import pytest
from pyspark.sql import functions as F

from retenta.ml import models, prep


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x = rng.random()
        y = 1 if rng.random() < 0.15 + 0.6 * x else 0
        rows.append((i, x, rng.random(), y))
    return spark.createDataFrame(rows, "customer_unique_id long, x double, noise double, became_repeat_buyer int")


def test_split_is_exact_per_class(frame):
    s = prep.stratified_split(frame, key=prep.lehmer_key("customer_unique_id"))
    c = {(r["became_repeat_buyer"], r["is_test"]): r["n"] for r in
         s.groupBy("became_repeat_buyer", "is_test").agg(F.count("*").alias("n")).collect()}
    want = prep.share_of_test(prep.class_counts(frame))
    for y in (0, 1):
        assert c[(y, True)] == want[y]
    assert sum(want.values()) == 120


def test_logistic_learns_planted_signal(frame):
    counts = prep.class_counts(frame)
    w = prep.balanced_weight(frame, counts)
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(600)
    df = models.assemble(w, ["x", "noise"])
    m = models.logistic_regression(600, max_iter=50).fit(df)
    auc = models.metrics.roc_auc(models.score(m, df)).first()[0]
    # the planted score x itself is the best possible ranking; the model should come close
    ideal = models.metrics.roc_auc(frame.select(F.col("became_repeat_buyer").alias("label"),
                                                F.col("x").alias("score"))).first()[0]
    assert ideal > 0.6 and auc >= ideal - 0.02


def test_best_model_tie_prefers_boosted_trees():
    assert models.best_model({"logistic_regression": 0.6, "boosted_trees": 0.6}) == "boosted_trees"
    assert models.best_model({"logistic_regression": 0.7, "boosted_trees": 0.6}) == "logistic_regression"

import random

import numpy as np
import pytest

from retenta.llm import quality
from retenta.llm.common import table
from .conftest import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, scored):
    marks = dict(rows(table(spark, SF, "labels"), "doc_id", "quality"))
    got = rows(scored, "doc_id", "held_out", "score", "predicted")
    held = [(marks[d], s, p) for d, h, s, p in got if h and d in marks]
    assert len(got) == table(spark, SF, "documents").count() and len(held) > 50
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for _, s, p in held)
    assert np.mean([q == p for q, _, p in held]) >= 0.95
    # clean documents stay
    assert np.mean([p for q, _, p in held if q == 1]) >= 0.97


def test_ftrl_learns_and_unused_weights_stay_zero():
    rng = random.Random(0)
    model = quality.Ftrl(8)
    for _ in range(400):
        y = rng.randint(0, 1)
        at, x = np.array([3 + y, 256]), np.array([1.0, 1.0])
        model.learn(at, x, y)
    w = model.weights()
    assert w[4] > 0.5 > -0.5 > w[3] and np.count_nonzero(w) <= 3


def test_features_are_shares_of_whole_texts():
    at, x = quality.features("a b a b a b")
    assert len(at) == 6 + 5 + 6 + 5 + 4 and x[:6].sum() == pytest.approx(1)
    assert len(quality.features(None)[0]) == len(quality.features(" \n")[0]) == 0


def test_nulls_repeats_conflicts_and_empty_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 0), (4, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert all(0 <= s <= 1 for (s,) in rows(got, "score"))
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.filter("false")).filter("score <> 0.5").count() == 0

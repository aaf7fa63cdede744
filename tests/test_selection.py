"""Values at ranks by narrowing histograms, against sorting."""

import math
import random

import numpy as np
import pytest

from retenta.operators.selection import median_values, values_at_ranks

INF = float("inf")


def brute(rows, ranks):
    out = {}
    for g in {g for g, _ in rows}:
        values = sorted((v for x, v in rows if x == g and v is not None), key=lambda v: (v != v, 0 if v != v else v))
        for k in ranks(g, len(values)):
            if 0 <= k < len(values):
                v = values[k]
                same = [x for x in values if x == v or (x != x and v != v)]
                out[g, k] = (v, next(i for i, x in enumerate(values) if x is same[0]), len(same))
    return out


def every_seventh(_, n):
    return [-1, *range(0, n, 7), n - 1, n]


def equal(a, b):
    return a.keys() == b.keys() and all(
        x[1:] == y[1:] and (x[0] == y[0] or (math.isnan(x[0]) and math.isnan(y[0]))) for x, y in ((a[k], b[k]) for k in a))


def test_whole_numbers(spark):
    rng = random.Random(3)
    near = 2 ** 62
    rows = [("hot", 5)] * 300 + [("hot", rng.randrange(-2 ** 63, 2 ** 63)) for _ in range(200)]
    rows += [("near", near + rng.randrange(50)) for _ in range(200)] + [(None, None), (None, 4), ("none", None)]
    df = spark.createDataFrame(rows, "_g string, _v long").repartition(3)
    for bins in (2, 16, 4096):
        assert equal(values_at_ranks(df, every_seventh if bins > 2 else (lambda g, n: [0, n // 2]), bins=bins),
                     brute(rows, every_seventh if bins > 2 else (lambda g, n: [0, n // 2])))


def test_doubles_of_all_sizes(spark):
    rng = random.Random(4)
    odd = [INF, -INF, float("nan"), 0.0, 5e-324, 1e-320, 1.7e308, -1.7e308, 1.0, 1.0 + 2 ** -52, None]
    rows = [(0, v) for v in odd * 3] + [(1, rng.lognormvariate(0, 40)) for _ in range(150)]
    df = spark.createDataFrame(rows, "_g int, _v double").repartition(3)
    assert equal(values_at_ranks(df, every_seventh, bins=8), brute(rows, every_seventh))


def test_hot_value_takes_few_passes(spark):
    df = spark.range(60_000).selectExpr("0 as _g", "case when id % 3 = 0 then 7 else id * id end as _v")
    values = sorted(7 if i % 3 == 0 else i * i for i in range(60_000))
    got = values_at_ranks(df, lambda _, n: [n // 5, n // 2], bins=64)
    assert {k: v[0] for k, v in got.items()} == {(0, k): values[k] for k in (12_000, 30_000)}


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None, 2), (4.0, None, 2), (3.0, None, 9), (10.0, None, None)], "a double, b double, c int")
    assert median_values(df, ["a", "b", "c"]) == {"a": float(np.median([1, 3, 4, 10])), "b": None, "c": 2.0}
    assert median_values(df.limit(0), ["a"]) == {"a": None}


def test_too_many_levels_are_an_error(spark):
    from retenta.ml.prep import category_levels
    df = spark.range(20).selectExpr("cast(id as string) as s")
    assert len(category_levels(df, ["s"], most=20)["s"]) == 20
    with pytest.raises(ValueError):
        category_levels(df, ["s"], most=19)

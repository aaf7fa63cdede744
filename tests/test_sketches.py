"""Stored monthly sketches: errors within their bounds, merges like one pass, months replaced alone, edge rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from retenta.operators import sketches as sk

BIG = 40_000


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    rows = []
    for i in range(BIG):
        month = 202401 if rng.random() < 0.7 else rng.choice([202402, 202403, None])     # a hot month
        value = None if rng.random() < 0.05 else rng.choice([1.0, rng.random() * 100])    # a hot value
        item = None if rng.random() < 0.02 else f"c{int(rng.paretovariate(0.7))}"
        rows.append((month, value, item, f"p{rng.randrange(15_000)}"))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "m int, v double, `it.em` string, who string").repartition(6)


def built(df, **kw):
    return sk.monthly(df, F.col("m"), values=["v"], items=["it.em"], ids=["who"], **kw)


def rank_off(values, guess, share):
    """How far the ranks that ``guess`` covers among ``values`` are from ``share``."""
    low, high = sum(v < guess for v in values) / len(values), sum(v <= guess for v in values) / len(values)
    return max(0.0, low - share, share - high)


def test_errors_are_within_the_bounds(spark, frame, data, tmp_path):
    sk.save(built(frame, tracked=500), str(tmp_path / "s"))
    kept = sk.read(spark, str(tmp_path / "s"))
    assert {r[sk.MONTH]: r[sk.N_ROWS] for r in kept.collect()} == collections.Counter(r[0] for r in data)
    one = sk.merged(kept)
    shares = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = one.select(sk.N_ROWS, sk.distinct("who").alias("d"), *[sk.quantile("v", s).alias(f"q{i}") for i, s in enumerate(shares)]).first()
    values = [r[1] for r in data if r[1] is not None]
    assert got[sk.N_ROWS] == BIG
    assert all(rank_off(values, got[f"q{i}"], s) <= 2 * sk.rank_error() for i, s in enumerate(shares))
    true = len({r[3] for r in data})
    assert abs(got["d"] - true) <= 6 * sk.distinct_error() * true
    counts = collections.Counter(r[2] for r in data if r[2] is not None)
    assert len(counts) > 500                                          # more than the sketch tracks
    off = sk.count_error(sum(counts.values()), 500)
    found = {r["it.em"]: r["count"] for r in sk.heavy_hitters(one, "it.em", 20).collect()}
    assert all(abs(counts[i] - n) <= off for i, n in found.items())
    least = min(found.values())
    assert all(i in found for i, n in counts.items() if n > least + off)


def test_few_items_are_counted_exactly(spark, frame, data):
    counts = collections.Counter(r[2] for r in data if r[2] is not None)
    one = sk.merged(built(frame))
    assert {r["it.em"]: r["count"] for r in sk.heavy_hitters(one, "it.em", sk.ITEMS).collect()} == counts


def test_keys_and_ranges(spark, frame, data, tmp_path):
    path = str(tmp_path / "s")
    sk.save(built(frame), path)
    part = sk.read(spark, path, since=202402, until=202402)
    assert all(f"{sk.MONTH}=202402/" in f for f in part.inputFiles()) or "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()
    assert [(r[sk.MONTH], r[sk.N_ROWS]) for r in part.collect()] == [(202402, sum(r[0] == 202402 for r in data))]
    years = sk.merged(sk.read(spark, path), (F.col(sk.MONTH) / 100).cast("int").alias("year"))
    assert {(r["year"], r[sk.N_ROWS]) for r in years.collect()} == {
        (2024, sum(r[0] is not None for r in data)), (None, sum(r[0] is None for r in data))}
    per = sk.heavy_hitters(years, "it.em", 1, "year").collect()
    assert {r["year"] for r in per} == {2024, None}


def test_a_month_is_replaced_alone(spark, frame, data, tmp_path):
    path = str(tmp_path / "s")
    sk.save(built(frame), path)
    sk.save(built(frame.filter("m = 202403").limit(10)), path)
    got = {r[sk.MONTH]: r[sk.N_ROWS] for r in sk.read(spark, path).collect()}
    want = collections.Counter(r[0] for r in data)
    assert got == {**want, 202403: 10}


def test_nulls_and_empty(spark):
    schema = "m int, v double, `it.em` string, who string"
    nulls = spark.createDataFrame([(202401, None, None, None)] * 3, schema)
    one = sk.merged(built(nulls))
    row = one.select(sk.N_ROWS, sk.quantile("v", 0.5).alias("q"), sk.distinct("who").alias("d")).first()
    assert tuple(row) == (3, None, 0)
    assert sk.heavy_hitters(one, "it.em", 5).count() == 0
    assert built(spark.createDataFrame([], schema)).count() == 0
    nan = spark.createDataFrame([(202401, float("nan"), "a", "p"), (202401, 2.0, "a", "p")], schema)
    assert sk.merged(built(nan)).select(sk.quantile("v", 0.5)).first()[0] == 2.0

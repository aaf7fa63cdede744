"""Exact rounding, calendar helpers and the distributed order statistics vs brute force."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from retenta.functions.dates import fractional_days, months_apart, weekday_monday0
from retenta.functions.exprs import money_avg, pct
from pyspark.sql import functions as F

from retenta.ml.prep import category_levels, one_hot, stratified_split
from retenta.ml.prep import share_of_test
from retenta.operators.aggregates import null_counts
from retenta.operators.order_stats import exact_medians, kth_smallest
from retenta.sources.jdbc import as_relation
from retenta.operators.prefix import cumulative_sums


def test_pct_rounds_half_away_from_zero_exactly(spark):
    pairs = [(1, 8), (1, 800), (5, 40000), (1, 3), (2, 3), (0, 7), (7, 0), (2887, 94983), (1, 200000)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(pct("a", "b")).collect()]
    for (a, b), g in zip(pairs, got):
        if b == 0:
            assert g is None
        else:
            want = (Decimal(100 * a) / Decimal(b)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert g == float(want), (a, b, g, want)


def test_money_avg_exact(spark):
    df = spark.createDataFrame([(Decimal("1.01"), 2), (Decimal("2.01"), 2), (Decimal("0.03"), 2)],
                               "s decimal(21,2), n long")
    assert [r[0] for r in df.select(money_avg("s", "n")).collect()] == [0.51, 1.01, 0.02]


def test_calendar_helpers(spark):
    T = dt.datetime
    df = spark.createDataFrame([(T(2017, 12, 31, 23), T(2018, 1, 1, 0))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(months_apart("b", "a").alias("m"), fractional_days("b", "a").alias("d"),
                  weekday_monday0("a").alias("w")).first()
    assert r["m"] == 1 and r["d"] == pytest.approx(1 / 24) and r["w"] == 6  # Sunday


@pytest.mark.parametrize("parts", [1, 13])
def test_kth_smallest_matches_sort(spark, parts):
    rng = random.Random(7)
    vals = [rng.choice([rng.random() * 100, 42.0, -3.5, 1e6]) for _ in range(3000)]
    groups = [i % 3 for i in range(3000)]
    df = spark.createDataFrame(list(zip(groups, vals)), "g int, v double")
    ks = spark.createDataFrame([(g, k) for g in range(3) for k in (0, 17, 999, 1000, -1)], "g int, k long")
    got = {(r["g"], r["k"]): r["v"] for r in kth_smallest(df, "v", ks, "g", parts=parts).collect()}
    assert len(got) == 9  # ranks out of range give no row
    for g in range(3):
        s = sorted(v for gg, v in zip(groups, vals) if gg == g)
        for k in (0, 17, 999):
            assert got[(g, k)] == s[k]


def test_exact_median_interpolates_like_pandas(spark):
    vals = [3.0, 1.0, None, 10.0, 4.0]
    df = spark.createDataFrame([(v, None) for v in vals], "v double, none double")
    assert exact_medians(df, ["v", "none"], parts=3) == {"v": float(np.median([1, 3, 4, 10])), "none": None}


def test_many_rows_and_many_partitions(spark):
    """One path for every size: over a million rows, and ranges by the thousand."""
    df = spark.range(1_200_001).select((F.col("id") * 7919 % 1_200_001).cast("double").alias("v"))
    assert exact_medians(df, ["v"])["v"] == 600_000.0
    few = spark.range(100).select(F.col("id").cast("double").alias("s"), F.lit(1).cast("long").alias("x"))
    got = {r["s"]: r["cum_x"] for r in cumulative_sums(few, "s", ["x"], descending=False, parts=5000).collect()}
    assert got == {float(i): i + 1 for i in range(100)}


def test_split_shares_the_total_and_breaks_ties(spark):
    assert share_of_test({0: 6, 1: 6}, 0.2) == {0: 1, 1: 2}
    rows = [(i, i % 2, 5) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, y int, same long")
    got = stratified_split(df, "y", "id", 0.2, key=F.col("same"))
    assert sorted(r["id"] for r in got.filter("is_test").collect()) == [0, 1, 3]


def test_one_hot_null_is_no_level(spark):
    df = spark.createDataFrame([("AC",), (None,), ("SP",)], "s string")
    levels = category_levels(df, ["s"])
    assert levels == {"s": ["AC", "SP"]}
    assert [tuple(r) for r in one_hot(df, levels).collect()] == [(0,), (0,), (1,)]


def test_null_counts_of_odd_names(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "x long, y long").toDF("it's", "a`b.c")
    assert {r[0]: r[1] for r in null_counts(df).collect()} == {"it's": 1, "a`b.c": 2}


def test_query_text_becomes_a_relation():
    assert as_relation("orders") == "orders"
    assert as_relation("-- note\nWITH a AS (SELECT 1) SELECT * FROM a;").startswith("(-- note\nWITH")
    assert as_relation("select 1 ;") == "(select 1\n) q"


def test_cumulative_sums_across_ranges(spark):
    rng = random.Random(3)
    rows = [(float(i), rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, x long")
    out = {r["s"]: (r["cum_x"], r["total_x"]) for r in cumulative_sums(df, "s", ["x"], parts=7).collect()}
    run = 0
    total = sum(x for _, x in rows)
    for s, x in sorted(rows, reverse=True):
        run += x
        assert out[s] == (run, total)


def test_exact_medians_several_columns(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), float(rng.randint(1, 5)) if rng.random() < 0.9 else None, rng.expovariate(1.0))
            for _ in range(2001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_medians(df, ["a", "b", "c"], parts=5)
    for i, c in enumerate("abc"):
        vals = [r[i] for r in rows if r[i] is not None]
        assert got[c] == float(np.median(vals))

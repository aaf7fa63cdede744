"""Cohort activity from month bitsets: as from distinct months, merged from batches, one shuffle less."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retenta.operators import base, cohorts
from tests.edge_tables import edge_tables

SCHEMA = "customer_unique_id string, order_purchase_timestamp timestamp_ntz"


def orders(spark, first=1990, last=2009):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 60)}", dt.datetime(rng.randint(first, last), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23)))
            for _ in range(400)]
    rows += [("p1", None), ("never dated", None), (None, dt.datetime(2000, 1, 1)), (None, None), ("p2", dt.datetime(1999, 12, 31, 23, 59, 59)),
             ("p2", dt.datetime(2000, 1, 1))] + [("hot", dt.datetime(2001, 2, 3))] * 200
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rows(df):
    return sorted(map(tuple, df.select("cohort_month", "month_number", "active_customers", "cohort_size").collect()), key=str)


def test_equals_distinct_months(spark):
    for po in (orders(spark), orders(spark, 1, 12), base.person_orders(edge_tables(spark))):
        assert rows(cohorts.cohort_activity(po)) == rows(cohorts.cohort_activity_by_months(po))
    assert cohorts.cohort_activity(orders(spark)).dtypes == cohorts.cohort_activity_by_months(orders(spark)).dtypes


def test_batches_merge_whatever_their_calendars(spark):
    po = orders(spark)
    parts = [po.filter("order_purchase_timestamp < '1997-05-05'"), po.filter("order_purchase_timestamp >= '1997-05-05'"),
             po.filter("order_purchase_timestamp is null")]
    words = [cohorts.calendar(p) or (0, 0) for p in parts]
    state = cohorts.merged(*[cohorts.month_bits(p, w) for p, w in zip(parts, words)])
    assert rows(cohorts.activity_of(state)) == rows(cohorts.cohort_activity(po))


def test_very_wide_calendars_and_no_orders(spark):
    po = orders(spark).unionByName(spark.createDataFrame([("p3", dt.datetime(9999, 1, 1))], SCHEMA))
    assert rows(cohorts.cohort_activity(po)) == rows(cohorts.cohort_activity_by_months(po))
    assert rows(cohorts.cohort_activity(po.limit(0))) == []
    assert cohorts.calendar(po.filter(F.col("order_purchase_timestamp").isNull())) is None


def test_one_shuffle_less(spark):
    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    po = orders(spark)
    assert shuffles(cohorts.cohort_activity(po)) < shuffles(cohorts.cohort_activity_by_months(po))

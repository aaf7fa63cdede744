"""X1 kept up to date: batches in any order give what one build gives; untouched persons aren't built again."""

import dataclasses

from pyspark.sql import functions as F

from retenta.operators import base
from retenta.plans import features, incremental
from retenta.plans.features import first_order_features
from retenta.sources.tables import Tables
from tests.edge_tables import edge_tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def empty(t):
    return Tables(**{n: df.limit(0) for n, df in t.as_dict().items()})


def test_three_batches_equal_one_build(spark):
    t = edge_tables(spark)
    a = dataclasses.replace(empty(t), orders=t.orders.filter("order_id in ('o3', 'o5', 'o8')"), customers=t.customers.filter("customer_id <> 'c7'"),
                            products=t.products, category_translation=t.category_translation, sellers=t.sellers,
                            order_items=t.order_items.filter("order_item_id = 2"))
    # earlier orders that arrive late, first items, and a payment for an order that is known
    b = dataclasses.replace(empty(t), orders=t.orders.filter("order_id not in ('o3', 'o5', 'o8', 'o10')"),
                            order_items=t.order_items.filter("order_item_id = 1"), order_payments=t.order_payments)
    # an order that waited for its customer, and reviews
    c = dataclasses.replace(empty(t), orders=t.orders.filter("order_id = 'o10'"), customers=t.customers.filter("customer_id = 'c7'"),
                            order_reviews=t.order_reviews)
    kept = incremental.update(incremental.update(incremental.start(a), b), c)
    assert rows(kept.features) == rows(first_order_features(t))
    assert kept.features.dtypes == first_order_features(t).dtypes


def test_untouched_rows_are_carried_over(spark):
    t = edge_tables(spark)
    kept = incremental.start(t)
    marked = dataclasses.replace(kept, features=kept.features.withColumn("customer_state", F.lit("carried")))
    batch = dataclasses.replace(empty(t), order_reviews=t.order_reviews.filter("review_id = 'r3'").withColumn("order_id", F.lit("o7")))
    after = incremental.update(marked, batch).features
    touched = {r[0] for r in after.filter("customer_state <> 'carried'").select("customer_unique_id").collect()}
    assert touched == {"D"}                                         # o7 is the first order of person D
    assert after.filter("customer_unique_id = 'D'").first()["review_score"] == 2
    assert rows(incremental.update(marked, empty(t)).features) == rows(marked.features)


def test_only_facts_of_first_orders_are_aggregated(spark):
    """Each fact table is cut to the first orders, and shuffled once as plain rows, before it is aggregated."""
    t = edge_tables(spark)
    fo = base.first_order_per_person(base.person_orders(t), payload=incremental.PAYLOAD)
    fo = spark.createDataFrame(fo.collect(), fo.schema)
    plan = features.features_of_first_orders(t, fo)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 3
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i in (i for i, line in enumerate(lines) if "Aggregate [order_id" in line):
        under = [lines[j] for j in range(i + 1, len(lines)) if all(d > depth[i] for d in depth[i + 1:j + 1])]
        assert any("Join LeftSemi" in line for line in under)

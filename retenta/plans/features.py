"""First-order feature table (X1) and its profile."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fractional_days
from ..functions.exprs import money
from ..operators import base
from ..operators.aggregates import mode_smallest, null_counts, shape, value_counts
from ..session import materialize
from ..sources.tables import Tables

PERSON = base.PERSON
FEATURE_COLUMNS = [
    "customer_unique_id", "order_id", "customer_state", "order_purchase_timestamp",
    "delivery_days", "days_early_vs_estimate", "product_category", "order_value",
    "num_items", "payment_type", "payment_installments", "review_score",
    "became_repeat_buyer",
]
FACT_COLUMNS = {"order_items": ["product_id", "price", "freight_value"], "order_payments": ["payment_type", "payment_installments"],
                "order_reviews": ["review_score"]}


def first_order_features(t: Tables, method: str = "aggregate") -> DataFrame:
    """One row per person from their first valid order, plus the repeat label.

    The first orders are written once: the spine and the three fact tables
    (items, payments, reviews) are cut to them by reading their ids, not by
    finding them again.
    """
    fo = materialize(base.first_order_per_person(
        base.person_orders(t),
        payload=["customer_state", "order_delivered_customer_date", "order_estimated_delivery_date"],
        method=method))
    return features_of_first_orders(t, fo)


def features_of_first_orders(t: Tables, fo: DataFrame) -> DataFrame:
    """X1 for given first orders (person, order_id, time, payload, total_orders).

    ``fo`` is read four times: write it first where it is costly. Only the facts of these orders get a category
    and are aggregated: each fact table's narrow rows are shuffled once on order_id, as plain rows (an order's
    lines may lie anywhere, so that aggregating before the shuffle would only add to it), and their aggregate
    and the join to the spine run without further exchanges. A hash table of order ids holds a partition's ids alone.
    """
    ids = fo.select("order_id").hint("shuffle_hash")
    only = {n: getattr(t, n).select("order_id", *columns).join(ids, "order_id", "left_semi") for n, columns in FACT_COLUMNS.items()}
    t = replace(t, **only)
    # built-in mode (a small value->count map per order); measured
    # faster here than the two-level ``grouped_mode``, which needs two more exchanges
    items = base.categorised_items(t).groupBy("order_id").agg(
        mode_smallest("category").alias("product_category"),
        F.sum(F.col("price") + F.col("freight_value")).alias("order_value"),
        F.count(F.lit(1)).alias("num_items"))
    pay = t.order_payments.groupBy("order_id").agg(
        mode_smallest("payment_type").alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"))
    rev = t.order_reviews.groupBy("order_id").agg(F.max("review_score").alias("review_score"))
    j = (fo.join(items, "order_id", "left")
           .join(pay, "order_id", "left")
           .join(rev, "order_id", "left"))
    return j.select(
        PERSON, "order_id", "customer_state", base.TS,
        fractional_days("order_delivered_customer_date", base.TS).alias("delivery_days"),
        fractional_days("order_estimated_delivery_date", "order_delivered_customer_date")
          .alias("days_early_vs_estimate"),
        "product_category",
        money("order_value").alias("order_value"),
        "num_items", "payment_type", "payment_installments", "review_score",
        (F.col("total_orders") > 1).cast("int").alias("became_repeat_buyer"))


def feature_profile(features: DataFrame) -> dict[str, DataFrame]:
    """Shape, normalised class balance (4 dp), nulls per column and the first 5 rows by person (no person last)."""
    return {
        "shape": shape(features),
        "class_balance": value_counts(features, "became_repeat_buyer", normalize=True, digits=4),
        "null_counts": null_counts(features),
        "preview": features.orderBy(F.col(PERSON).asc_nulls_last()).limit(5),
    }

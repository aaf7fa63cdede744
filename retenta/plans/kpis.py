"""KPI queries Q1-Q4 (the reference's KPI SQL file), as lazy DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, money_avg, pct, ratio_round
from ..operators import base
from ..operators.cohorts import calendar, cohort_activity
from ..params import EXCLUDED_STATUSES, LOW_REVIEW_MAX, Q4_MIN_ORDERS, Q4_TOP_K
from ..sources import statements
from ..sources.tables import Tables

PERSON = base.PERSON


def repeat_purchase_rate(t: Tables) -> DataFrame:
    """Q1: persons with valid orders, persons with more than one, and the rate."""
    per_person = (base.person_orders(t)
                  .groupBy(PERSON)
                  .agg(F.count_distinct("order_id").alias("order_count")))
    return per_person.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_where(F.col("order_count") > 1).alias("repeat_customers"),
    ).select("total_customers", "repeat_customers",
             pct("repeat_customers", "total_customers").alias("repeat_purchase_rate_pct"))


def cohort_retention(t: Tables) -> DataFrame:
    """Q2: monthly cohort retention matrix.

    cohort_month (TIMESTAMP_NTZ), month_number, active_customers, cohort_size,
    retention_pct; months where nobody of the cohort ordered are absent.
    """
    act = cohort_activity(base.person_orders(t), calendar(t.orders))
    return (act.select(
                "cohort_month", "month_number", "active_customers", "cohort_size",
                pct("active_customers", "cohort_size").alias("retention_pct"))
            .orderBy("cohort_month", "month_number"))


def person_revenue(t: Tables, with_state: bool = False) -> DataFrame:
    """Per person over valid orders that have items: distinct orders and item revenue.

    Items are pre-aggregated to order grain, then joined (inner: orders without
    items drop out, as with the reference's inner items join), then grouped by
    person. Equal to COUNT(DISTINCT order_id) / SUM(price + freight) over the
    item-grain join because order_id is the orders key.
    """
    po = base.person_orders(t)
    joined = po.join(base.order_item_totals(t.order_items), "order_id")
    aggs = [F.count_distinct("order_id").alias("order_count"),
            F.sum("order_value").alias("total_revenue")]
    if with_state:
        aggs.append(F.max("customer_state").alias("state"))
    return joined.groupBy(PERSON).agg(*aggs)


def customer_lifetime_value(t: Tables) -> DataFrame:
    """Q3: average revenue per person overall, for one-time and for repeat buyers."""
    pr = person_revenue(t)
    one = F.col("order_count") == 1
    rep = F.col("order_count") > 1
    agg = pr.agg(
        F.sum("total_revenue").alias("s_all"), F.count("total_revenue").alias("n_all"),
        F.sum(F.when(one, F.col("total_revenue"))).alias("s_one"),
        F.count(F.when(one, F.col("total_revenue"))).alias("n_one"),
        F.sum(F.when(rep, F.col("total_revenue"))).alias("s_rep"),
        F.count(F.when(rep, F.col("total_revenue"))).alias("n_rep"))
    return agg.select(money_avg("s_all", "n_all").alias("avg_clv_all"),
                      money_avg("s_one", "n_one").alias("avg_clv_one_time_buyers"),
                      money_avg("s_rep", "n_rep").alias("avg_clv_repeat_buyers"))


def category_dissatisfaction(t: Tables, min_orders: int = Q4_MIN_ORDERS,
                             top_k: int = Q4_TOP_K, low_max: int = LOW_REVIEW_MAX) -> DataFrame:
    """Q4: per category, distinct orders, mean review score and % low reviews; top-k by % low.

    The reference joins items to reviews without pre-aggregation, so a review
    is counted once per item of its order and every item once per review:
    review statistics are item-weighted. We reproduce that exactly without
    materialising the item × review product: items are reduced to
    (order, category) counts, reviews to per-order sums, and the weights are
    multiplied after a single order_id join.
    """
    # inner join to products in Q4 (not left): items whose product is unknown drop out
    items = base.categorised_items(t).filter("known_product")
    oc = items.groupBy("order_id", "category").agg(F.count(F.lit(1)).alias("n_items"))
    valid = base.valid_orders(t.orders).select("order_id")
    rv = t.order_reviews.groupBy("order_id").agg(
        F.count("review_score").alias("r_n"),
        F.sum("review_score").alias("r_sum"),
        count_where(F.col("review_score") <= low_max).alias("r_low"),
        F.count(F.lit(1)).alias("r_rows"))
    j = oc.join(valid, "order_id").join(rv, "order_id", "left")
    w = F.col("n_items")
    g = j.groupBy("category").agg(
        F.count_distinct("order_id").alias("num_orders"),
        F.sum(w * F.coalesce("r_n", F.lit(0))).alias("n_scores"),
        F.sum(w * F.coalesce("r_sum", F.lit(0))).alias("sum_scores"),
        F.sum(w * F.coalesce("r_low", F.lit(0))).alias("n_low"))
    out = (g.filter(F.col("num_orders") > min_orders)
            .select("category", "num_orders",
                    ratio_round("sum_scores", "n_scores", 2).alias("avg_review_score"),
                    pct("n_low", "n_scores").alias("pct_low_reviews")))
    return out.orderBy(F.col("pct_low_reviews").desc_nulls_first(),
                       F.col("category").asc_nulls_last()).limit(top_k)


def from_text(t: Tables, min_orders: int = Q4_MIN_ORDERS, top_k: int = Q4_TOP_K, low_max: int = LOW_REVIEW_MAX) -> dict[str, DataFrame]:
    """Q1-Q4 as the query texts of ``sql/kpis.sql`` state them, with the parameters bound."""
    text = (Path(__file__).parent / "sql" / "kpis.sql").read_text()
    return statements.run(t, text, {"excluded": list(EXCLUDED_STATUSES), "min_orders": min_orders, "top_k": top_k, "low_score": low_max})

"""Dashboard aggregates D1-D7 (one table per visual)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import minus_days, year_month_text
from ..functions.exprs import count_where, money, money_avg, pct
from ..operators import base
from ..operators.aggregates import mode_smallest
from ..operators.cohorts import calendar, cohort_activity
from ..params import D3_MIN_CUSTOMERS, D4_COHORT_CUTOFF, D6_JUST_ON_TIME_DAYS
from ..sources.tables import Tables
from .kpis import person_revenue

PERSON = base.PERSON


def kpi_summary(t: Tables) -> DataFrame:
    """KPI card on the items-joined population (persons with at least one itemised order)."""
    pr = person_revenue(t)
    one = F.col("order_count") == 1
    rep = F.col("order_count") > 1
    a = pr.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_where(rep).alias("repeat_customers"),
        F.sum(F.when(one, F.col("total_revenue"))).alias("s_one"),
        F.count(F.when(one, F.col("total_revenue"))).alias("n_one"),
        F.sum(F.when(rep, F.col("total_revenue"))).alias("s_rep"),
        F.count(F.when(rep, F.col("total_revenue"))).alias("n_rep"))
    return a.select("total_customers", "repeat_customers",
                    pct("repeat_customers", "total_customers").alias("repeat_rate_pct"),
                    money_avg("s_one", "n_one").alias("avg_clv_one_time"),
                    money_avg("s_rep", "n_rep").alias("avg_clv_repeat"))


def repeat_rate_by_state(t: Tables) -> DataFrame:
    """Persons, repeat rate and mean revenue per (lexicographically largest) state."""
    pr = person_revenue(t, with_state=True)
    g = pr.groupBy("state").agg(
        F.count(F.lit(1)).alias("customers"),
        count_where(F.col("order_count") > 1).alias("n_rep"),
        F.sum("total_revenue").alias("s_rev"),
        F.count("total_revenue").alias("n_rev"))
    return (g.select("state", "customers",
                     pct("n_rep", "customers").alias("repeat_rate_pct"),
                     money_avg("s_rev", "n_rev").alias("avg_customer_revenue"))
             .orderBy(F.col("customers").desc(), F.col("state").asc_nulls_last()))


def first_order_category(t: Tables, method: str = "aggregate") -> DataFrame:
    """Per person: total valid orders and the modal category of the first order's items.

    Persons whose first order has no items are absent (inner items join); the
    category is NULL when every item of that order lacks a translated category.
    """
    fo = base.first_order_per_person(base.person_orders(t), method=method)
    modes = (base.categorised_items(t).groupBy("order_id")
             .agg(mode_smallest("category").alias("category")))
    return fo.join(modes, "order_id").select(PERSON, "total_orders", "category")


def repeat_rate_by_category(t: Tables, min_customers: int = D3_MIN_CUSTOMERS,
                            method: str = "aggregate") -> DataFrame:
    """D3: repeat rate of persons by the category of their first order (HAVING count >= min)."""
    fc = first_order_category(t, method).filter(F.col("category").isNotNull())
    g = fc.groupBy("category").agg(
        F.count(F.lit(1)).alias("first_time_customers"),
        count_where(F.col("total_orders") > 1).alias("n_rep"))
    return (g.filter(F.col("first_time_customers") >= min_customers)
             .select("category", "first_time_customers",
                     pct("n_rep", "first_time_customers").alias("repeat_rate_pct"))
             .orderBy(F.col("repeat_rate_pct").desc_nulls_first(), "category"))


def cohort_heatmap(t: Tables, cutoff: str = D4_COHORT_CUTOFF) -> DataFrame:
    """Cohort retention from ``cutoff`` on, month as 'YYYY-MM' text and INT month number."""
    act = cohort_activity(base.person_orders(t), calendar(t.orders))
    act = act.filter(F.col("cohort_month") >= F.lit(cutoff).cast("timestamp_ntz"))
    return (act.select(year_month_text("cohort_month").alias("cohort_month"),
                       F.col("month_number").cast("int").alias("month_number"),
                       "active_customers", "cohort_size",
                       pct("active_customers", "cohort_size").alias("retention_pct"))
               .orderBy("cohort_month", "month_number"))


def monthly_trend(t: Tables) -> DataFrame:
    """Valid orders with items and their item revenue per calendar month."""
    o = base.valid_orders(t.orders).select("order_id", base.TS)
    j = o.join(base.order_item_totals(t.order_items), "order_id")
    return (j.groupBy(year_month_text(base.TS).alias("month"))
             .agg(F.count_distinct("order_id").alias("orders"),
                  money(F.sum("order_value")).alias("revenue"))
             .orderBy(F.col("month").asc_nulls_last()))


def delivery_bucket(delivered, estimated, days: int = D6_JUST_ON_TIME_DAYS):
    """Ordered CASE of D6: NULL delivery, late, within ``days`` of the estimate, else early."""
    d, e = F.col(delivered), F.col(estimated)
    return (F.when(d.isNull(), "1. Never delivered")
             .when(d > e, "2. Delivered late")
             .when(d > minus_days(e, days), "3. Just on time")
             .otherwise("4. Early"))


def delivery_vs_repeat(t: Tables, method: str = "aggregate") -> DataFrame:
    """Persons by first-order delivery experience, with their repeat rate."""
    fo = base.first_order_per_person(
        base.person_orders(t),
        payload=["order_delivered_customer_date", "order_estimated_delivery_date"],
        method=method)
    b = fo.select(delivery_bucket("order_delivered_customer_date",
                                  "order_estimated_delivery_date").alias("first_delivery_experience"),
                  "total_orders")
    return (b.groupBy("first_delivery_experience")
             .agg(F.count(F.lit(1)).alias("customers"),
                  count_where(F.col("total_orders") > 1).alias("n_rep"))
             .select("first_delivery_experience", "customers",
                     pct("n_rep", "customers").alias("repeat_rate_pct"))
             .orderBy("first_delivery_experience"))

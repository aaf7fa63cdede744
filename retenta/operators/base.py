"""Shared relations every analysis is built from.

Identity rule: ``customer_id`` is per order, ``customer_unique_id`` is the
person; every repeat/retention statistic groups by the person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import EXCLUDED_STATUSES
from ..sources.tables import Tables

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


def valid_orders(orders: DataFrame, excluded=EXCLUDED_STATUSES) -> DataFrame:
    """status NOT IN (...) (P5). A NULL status is dropped too, as with SQL NOT IN."""
    return orders.filter(~F.col("order_status").isin(*excluded))


def person_orders(t: Tables, excluded=EXCLUDED_STATUSES) -> DataFrame:
    """Valid orders joined to their per-order customer row.

    One row per valid order with the person key and the order's timestamps.
    Both sides have order grain; the join is a shuffle join on customer_id
    (AQE picks sort-merge or shuffled-hash from runtime sizes).
    """
    if t.shared_person_orders is not None and tuple(excluded) == tuple(EXCLUDED_STATUSES):
        return t.shared_person_orders
    o = valid_orders(t.orders, excluded).select(
        "order_id", "customer_id", TS, "order_delivered_customer_date",
        "order_estimated_delivery_date")
    c = t.customers.select("customer_id", PERSON, "customer_state")
    return o.join(c, "customer_id").drop("customer_id")


def order_item_totals(items: DataFrame) -> DataFrame:
    """One row per order: SUM(price + freight_value) and COUNT(*) of its items (A4, A1).

    Pre-aggregating items to order grain before any join keeps fan-out out of
    the later joins; the partial aggregate runs map-side.
    """
    return items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("order_value"),
        F.count(F.lit(1)).alias("num_items"))


def first_order_per_person(po: DataFrame, payload=(), method: str = "aggregate") -> DataFrame:
    """First valid order of each person plus the person's valid-order count (W1+W2+W3).

    Order is purchase time ascending with NULL last (PostgreSQL's ASC order),
    ties broken by order_id so the pick is deterministic.

    ``aggregate`` (default): one ``groupBy(person)`` taking the minimum of
    struct(ts IS NULL, ts, order_id, payload...) and COUNT(*). Partial
    aggregation runs map-side, so a person owning a third of all orders costs
    one buffered row per map task rather than one giant sort in a single task.

    ``window``: ROW_NUMBER / COUNT(*) OVER (PARTITION BY person), the literal
    form; it sorts every order of a person inside one task.
    """
    payload = [p for p in payload if p not in (TS, "order_id")]
    if method == "window":
        w = Window.partitionBy(PERSON)
        ranked = po.select(
            PERSON, "order_id", TS, *payload,
            F.row_number().over(w.orderBy(F.col(TS).asc_nulls_last(), F.col("order_id")))
             .alias("order_rank"),
            F.count(F.lit(1)).over(w).alias("total_orders"))
        return ranked.filter("order_rank = 1").drop("order_rank")
    key = F.struct(F.col(TS).isNull().alias("_ts_null"), F.col(TS).alias(TS),
                   F.col("order_id").alias("order_id"), *[F.col(p) for p in payload])
    agg = po.groupBy(PERSON).agg(F.min(key).alias("_first"),
                                 F.count(F.lit(1)).alias("total_orders"))
    return agg.select(PERSON, F.col("_first.order_id").alias("order_id"),
                      F.col(f"_first.{TS}").alias(TS),
                      *[F.col(f"_first.{p}").alias(p) for p in payload], "total_orders")


def rank_orders_within_person(po: DataFrame, method: str = "ranges",
                              parts: int | None = None) -> DataFrame:
    """Every valid order with its rank inside its person and the person's order count.

    ``window``: ROW_NUMBER / COUNT(*) OVER (PARTITION BY person) — every order of
    a person is sorted inside one task.

    ``ranges`` (default, skew-safe): the orders are range-partitioned on
    (person, ts IS NULL, ts, order_id), so a person owning a third of all orders
    spans several ranges, and written once (deterministic range ids). Ranks are
    computed inside each (range, person), then shifted by the counts of the
    same person in earlier ranges. That offsets table has one row per
    (range, person) and per person at most ``parts`` rows. The person's total
    is the sum of those counts.
    """
    if method == "window":
        w = Window.partitionBy(PERSON)
        return po.select(
            PERSON, "order_id", TS,
            F.row_number().over(w.orderBy(F.col(TS).asc_nulls_last(), F.col("order_id")))
             .alias("order_rank"),
            F.count(F.lit(1)).over(w).alias("total_orders"))
    from ..session import materialize
    spark = po.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tnull = F.col(TS).isNull().alias("_tnull")
    r = (po.select(PERSON, "order_id", TS, tnull)
           .repartitionByRange(parts, PERSON, "_tnull", TS, "order_id")
           .withColumn("_range", F.spark_partition_id()))
    r = materialize(r)
    order = [F.col("_tnull"), F.col(TS), F.col("order_id")]
    local = r.withColumn("_local", F.row_number().over(
        Window.partitionBy("_range", PERSON).orderBy(*order)))
    counts = r.groupBy("_range", PERSON).agg(F.count(F.lit(1)).alias("_n"))
    wp = Window.partitionBy(PERSON)
    offs = counts.select(
        F.col("_range").alias("_r"), F.col(PERSON).alias("_p"),
        F.coalesce(F.sum("_n").over(wp.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_n").over(wp).alias("total_orders"))
    return (local.join(offs, (F.col("_range") == F.col("_r")) & F.col(PERSON).eqNullSafe(F.col("_p")))
                 .select(PERSON, "order_id", TS,
                         (F.col("_local") + F.col("_off")).cast("int").alias("order_rank"),
                         "total_orders"))


def categorised_items(t: Tables) -> DataFrame:
    """order_items ⟕ products ⟕ category_translation → (order_id, category, price, freight).

    Products ⟕ translation is joined first so the item-grain join probes one
    relation. The planner and AQE choose the joins from measured sizes; a
    broadcast keeps the items' own partitioning for what follows.
    ``known_product`` tells items whose product exists.
    """
    ct = t.category_translation.select(
        "product_category_name",
        F.col("product_category_name_english").alias("category"))
    prod = (t.products.select("product_id", "product_category_name")
             .join(ct, "product_category_name", "left")
             .select("product_id", "category", F.lit(True).alias("_known")))
    return (t.order_items.select("order_id", "product_id", "price", "freight_value")
             .join(prod, "product_id", "left")
             .withColumn("known_product", F.col("_known").isNotNull()).drop("_known"))

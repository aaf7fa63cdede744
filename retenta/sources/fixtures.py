"""Map the driver's synthetic star-schema tables onto the eight reference tables.

The mapping is pure column arithmetic over the driver tables, so every query
built on it reads whole driver tables and its work grows with them. The same
expressions exist as DuckDB SQL (``FIXTURE_SQL``) for the oracle check.

Fixed values of the mapping:
- person (customer_unique_id) = o_custkey * 10 + leading digit of o_orderpriority,
  i.e. one person per (customer, priority class); every order is kept
- customer_id = order_id = o_orderkey (customer_id is per order, as in the source data)
- status F -> delivered, O -> shipped, P -> canceled
- purchase time = o_orderdate + (o_orderkey % 86400) seconds
- delivered = NULL when o_orderkey % 37 = 0, else o_orderdate + ((o_orderkey * 7) % 45) days
- estimated = NULL when o_orderkey % 149 = 0, else o_orderdate + 30 days
- product category = p_brand, NULL when p_partkey % 50 = 0
- category translation: every brand except 'Brand#13', english = 'cat_' || lower(brand)
- item price = l_extendedprice, freight = l_quantity, both DECIMAL(10,2)
- payment per line: R -> voucher, A -> boleto, N -> credit_card;
  installments = int(l_quantity) % 12 + 1; value = price
- review per line with l_linenumber = 1: score = 1 + int(l_quantity) % 5
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _status(c):
    return (F.when(c == "F", "delivered").when(c == "O", "shipped")
            .when(c == "P", "canceled"))


def map_orders(o: DataFrame) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    # one order in 211 has no purchase time, one in 101 is unavailable
    purchase = F.when(key % 211 != 0, day + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)")))
    delivered = F.when(key % 37 != 0, day + F.make_dt_interval(days=((key * 7) % 45).cast("int")))
    return o.select(
        key.alias("order_id"),
        key.alias("customer_id"),
        F.when(key % 101 == 0, "unavailable").otherwise(_status(F.col("o_orderstatus"))).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        purchase.alias("order_approved_at"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        F.when(key % 149 != 0, day + F.make_dt_interval(days=F.lit(30))).alias("order_estimated_delivery_date"),
    )


def map_customers(o: DataFrame, c: DataFrame, n: DataFrame) -> DataFrame:
    # one order in 307 names no person, one customer in 43 no state
    person = F.when(F.col("o_orderkey") % 307 != 0,
                    F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long"))
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .select(F.col("o_orderkey").alias("customer_id"),
                     person.alias("customer_unique_id"),
                     F.lit(None).cast("string").alias("customer_zip_code_prefix"),
                     F.col("c_name").alias("customer_city"),
                     F.when(F.col("c_custkey") % 43 != 0, F.col("n_name")).alias("customer_state")))


def map_sellers(s: DataFrame, n: DataFrame) -> DataFrame:
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .select(F.col("s_suppkey").alias("seller_id"),
                     F.lit(None).cast("string").alias("seller_zip_code_prefix"),
                     F.col("s_name").alias("seller_city"),
                     F.col("n_name").alias("seller_state")))


def map_products(p: DataFrame) -> DataFrame:
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        F.length("p_type").alias("product_description_length"),
        F.col("p_size").alias("product_photos_qty"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("product_weight_g"),
        F.lit(None).cast("decimal(18,4)").alias("product_length_cm"),
        F.lit(None).cast("decimal(18,4)").alias("product_height_cm"),
        F.lit(None).cast("decimal(18,4)").alias("product_width_cm"),
    )


def map_category_translation(p: DataFrame) -> DataFrame:
    return (p.select(F.col("p_brand").alias("product_category_name")).distinct()
             .filter(F.col("product_category_name") != "Brand#13")
             .select("product_category_name",
                     F.concat(F.lit("cat_"), F.lower("product_category_name"))
                      .alias("product_category_name_english")))


def _price():
    return F.col("l_extendedprice").cast("decimal(10,2)")


def map_order_items(li: DataFrame) -> DataFrame:
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        _price().alias("price"),
        F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"),
    )


def map_order_payments(li: DataFrame) -> DataFrame:
    rf = F.col("l_returnflag")
    ptype = F.when(rf == "R", "voucher").when(rf == "A", "boleto").when(rf == "N", "credit_card")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        ptype.alias("payment_type"),
        (F.col("l_quantity").cast("int") % 12 + 1).alias("payment_installments"),
        _price().alias("payment_value"),
    )


def map_order_reviews(li: DataFrame) -> DataFrame:
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
         .alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        F.col("l_shipdate").alias("review_answer_timestamp"),
    )


def load_fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy reference tables over the driver's parquet files at ``sf_dir``."""
    r = lambda n: read_driver(spark, sf_dir, n)
    o, li, p = r("orders"), r("lineitem"), r("part")
    nation = r("nation")
    return Tables(
        customers=map_customers(o, r("customer"), nation),
        sellers=map_sellers(r("supplier"), nation),
        category_translation=map_category_translation(p),
        products=map_products(p),
        orders=map_orders(o),
        order_items=map_order_items(li),
        order_payments=map_order_payments(li),
        order_reviews=map_order_reviews(li),
    )


# The same mapping for DuckDB (oracle side). Each CTE is one reference table.
FIXTURE_SQL = """
m_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
         CASE WHEN o_orderkey % 101 = 0 THEN 'unavailable' ELSE
           CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                              WHEN 'P' THEN 'canceled' END END AS order_status,
         CASE WHEN o_orderkey % 211 <> 0
              THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS order_purchase_timestamp,
         CASE WHEN o_orderkey % 37 <> 0
              THEN o_orderdate + to_days(CAST((o_orderkey * 7) % 45 AS INTEGER)) END
           AS order_delivered_customer_date,
         CASE WHEN o_orderkey % 149 <> 0 THEN o_orderdate + to_days(30) END AS order_estimated_delivery_date
  FROM orders),
m_customers AS (
  SELECT o.o_orderkey AS customer_id,
         CASE WHEN o.o_orderkey % 307 <> 0 THEN
           o.o_custkey * 10 + CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) END AS customer_unique_id,
         c.c_name AS customer_city,
         CASE WHEN c.c_custkey % 43 <> 0 THEN n.n_name END AS customer_state
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey),
m_sellers AS (
  SELECT s_suppkey AS seller_id, s_name AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS product_category_name
  FROM part),
m_category_translation AS (
  SELECT DISTINCT p_brand AS product_category_name,
         'cat_' || lower(p_brand) AS product_category_name_english
  FROM part WHERE p_brand <> 'Brand#13'),
m_order_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
  FROM lineitem),
m_order_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         CASE l_returnflag WHEN 'R' THEN 'voucher' WHEN 'A' THEN 'boleto'
                           WHEN 'N' THEN 'credit_card' END AS payment_type,
         CAST(trunc(l_quantity) AS INTEGER) % 12 + 1 AS payment_installments,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS payment_value
  FROM lineitem),
m_order_reviews AS (
  SELECT l_orderkey AS order_id, CAST(trunc(l_quantity) AS INTEGER) % 5 + 1 AS review_score
  FROM lineitem)
"""

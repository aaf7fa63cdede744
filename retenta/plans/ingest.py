"""Ingest and integrity plans over the reference tables."""

from __future__ import annotations

import dataclasses
import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import quality
from ..session import scratch_path, together
from ..sources import csv, rejects, sinks, versions
from ..sources.tables import Tables, from_parquet_dir


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast a frame to the declared schema of ``table`` (column order and types)."""
    st = schemas.SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields])


def write_csvs(t: Tables, folder: str) -> None:
    """S12 of all eight tables, side by side, compressed: as plain text they take several times the disk of all else."""
    together(t.orders.sparkSession, (lambda name=name, df=df: sinks.write_csv(conform(df, name), f"{folder}/{name}", zipped=True)
                                     for name, df in t.as_dict().items()))


def csv_round_trip(spark: SparkSession, t: Tables, table: str, tag: str) -> DataFrame:
    """S12 then S1-S3: publish a table as header CSV in the shared checkpoint folder and read
    it back through the declared schema (FAILFAST). The written copy is a full table."""
    key = hashlib.sha1(tag.encode()).hexdigest()[:12]
    path = scratch_path(spark, f"csv_round_trip/{table}-{key}")
    sinks.write_csv(conform(getattr(t, table), table), path)
    return csv.read_csv(spark, path, table)


def load_round_trip(spark: SparkSession, t: Tables) -> DataFrame:
    """S1-S5, S11 over all eight tables: publish as CSV, load through the declared schemas, replace
    an earlier load, re-read the typed Parquet. One row per table: table_name, n_rows, n_columns."""
    src, out = scratch_path(spark, "load-csv"), scratch_path(spark, "load-parquet")
    write_csvs(t, src)
    loaded = csv.read_csv_dir(spark, {name: f"{src}/{name}" for name in schemas.SCHEMAS})
    for _ in range(2):                       # the second load replaces the first
        csv.load_tables(loaded, out)
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
             for name, df in from_parquet_dir(spark, out).as_dict().items()]
    return reduce(DataFrame.unionByName, parts)


# The constraints that the driver's tables break (their line numbers repeat, some brands have no
# translation, some orders no person), and the columns that the mapping fills.
FIXTURE_FAULTS = frozenset({("primary_key", "order_items"), ("primary_key", "order_payments"), ("foreign_key", "products"),
                            ("not_null", "customers")})
FILLED = {
    "customers": ["customer_id", "customer_unique_id", "customer_city", "customer_state"],
    "sellers": ["seller_id", "seller_city", "seller_state"],
    "category_translation": ["product_category_name", "product_category_name_english"],
    "products": ["product_id", "product_category_name"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
               "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    "order_payments": ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
    "order_reviews": ["order_id", "review_score"],
}


def atomic_load(spark: SparkSession, t: Tables) -> DataFrame:
    """All eight tables through CSV into a store, as one version; then a second load whose orders have a
    bad record. It must fail and leave the first version of every table live. Returns the live tables' value checksums."""
    src, store = scratch_path(spark, "load-csv"), scratch_path(spark, "store")
    write_csvs(t, src)
    loaded = csv.read_csv_dir(spark, {name: f"{src}/{name}" for name in schemas.SCHEMAS})
    versions.replace_all(loaded, store, FIXTURE_FAULTS)
    late = conform(t.orders, "orders").select([F.col(c).cast("string").alias(c) for c in schemas.SCHEMAS["orders"].names])
    sinks.write_csv(late.withColumn("order_estimated_delivery_date", F.lit("soon")), f"{src}/bad", zipped=True)
    try:
        versions.replace_all(dataclasses.replace(loaded, orders=csv.read_csv(spark, f"{src}/bad", "orders")), store, FIXTURE_FAULTS)
    except versions.LoadRejected:
        raise
    except Exception as bad_row:        # FAILFAST, wrapped by Spark as the job's failure
        if "MALFORMED_RECORD" not in str(bad_row) and "soon" not in str(bad_row):
            raise
    else:
        raise RuntimeError("a load with bad records was published")
    return versions.checksums(versions.live(spark, store), FILLED)


def rejected_order_rows(spark: SparkSession, t: Tables) -> DataFrame:
    """S3's report: orders as CSV in which every 1,009th id has a purchase time that is none and every 1,013th
    an approval in a 13th month; lists each fault's column, reason and value, and in how many records it stands."""
    text = conform(t.orders, "orders").select([F.col(c).cast("string").alias(c) for c in schemas.SCHEMAS["orders"].names])
    key = F.col("order_id").cast("long")
    planted = text.withColumns({
        "order_purchase_timestamp": F.when(key % 1009 == 0, F.concat(F.lit("?"), "order_id")).otherwise(F.col("order_purchase_timestamp")),
        "order_approved_at": F.when(key % 1013 == 0, F.concat(F.lit("2017-13-01 "), "order_id")).otherwise(F.col("order_approved_at"))})
    path = scratch_path(spark, "planted-csv")
    sinks.write_csv(planted, path)
    found = rejects.read_with_rejects(spark, path, "orders")[1]
    return found.groupBy("table_name", "column_name", "reason", "value").agg(F.count_distinct("file", "record").alias("n_records"))


def duplicate_item_keys(t: Tables) -> DataFrame:
    """S6 on order_items (order_id, order_item_id)."""
    return quality.duplicate_keys(t.order_items, schemas.PRIMARY_KEYS["order_items"])


def untranslated_categories(t: Tables) -> DataFrame:
    """S7 on products.product_category_name -> category_translation."""
    return quality.orphans(t.products, "product_category_name", t.category_translation,
                           "product_category_name").select("product_id", "product_category_name")


def null_person_keys(t: Tables) -> DataFrame:
    """S8 on customers.customer_unique_id."""
    return quality.null_keys(t.customers, schemas.NOT_NULL["customers"])


def stream_round_trip(spark: SparkSession, t: Tables, table: str, tag: str) -> DataFrame:
    """S1/S5 as a stream: publish CSV, ingest it with the file-source stream, read the Parquet."""
    from ..streaming.ingest import ingest
    key = hashlib.sha1(tag.encode()).hexdigest()[:12]
    base_dir = scratch_path(spark, f"stream_round_trip/{table}-{key}")
    src, out, cp = f"{base_dir}/src", f"{base_dir}/out", f"{base_dir}/cp"
    sinks.write_csv(conform(getattr(t, table), table), src)
    ingest(spark, src, table, out, checkpoint=cp)
    return spark.read.schema(schemas.SCHEMAS[table]).parquet(out)

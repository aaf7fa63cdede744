"""Orders and order items laid out by calendar month (S5, P9): a range of months is read by its folders only,
and one month is replaced without touching the others.

The folder column ``order_month`` is year * 100 + month of the purchase, null for orders without a time and
for items without an order. A month may hold any share of the rows: it is written by up to ``files`` tasks.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.base import TS
from .tables import Tables

MONTH = "order_month"
LAID_OUT = ("orders", "order_items")
# How many order ids may be sent to every executor, and how many orders (with their items) a writing task gets.
FEW_ORDERS, ORDERS_A_TASK = 1_000_000, 50_000


def month_of(ts) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def by_order(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, ``n`` rows with an order_id, as the side of a join that is hashed: few are sent to every executor, else both
    sides are dealt by order_id and each task hashes its share. The items, the larger side, are never sorted."""
    return F.broadcast(ids) if n <= FEW_ORDERS else ids.hint("shuffle_hash")


def _write(frames: dict[str, DataFrame], path: str, files: int, mode: str, n_orders: int) -> None:
    """The writer sorts a task's rows by month: more orders are dealt to more tasks, so that a sort fits in memory."""
    parts = int(next(iter(frames.values())).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-n_orders // ORDERS_A_TASK)
    for name, df in frames.items():
        keys = [F.col(MONTH), F.pmod(F.xxhash64("order_id"), F.lit(files))]
        dealt = df.repartition(tasks, *keys) if tasks > parts else df.repartition(*keys)
        (dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(MONTH)
         .parquet(f"{path.rstrip('/')}/{name}"))


def write_months(t: Tables, path: str, files: int = 8) -> None:
    """Write the orders and order items of ``t``, a folder a month, into a new ``path``."""
    n, orders = t.orders.count(), t.orders.withColumn(MONTH, month_of(TS))
    items = t.order_items.join(by_order(orders.select("order_id", MONTH), n), "order_id", "left").select(*t.order_items.columns, MONTH)
    _write({"orders": orders, "order_items": items}, path, files, "errorifexists", n)


def replace_months(t: Tables, path: str, files: int = 8) -> None:
    """Replace the months that the orders of ``t`` have, by all their rows in ``t``; other months stay as they are.

    Without an order, no month is replaced. A month is replaced whole: rows that ``t`` lacks are gone, and where
    an order moves to another month, both months must be given. Items without an order in ``t`` aren't written.
    Items of a month for which ``t`` has orders but no item at all stay; the two tables are replaced one after the other.
    """
    n, orders = t.orders.count(), t.orders.withColumn(MONTH, month_of(TS))
    items = t.order_items.join(by_order(orders.select("order_id", MONTH), n), "order_id").select(*t.order_items.columns, MONTH)
    _write({"orders": orders, "order_items": items}, path, files, "overwrite", n)


def read_months(spark: SparkSession, path: str, rest: Tables, since: int | None = None, until: int | None = None) -> Tables:
    """``rest`` with the orders and order items of the layout (in the column types of ``rest``), from month ``since`` to month ``until`` (both included,
    as year * 100 + month). With a bound, rows without a month are left out, and folders outside are not read."""
    frames = {}
    for name in LAID_OUT:
        typed = StructType([*getattr(rest, name).schema.fields, StructField(MONTH, IntegerType())])
        df = spark.read.schema(typed).parquet(f"{path.rstrip('/')}/{name}")
        if since is not None:
            df = df.filter(F.col(MONTH) >= since)
        if until is not None:
            df = df.filter(F.col(MONTH) <= until)
        frames[name] = df.drop(MONTH)
    return replace(rest, **frames, shared_person_orders=None)

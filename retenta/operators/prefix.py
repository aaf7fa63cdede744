"""Distributed prefix sums in a global order (no single-partition window).

Rows are range-partitioned on the order columns and written once with their
partition's number, so that every later pass sees the same ranges. Each range
is summed locally, with a window partitioned by the range; the ranges' totals
(``parts`` rows per group, a bound set by configuration) are turned into
offsets. No expression grows with the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranged(df: DataFrame, order_cols: list[str], parts: int | None = None) -> DataFrame:
    """``df``, written, with ``_part``: number of the row's range in ``order_cols`` (0 = smallest)."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order_cols).withColumn("_part", F.spark_partition_id()))


def cumulative_sums(df: DataFrame, order_col: str, cols: list[str], descending: bool = True,
                    parts: int | None = None, prefix: str = "cum_", groups: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of ``cols`` over ``order_col`` (inclusive), one row per input row,
    plus the totals ``total_<col>``; with ``groups`` both are per group, and a
    group of any size spans as many ranges as its rows fill.

    ``order_col`` should be unique per row and group (e.g. after grouping by it), so the
    running order is total. Null groups are groups of their own.
    """
    r = ranged(df, [*groups, order_col], parts)
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy("_part", *groups).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(c).over(w).alias(prefix + c) for c in cols])
    totals = r.groupBy("_part", *groups).agg(*[F.sum(c).alias("_t_" + c) for c in cols])
    # offsets: sum of totals of the group's ranges that come earlier in the running order
    whole = Window.partitionBy(*groups)
    before = (whole.orderBy(F.col("_part").desc() if descending else F.col("_part").asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = totals.select(F.col("_part").alias("_op"), *[F.col(g).alias("_og_" + g) for g in groups],
                         *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c) for c in cols],
                         *[F.sum("_t_" + c).over(whole).alias("total_" + c) for c in cols])
    same = F.col("_part") == F.col("_op")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col("_og_" + g))
    out = local.join(offs, same)
    return out.select(*df.columns,
                      *[(F.col(prefix + c) + F.col("_o_" + c)).alias(prefix + c) for c in cols],
                      *[F.col("total_" + c) for c in cols])

"""Aggregate building blocks that Spark has no single built-in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio_round


def mode_smallest(col) -> Column:
    """MODE() WITHIN GROUP (ORDER BY col): most frequent non-null value, ties -> smallest.

    Built-in form with a per-group value->count map buffer, which X1 and D3 use: an
    order's items have few distinct categories. ``grouped_mode`` is for groups of many values.
    """
    return F.mode(col, deterministic=True)


def grouped_mode(df: DataFrame, keys: list[str], value: str, out: str,
                 sums: dict | None = None, maxes: dict | None = None) -> DataFrame:
    """Per key: the modal non-null ``value`` (ties -> smallest) plus optional SUM/MAX columns.

    Two levels instead of a map-buffer aggregate:
    1. COUNT (and partial SUM/MAX) per (keys, value): a codegen'd hash aggregate
       with map-side partial aggregation, so a hot key shrinks before the shuffle;
    2. one window per key ranks its (bounded: distinct values per key) rows by
       (value IS NULL, count desc, value asc); the first row carries the mode and
       the per-key totals. The NULL-value group still counts toward the sums.
    ``sums``/``maxes`` map output name -> input column expression.
    """
    sums, maxes = sums or {}, maxes or {}
    lvl1 = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_m_{o}") for o, c in maxes.items()])
    w = Window.partitionBy(*keys)
    ranked = lvl1.select(
        *keys, value,
        F.row_number().over(w.orderBy(F.col(value).isNull(), F.col("_n").desc(),
                                      F.col(value).asc())).alias("_r"),
        *[F.sum(f"_s_{o}").over(w).alias(o) for o in sums],
        *[F.max(f"_m_{o}").over(w).alias(o) for o in maxes])
    return ranked.filter(F.col("_r") == 1).select(*keys, F.col(value).alias(out), *sums, *maxes)


def value_counts(df: DataFrame, col: str, normalize: bool = False, digits: int | None = None,
                 top: int | None = None) -> DataFrame:
    """value_counts (A19), optionally normalised (A20) and limited to the top n.

    Order: count descending, then value ascending (a fixed tie rule).
    """
    vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        # scalar subquery: the total is computed once and inlined, no join
        total = df.agg(F.count(F.lit(1))).scalar()
        share = (ratio_round(F.col("count"), total, digits) if digits is not None
                 else F.col("count") / total)
        vc = vc.select(col, share.alias("proportion"))
        order = [F.col("proportion").desc(), F.col(col).asc_nulls_last()]
    else:
        order = [F.col("count").desc(), F.col(col).asc_nulls_last()]
    vc = vc.orderBy(*order)
    return vc.limit(top) if top else vc


def null_counts(df: DataFrame) -> DataFrame:
    """isnull().sum() per column (A21) as (column, null_count) rows: one pass, one small result."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    wide = df.agg(*[F.count_if(F.col(q).isNull()).alias(f"n{i}") for i, q in enumerate(quoted)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
            for i, c in enumerate(df.columns)]
    return wide.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a frame (A22) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))

"""Stored mergeable sketches a month (A18, L5, A3): an opt-in beside the exact operators, which stay the default.

Per month one row holds a quantile sketch (KLL) for each measure, a heavy-hitter sketch
for each category column and a distinct-count sketch (HLL) for each id column. Rows
of months merge on demand, so an answer over any range reads months x sketches, no
data. Sketches are partial aggregates: a hot month is summed up on the map side, and
what is shuffled is a sketch per task and month, of a size that the parameters fix.

Bounds (DataSketches): ``rank_error`` holds with about 99 % per quantile, ``count_error``
always, ``distinct_error`` is one standard error. Nulls are in no sketch; NaN is in no quantile sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUANTILE_K = 800       # KLL: items of the top level
ITEMS = 10_000         # heavy hitters: items tracked
DISTINCT_LG = 14       # HLL: log2 of the registers
MONTH = "sketch_month"
N_ROWS = "n_rows"


def rank_error(k: int = QUANTILE_K) -> float:
    """Share of the rows by which the rank of a quantile may be off (fixed values of the sketch)."""
    return 2.296 / k ** 0.9723


def count_error(n: int, items: int = ITEMS) -> float:
    """Rows by which the count of an item may be off among ``n``; none while at most ``items`` items differ."""
    return 3.5 * 0.75 / items * n


def distinct_error(lg: int = DISTINCT_LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg / 2)


def _named(kind: str, column: str) -> str:
    return f"{kind}_{column}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def monthly(df: DataFrame, month: Column, values=(), items=(), ids=(), k: int = QUANTILE_K, tracked: int = ITEMS,
            lg: int = DISTINCT_LG) -> DataFrame:
    """sketch_month, n_rows and a sketch for each column of ``values`` (numbers), ``items`` (categories) and ``ids``.

    Rows without a month are a month of their own (null). Without rows there is no month.
    """
    parts = [F.kll_sketch_agg_double(F.col(_quoted(c)).cast("double"), F.lit(k)).alias(_named("quantiles", c)) for c in values]
    parts += [F.expr(f"approx_top_k_accumulate({_quoted(c)}, {int(tracked)}) FILTER (WHERE {_quoted(c)} IS NOT NULL)")
              .alias(_named("items", c)) for c in items]
    parts += [F.hll_sketch_agg(_quoted(c), F.lit(lg)).alias(_named("ids", c)) for c in ids]
    return df.withColumn(MONTH, month).groupBy(MONTH).agg(F.count(F.lit(1)).alias(N_ROWS), *parts)


def save(sketches: DataFrame, path: str) -> None:
    """Write a folder a month. Months that ``path`` has already are replaced, the others stay."""
    (sketches.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH).parquet(path))


def read(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Stored months from ``since`` to ``until``, both included; with a bound, without the null month.

    Folders outside the range aren't read.
    """
    df = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("int"))
    if since is not None:
        df = df.filter(F.col(MONTH) >= since)
    if until is not None:
        df = df.filter(F.col(MONTH) <= until)
    return df


def merged(sketches: DataFrame, *keys: Column | str) -> DataFrame:
    """One row per ``keys`` (one in all without keys): the sketches of all its months merged."""
    merge = {"quantiles": lambda c: F.kll_merge_agg_double(_quoted(c)),
             "items": lambda c: F.expr(f"approx_top_k_combine({_quoted(c)})"),
             "ids": lambda c: F.hll_union_agg(_quoted(c))}
    parts = [merge[c.split("_")[0]](c).alias(c) for c in sketches.columns if c not in (MONTH, N_ROWS)]
    return sketches.groupBy(*keys).agg(F.sum(N_ROWS).alias(N_ROWS), *parts)


def quantile(column: str, share: float) -> Column:
    """The value of rank ``share`` of a measure, from its sketch; null without values."""
    sketch = F.col(_quoted(_named("quantiles", column)))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def heavy_hitters(sketches: DataFrame, column: str, top: int, *keys: str) -> DataFrame:
    """keys, the ``top`` most frequent items of a column and ``count``, their estimated rows."""
    found = F.expr(f"approx_top_k_estimate({_quoted(_named('items', column))}, {int(top)})")
    return sketches.select(*keys, F.explode(found).alias("x")).select(
        *keys, F.col("x.item").alias(column), F.col("x.count").alias("count"))


def distinct(column: str) -> Column:
    """The estimated number of different non-null values of an id column."""
    return F.hll_sketch_estimate(_quoted(_named("ids", column)))

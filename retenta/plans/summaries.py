"""Answers from stored monthly sketches, held against the exact operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_month_text
from ..ml import prep
from ..operators import base, sketches
from ..operators.order_stats import medians
from ..session import materialize, scratch_path
from ..sources.months import month_of
from ..sources.tables import Tables
from .features import first_order_features

MEASURES = ["delivery_days", "review_score", "avg_item_value"]
CATEGORY = "product_category"
SLACK = 2        # stated bounds hold with 99 %; twice as far off is a fault
SIGMAS = 6       # of a distinct count's standard error


def _stored(rows: DataFrame, **columns) -> DataFrame:
    """Sketches of ``rows``, stored in two loads: the last month of the rows arrives after the others."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "sketches")
    month = month_of(base.TS)
    last = rows.agg(F.max(month)).first()[0]
    late = F.coalesce(month == last, F.lit(False))
    sketches.save(sketches.monthly(rows.filter(~late), month, **columns), path)
    sketches.save(sketches.monthly(rows.filter(late), month, **columns), path)
    return sketches.read(spark, path)


def sketched_medians(t: Tables) -> DataFrame:
    """column_name, n_values, median (exact), within: whether the rank of the merged sketches' median, among all values,
    is as near to the middle as the bound says. A column without values has no row."""
    f = materialize(prep.add_flags(first_order_features(t)).select(base.TS, *MEASURES))
    row = sketches.merged(_stored(f, values=MEASURES)).select(
        *[sketches.quantile(c, 0.5).alias(c) for c in MEASURES]).first()
    guess = {c: row[c] for c in MEASURES if row[c] is not None}
    if not guess:
        return f.limit(0).select(F.lit("").alias("column_name"), F.lit(0).cast("long").alias("n_values"),
                                 F.lit(0.0).alias("median"), F.lit(True).alias("within"))
    ranks = f.agg(*[e.alias(f"{n}_{c}") for c, g in guess.items() for n, e in (
        ("n", F.count(c)), ("lt", F.count_if(F.col(c) < g)), ("le", F.count_if(F.col(c) <= g)))])
    off = SLACK * sketches.rank_error()
    checked = ranks.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_values"),
        ((F.col(f"lt_{c}") - 1 <= (0.5 + off) * F.col(f"n_{c}")) & (F.col(f"le_{c}") + 1 >= (0.5 - off) * F.col(f"n_{c}"))).alias("within"))
        for c in guess])))
    exact = medians(f, list(guess)).withColumnRenamed("column", "column_name")
    return checked.join(exact, "column_name").select("column_name", "n_values", "median", "within")


def sketched_categories(t: Tables, top: int = 15) -> DataFrame:
    """The ``top`` categories of first orders and their counts from merged sketches; ties by name.

    Counts are exact while at most ``sketches.ITEMS`` categories differ. All tracked items are read, so that ties at the last place are seen.
    """
    f = prep.drop_incomplete(prep.impute(first_order_features(t), {"delivery_days": None}))
    f = materialize(f.select(base.TS, CATEGORY))
    found = sketches.heavy_hitters(sketches.merged(_stored(f, items=[CATEGORY])), CATEGORY, sketches.ITEMS)
    return (found.orderBy(F.col("count").desc(), CATEGORY).limit(top)
            .select(CATEGORY, F.col("count").alias("n_customers")))


def sketched_persons(t: Tables) -> DataFrame:
    """month, n_persons (exact: different persons with a valid order), within: whether the stored sketch's estimate is within the bound.

    The row with month 'all' is the merge of all months.
    """
    po = materialize(base.person_orders(t).select(base.TS, base.PERSON))
    kept = _stored(po, ids=[base.PERSON])
    key = F.concat(F.lpad((F.col(sketches.MONTH) / 100).cast("int").cast("string"), 4, "0"), F.lit("-"),
                   F.lpad((F.col(sketches.MONTH) % 100).cast("string"), 2, "0"))
    guess = (kept.select(key.alias("month"), sketches.distinct(base.PERSON).alias("guess"))
             .unionByName(sketches.merged(kept).select(F.lit("all").alias("month"), sketches.distinct(base.PERSON).alias("guess"))))
    pairs = po.select(year_month_text(base.TS).alias("month"), base.PERSON).distinct()
    persons = pairs.select(base.PERSON).distinct().agg(F.count(base.PERSON).alias("n_persons"))
    exact = (pairs.groupBy("month").agg(F.count(base.PERSON).alias("n_persons"))
             .unionByName(persons.select(F.lit("all").alias("month"), "n_persons")))
    off = F.greatest(F.lit(1.0), SIGMAS * sketches.distinct_error() * F.col("n_persons"))
    return (exact.join(guess.withColumnRenamed("month", "m"), F.col("month").eqNullSafe(F.col("m")), "left")
            .select("month", "n_persons", F.coalesce(F.abs(F.col("guess") - F.col("n_persons")) <= off, F.lit(False)).alias("within")))

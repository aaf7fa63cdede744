"""Monthly cohort activity (Q2, D4, J2, A3) from one bitset of active months per person.

A person's months are bits: month number ``m`` (year * 12 + month) is bit ``m % 60`` of word
``m div 60``. The words of all orders are combined by bit-or, which Spark does
map-side, so a person with any number of orders is one row per task before the one shuffle by person. The
lowest set bit is the cohort month, the set bits are the active months: no distinct, no window over
a person's rows, no join of the first purchase back to the orders. Bitsets of two batches merge by bit-or
(``merged``), so they can be stored and kept up to date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index, month_start, months_apart
from .base import PERSON, TS

#: Months in a word; a calendar of more words than WORDS (200 years) is counted by distinct months instead.
WORD, WORDS = 60, 40


def calendar(orders: DataFrame) -> tuple[int, int] | None:
    """First and last word of the purchase months, from one pass over that column; None without any."""
    low, high = orders.agg(F.min(month_index(TS)), F.max(month_index(TS))).first()
    return None if low is None else (low // WORD, high // WORD)


def month_bits(po: DataFrame, words: tuple[int, int]) -> DataFrame:
    """One row per person that is named: ``w_<word>`` per word from the first to the last, and ``undated`` (1 if
    an order has no purchase time)."""
    m = month_index(TS)
    bit = F.expr(f"shiftleft(1L, pmod(__m, {WORD}))")
    cells = [F.coalesce(F.bit_or(F.when(F.floor(F.col("__m") / WORD) == w, bit)), F.lit(0).cast("long")).alias(f"w_{w}")
             for w in range(words[0], words[1] + 1)]
    undated = F.max(F.col("__m").isNull().cast("int")).alias("undated")
    return po.select(PERSON, m.alias("__m")).filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(*cells, undated)


def merged(*states: DataFrame) -> DataFrame:
    """The bitsets of several batches as one; their calendars may differ."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    words = sorted((c for c in every.columns if c.startswith("w_")), key=lambda c: int(c[2:]))
    return every.groupBy(PERSON).agg(*[F.coalesce(F.bit_or(w), F.lit(0).cast("long")).alias(w) for w in words],
                                     F.max("undated").alias("undated"))


def active_months(bits: DataFrame) -> Column:
    """The month numbers of the set bits, ascending."""
    return F.concat(*[F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> getbit({c}, i) = 1), i -> i + {int(c[2:]) * WORD})")
                      for c in bits.columns if c.startswith("w_")])


def activity_of(bits: DataFrame) -> DataFrame:
    """(cohort_month, month_number, active_customers, cohort_size) of persons' bitsets."""
    months = bits.select(active_months(bits).alias("m"), "undated").filter(F.size("m") > 0)
    first = F.element_at("m", 1)
    numbers = F.transform("m", lambda x: x - first)
    numbers = F.when(F.col("undated") == 1, F.concat(numbers, F.array(F.lit(None).cast("int")))).otherwise(numbers)
    act = (months.select(first.alias("c"), F.explode(numbers).alias("month_number"))
           .groupBy("c", "month_number").agg(F.count(F.lit(1)).alias("active_customers")))
    month = F.make_date(F.floor((F.col("c") - 1) / 12).cast("int"), F.pmod(F.col("c") - 1, F.lit(12)).cast("int") + 1, F.lit(1))
    return _sized(act.select(month.cast("timestamp_ntz").alias("cohort_month"), F.col("month_number").cast("int").alias("month_number"),
                             "active_customers"))


def _sized(act: DataFrame) -> DataFrame:
    """With cohort_size: the month-0 count, as every person is active in their own cohort month."""
    size = F.max(F.when(F.col("month_number") == 0, F.col("active_customers")))
    return act.withColumn("cohort_size", size.over(Window.partitionBy("cohort_month")))


def cohort_activity(po: DataFrame, words: tuple[int, int] | None = None) -> DataFrame:
    """(cohort_month, month_number, active_customers, cohort_size) from person orders.

    Orders without a purchase time count in a (cohort, NULL) row; a person with
    no dated order has no cohort and drops out, as do orders that name no person. ``words`` is the
    orders' ``calendar`` where the caller has it from a cheaper relation.
    """
    words = words or calendar(po)
    if words is None or words[1] - words[0] >= WORDS:
        return cohort_activity_by_months(po)
    return activity_of(month_bits(po, words))


def cohort_activity_by_months(po: DataFrame) -> DataFrame:
    """The same from distinct (person, month) rows and each person's least month, for calendars of any width."""
    pm = po.select(PERSON, month_start(TS).alias("order_month")).distinct()
    pm = pm.withColumn("cohort_month", F.min("order_month").over(Window.partitionBy(PERSON)))
    pm = pm.filter(F.col("cohort_month").isNotNull() & F.col(PERSON).isNotNull())
    act = (pm.select("cohort_month", months_apart("order_month", "cohort_month").alias("month_number"))
             .groupBy("cohort_month", "month_number")
             .agg(F.count(F.lit(1)).alias("active_customers")))
    return _sized(act)

"""The first-order feature table (X1, W1-W3) kept up to date batch by batch.

Kept between batches: the tables received so far, one state row per person (the first order's
key and payload, and the number of orders) and the feature table. States merge by
the least key and the sum of counts, so batches may come in any order and orders that arrive late count as
if they had come in time. A batch touches the persons who have an order in it and those whose
first order gets items, payments or reviews; only their feature rows are built
again, from the rows of their first orders alone; all others are carried over.

Products and their translations come no later than the items that name them. Rows are only added: a corrected or cancelled earlier order needs the table built anew.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import base
from ..session import materialize
from ..sources.tables import Tables
from .features import FEATURE_COLUMNS, features_of_first_orders

PERSON, TS = base.PERSON, base.TS
PAYLOAD = ["customer_state", "order_delivered_customer_date", "order_estimated_delivery_date"]
FACTS = ["order_items", "order_payments", "order_reviews"]


@dataclasses.dataclass(frozen=True)
class Kept:
    """What is kept between batches; ``tables`` are all rows so far."""
    tables: Tables
    state: DataFrame
    features: DataFrame


def person_state(po: DataFrame) -> DataFrame:
    """(person, first, total_orders): ``first`` orders by (no time, time, order_id) and carries the payload."""
    first = F.struct(F.col(TS).isNull().alias("undated"), TS, "order_id", *PAYLOAD)
    return po.groupBy(PERSON).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("total_orders"))


def merged_state(*states: DataFrame) -> DataFrame:
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(PERSON).agg(F.min("first").alias("first"), F.sum("total_orders").alias("total_orders"))


def _first_orders(state: DataFrame) -> DataFrame:
    return state.select(PERSON, "first.order_id", f"first.{TS}", *[f"first.{c}" for c in PAYLOAD], "total_orders")


def _same(a: str, b: str, column: str) -> Column:
    return F.col(f"{a}.{column}").eqNullSafe(F.col(f"{b}.{column}"))


def start(t: Tables) -> Kept:
    """The first batch."""
    state = materialize(person_state(base.person_orders(t)))
    return Kept(t, state, materialize(features_of_first_orders(t, _first_orders(state))))


def update(kept: Kept, batch: Tables) -> Kept:
    """The kept state with one more batch of rows (any of the eight tables may be empty in it)."""
    old, new = kept.tables.as_dict(), batch.as_dict()
    both = Tables(**{n: old[n].unionByName(new[n]) for n in old})
    # orders that became joinable with this batch: new orders, and earlier ones whose customer comes only now
    arrived = [base.person_orders(dataclasses.replace(both, orders=batch.orders)),
               base.person_orders(dataclasses.replace(both, orders=kept.tables.orders, customers=batch.customers))]
    fresh = materialize(person_state(arrived[0].unionByName(arrived[1])))
    facts = new[FACTS[0]].select("order_id")
    for name in FACTS[1:]:
        facts = facts.unionByName(new[name].select("order_id"))
    late = kept.state.alias("s").join(facts.distinct().alias("f"), F.col("s.first.order_id") == F.col("f.order_id")).select(f"s.{PERSON}")
    touched = materialize(fresh.select(PERSON).unionByName(late).distinct())
    earlier = kept.state.alias("s").join(touched.alias("t"), _same("s", "t", PERSON), "left_semi")
    rebuilt = materialize(merged_state(earlier, fresh))
    state = kept.state.alias("s").join(touched.alias("t"), _same("s", "t", PERSON), "left_anti").unionByName(rebuilt)
    rows = features_of_first_orders(both, _first_orders(rebuilt))
    carried = kept.features.alias("s").join(touched.alias("t"), _same("s", "t", PERSON), "left_anti")
    return Kept(both, materialize(state), materialize(carried.unionByName(rows).select(*FEATURE_COLUMNS)))


def in_two_batches(t: Tables) -> DataFrame:
    """X1 from two batches: by arithmetic on keys, half of the orders arrive later, whatever their time, and of each order's items,
    payments and reviews some come with the first batch and some with the second."""
    first, second = {}, {}
    late = {"orders": F.pmod(F.col("order_id") * 31 + 7, F.lit(10)) >= 5, "order_items": F.col("order_item_id") % 3 == 0,
            "order_payments": F.col("payment_sequential") % 2 == 0, "order_reviews": F.pmod(F.col("order_id"), F.lit(4)) == 1}
    for name, df in t.as_dict().items():
        first[name] = df.filter(~late[name]) if name in late else df
        second[name] = df.filter(late[name]) if name in late else df.limit(0)
    return update(start(Tables(**first)), Tables(**second)).features

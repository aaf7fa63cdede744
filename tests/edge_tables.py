"""Hand-written reference tables covering the edge cases of FIXTURES.md §4."""

import datetime as dt
from decimal import Decimal as D

from retenta import schemas
from retenta.sources.tables import Tables

T = dt.datetime


def edge_tables(spark) -> Tables:
    customers = [
        # person A: two orders at the same timestamp (o1, o2) + one later order o3 in another state
        ("c1", "A", None, None, "SP"), ("c2", "A", None, None, "SP"), ("c3", "A", None, None, "RJ"),
        # person B: one canceled + one valid order (one-time buyer after the filter)
        ("c4", "B", None, None, "MG"), ("c5", "B", None, None, "MG"),
        # person C: a single order without items, NULL delivery
        ("c6", "C", None, None, "SP"),
        # person D: two orders with a month gap, first delivered exactly at the estimate
        ("c7", "D", None, None, "RS"), ("c8", "D", None, None, "RS"),
        # person E: NULL status order only (dropped by NOT IN) + one order 3 days before the estimate
        ("c9", "E", None, None, "BA"), ("c10", "E", None, None, "BA"),
    ]
    orders = [
        ("o1", "c1", "delivered", T(2017, 1, 5, 10), None, None, T(2017, 1, 20), T(2017, 1, 25)),
        ("o2", "c2", "delivered", T(2017, 1, 5, 10), None, None, T(2017, 1, 28), T(2017, 1, 25)),
        ("o3", "c3", "shipped", T(2017, 3, 1), None, None, None, T(2017, 3, 20)),
        ("o4", "c4", "canceled", T(2017, 1, 1), None, None, None, T(2017, 1, 20)),
        ("o5", "c5", "delivered", T(2017, 2, 1), None, None, T(2017, 2, 10), T(2017, 2, 20)),
        ("o6", "c6", "delivered", T(2017, 2, 2), None, None, None, T(2017, 2, 20)),
        ("o7", "c7", "delivered", T(2017, 1, 10), None, None, T(2017, 1, 30), T(2017, 1, 30)),
        ("o8", "c8", "delivered", T(2017, 4, 10), None, None, T(2017, 4, 12), T(2017, 4, 30)),
        ("o9", "c9", None, T(2016, 12, 1), None, None, None, T(2016, 12, 20)),
        ("o10", "c10", "delivered", T(2017, 2, 3), None, None, T(2017, 2, 17), T(2017, 2, 20)),
    ]
    ct = [("a_pt", "a"), ("b_pt", "b")]
    products = [("pa", "a_pt"), ("pb", "b_pt"), ("pn", None), ("px", "untranslated")]
    items = [
        # o1: mode tie a/b -> 'a'
        ("o1", 1, "pa", "s1", None, D("10.00"), D("1.00")),
        ("o1", 2, "pb", "s1", None, D("20.00"), D("2.00")),
        # o2: one item
        ("o2", 1, "pb", "s1", None, D("5.00"), D("0.50")),
        # o3: untranslated category
        ("o3", 1, "px", "s1", None, D("7.00"), D("0.00")),
        # o4 canceled
        ("o4", 1, "pa", "s1", None, D("100.00"), D("0.00")),
        # o5: all-NULL category
        ("o5", 1, "pn", "s1", None, D("3.00"), D("0.01")),
        # o7, o8
        ("o7", 1, "pa", "s1", None, D("1.00"), D("0.00")),
        ("o8", 1, "pa", "s1", None, D("2.00"), D("0.00")),
        ("o8", 1, "pa", "s1", None, D("2.00"), D("0.00")),  # duplicate PK
        ("o10", 1, "pb", "s9", None, D("4.00"), D("0.00")),  # orphan seller
    ]
    payments = [("o1", 1, "credit_card", 3, D("33.00")), ("o1", 2, "boleto", 1, D("0.00")),
                ("o2", 1, "boleto", 1, D("5.50")), ("o5", 1, "voucher", 1, D("3.01")),
                ("o7", 1, "credit_card", 2, D("1.00"))]
    reviews = [("r1", "o1", 1, None, None, None, None), ("r2", "o1", 5, None, None, None, None),
               ("r3", "o2", 2, None, None, None, None), ("r4", "o7", None, None, None, None, None)]
    sellers = [("s1", None, None, "SP")]
    prods = [(p, c, None, None, None, None, None, None, None) for p, c in products]
    mk = lambda rows, name: spark.createDataFrame(rows, schemas.SCHEMAS[name])
    return Tables(customers=mk(customers, "customers"), sellers=mk(sellers, "sellers"),
                  category_translation=mk(ct, "category_translation"),
                  products=mk(prods, "products"), orders=mk(orders, "orders"),
                  order_items=mk(items, "order_items"), order_payments=mk(payments, "order_payments"),
                  order_reviews=mk(reviews, "order_reviews"))

"""Declared schemas of the eight source tables (S4): never inferred.

Column order is the CSV column order, so a positional CSV scan maps cleanly.
NUMERIC without precision becomes DECIMAL(18,4); TIMESTAMP becomes TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
NUM = T.DecimalType(18, 4)


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _st(("customer_id", S, False), ("customer_unique_id", S, False),
                ("customer_zip_code_prefix", S, True), ("customer_city", S, True),
                ("customer_state", S, True))
SELLERS = _st(("seller_id", S, False), ("seller_zip_code_prefix", S, True),
              ("seller_city", S, True), ("seller_state", S, True))
CATEGORY_TRANSLATION = _st(("product_category_name", S, False),
                           ("product_category_name_english", S, True))
PRODUCTS = _st(("product_id", S, False), ("product_category_name", S, True),
               ("product_name_length", I, True), ("product_description_length", I, True),
               ("product_photos_qty", I, True), ("product_weight_g", NUM, True),
               ("product_length_cm", NUM, True), ("product_height_cm", NUM, True),
               ("product_width_cm", NUM, True))
ORDERS = _st(("order_id", S, False), ("customer_id", S, True), ("order_status", S, True),
             ("order_purchase_timestamp", TS, True), ("order_approved_at", TS, True),
             ("order_delivered_carrier_date", TS, True),
             ("order_delivered_customer_date", TS, True),
             ("order_estimated_delivery_date", TS, True))
ORDER_ITEMS = _st(("order_id", S, False), ("order_item_id", I, False), ("product_id", S, True),
                  ("seller_id", S, True), ("shipping_limit_date", TS, True),
                  ("price", MONEY, True), ("freight_value", MONEY, True))
ORDER_PAYMENTS = _st(("order_id", S, False), ("payment_sequential", I, False),
                     ("payment_type", S, True), ("payment_installments", I, True),
                     ("payment_value", MONEY, True))
ORDER_REVIEWS = _st(("review_id", S, True), ("order_id", S, True), ("review_score", I, True),
                    ("review_comment_title", S, True), ("review_comment_message", S, True),
                    ("review_creation_date", TS, True), ("review_answer_timestamp", TS, True))

SCHEMAS = {
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "category_translation": CATEGORY_TRANSLATION,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
}

# Keys (S6), references (S7) and NOT NULL columns (S8) as declared by the source DDL.
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
}
FOREIGN_KEYS = [
    # (child table, child column, parent table, parent column)
    ("products", "product_category_name", "category_translation", "product_category_name"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]
NOT_NULL = {"customers": ["customer_unique_id"]}

# FK-safe load order (parents first).
# Tables with text columns that may hold line breaks.
FREE_TEXT = {"order_reviews"}

LOAD_ORDER = ["category_translation", "customers", "sellers", "products", "orders",
              "order_items", "order_payments", "order_reviews"]

# The same order in steps: the tables of a step refer to those of earlier steps only, and are loaded side by side.
LOAD_STEPS: list[list[str]] = []
for _name in LOAD_ORDER:
    _parents = {parent for child, _, parent, _ in FOREIGN_KEYS if child == _name}
    _step = max((i + 1 for i, names in enumerate(LOAD_STEPS) if _parents & set(names)), default=0)
    LOAD_STEPS += [[]] * (_step == len(LOAD_STEPS))
    LOAD_STEPS[_step] = [*LOAD_STEPS[_step], _name]

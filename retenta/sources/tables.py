"""The eight reference tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    sellers: DataFrame
    category_translation: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame

    # optional precomputed valid-orders ⋈ customers relation shared by many queries
    shared_person_orders: DataFrame | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if f.name != "shared_person_orders"}


def from_parquet_dir(spark: SparkSession, path: str) -> Tables:
    """Tables written by ``csv.load_tables`` (typed Parquet hand-off, S11)."""
    return Tables(**{n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in schemas.SCHEMAS})


def from_catalog(spark: SparkSession, database: str | None = None) -> Tables:
    """Tables saved with ``saveAsTable`` (S9: a query against the catalog)."""
    q = (lambda n: f"{database}.{n}") if database else (lambda n: n)
    return Tables(**{n: spark.table(q(n)) for n in schemas.SCHEMAS})

"""Data-quality jobs replacing the source DDL's constraints.

Each returns the violating rows (or keys), so an empty result means the
constraint holds; nothing is dropped or repaired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.tables import Tables


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their multiplicity (partial aggregation map-side)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key (or NOT NULL column) is NULL."""
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return df.filter(cond)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent (left anti join)."""
    p = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """S7 by key: (fk, n_rows) of the foreign keys without parent. Rows are counted by key
    map-side before the anti join, so a hot foreign key is one row."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def constraint_report(t: Tables) -> DataFrame:
    """Every declared constraint with its violation count: one row per constraint.

    One grouped pass per keyed table yields both the duplicate-key rows and the
    NULL-key rows (and the NOT NULL count of that table); one left-anti join
    per foreign key yields the orphans.
    """
    d = t.as_dict()
    parts = []

    def row(kind, table, cols, v):
        return v.select(F.lit(kind).alias("kind"), F.lit(table).alias("table_name"),
                        F.lit(cols).alias("columns"), F.col("v").cast("long").alias("violations"))

    for table, keys in schemas.PRIMARY_KEYS.items():
        nn_cols = schemas.NOT_NULL.get(table, [])
        any_null = F.lit(False)
        for k in keys:
            any_null = any_null | F.col(k).isNull()
        nn = F.lit(False)
        for c in nn_cols:
            nn = nn | F.col(c).isNull()
        g = d[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(nn).alias("nn"))
        s_ = g.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup"),
                   F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("nul"),
                   F.coalesce(F.sum("nn"), F.lit(0)).alias("nn"))
        s_ = s_.select(F.explode(F.array(
            F.struct(F.lit("primary_key").alias("kind"), F.col("dup").alias("v")),
            F.struct(F.lit("primary_key_null").alias("kind"), F.col("nul").alias("v")),
            F.struct(F.lit("not_null").alias("kind"), F.col("nn").alias("v")))).alias("x"))
        s_ = s_.select("x.kind", "x.v")
        if not nn_cols:
            s_ = s_.filter(F.col("kind") != "not_null")
        parts.append(s_.select(
            "kind", F.lit(table).alias("table_name"),
            F.when(F.col("kind") == "not_null", F.lit(",".join(nn_cols)))
             .otherwise(F.lit(",".join(keys))).alias("columns"),
            F.col("v").cast("long").alias("violations")))
    for child, fk, parent, pk in schemas.FOREIGN_KEYS:
        o = orphan_keys(d[child], fk, d[parent], pk).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("v"))
        parts.append(row("foreign_key", child, f"{fk}->{parent}.{pk}", o))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Publication sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


ZIPPED_ROWS = 1_000_000     # of a compressed CSV file, which one task reads whole


def write_csv(df: DataFrame, path: str, single_file: bool = False, zipped: bool = False) -> None:
    """Header CSV (the writer creates the folder, S15). ``single_file`` coalesces to one
    task and is meant for small aggregates only; large tables keep their partitioning. ``zipped`` files
    take a fifth or so of the disk; they can't be split when read, so each holds ``ZIPPED_ROWS`` rows at most."""
    out = (df.coalesce(1) if single_file else df).write
    if zipped:
        out = out.option("compression", "gzip").option("maxRecordsPerFile", ZIPPED_ROWS)
    out.mode("overwrite").option("header", True).option("quote", '"') \
       .option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Typed hand-off between stages (replaces the CSV round trip of S11)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_importances(df: DataFrame, path: str) -> None:
    """The (feature, importance) two-column table as one CSV file (one row per feature)."""
    write_csv(df.select("feature", "importance"), path, single_file=True)


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows in a stated order (a plain ``limit`` has no defined order)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)

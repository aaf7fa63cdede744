"""Reading a query result from an external SQL database, as a Spark user would.

No database is started or reached by this repository; this is the user-level
reader for deployments that keep the source tables in a database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def as_relation(query_or_table: str) -> str:
    """A table name as it is; a SELECT or WITH statement (after comments, with or without a
    final semicolon) as a derived table."""
    text = query_or_table.strip().rstrip(";").rstrip()
    words = re.sub(r"^(\s*(--[^\n]*(\n|$)|/\*.*?\*/))*", "", text, flags=re.S).lstrip().lower()
    return f"({text}\n) q" if re.match(r"(select|with)\b", words) else text


def read_jdbc(spark: SparkSession, url: str, query_or_table: str, properties: dict,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 64) -> DataFrame:
    """Parallel JDBC scan: with a numeric ``partition_column`` and bounds the read is split
    into ``num_partitions`` range queries instead of one connection reading everything."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in properties.items():
        r = r.option(k, v)
    r = r.option("dbtable", as_relation(query_or_table))
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()

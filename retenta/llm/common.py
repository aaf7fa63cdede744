"""Helpers shared by the corpus operators: tables, shared scratch tables, keys, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is used, but only with a
    local master; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="retenta-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the driver ends."""
    path = f"{shared_folder(spark)}/retenta-llm/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id written as text; null ids hash as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def text_keys(text: Column) -> list[Column]:
    """Two longs that name a text: 128 bits, so that equal keys mean equal texts at any corpus size."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("__k1"), F.xxhash64(F.lit(1), whole).alias("__k2")]


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that name a (doc_id, text) pair, nulls included."""
    pair = [F.col(doc_id), F.col(text)]
    return [F.xxhash64(*pair).alias("__k1"), F.xxhash64(F.lit(1), *pair).alias("__k2")]


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All input columns as one struct ``__row`` (so that no name clashes), beside ``columns``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *columns)


def gapless(df: DataFrame, group: str, order: list[str], out: str, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps and without one task per group.

    Rows are dealt to buckets within the group, by hash or by ``bucket``, and numbered by
    bucket, then ``order``; where ``bucket`` is a prefix of the order, just by the order. Each bucket is numbered on
    its own and shifted by the rows in the group's earlier buckets. The table of
    shifts has (groups x buckets) rows. ``order`` must name the rows uniquely
    for repeatable numbers; equal rows get adjacent numbers in either order.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(*order), F.lit(4 * shuffle_partitions(df.sparkSession)))
    dealt = df.withColumn("__b", bucket)
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (dealt.groupBy(group, "__b").agg(F.count("*").alias("__n"))
              .select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")))
    within = Window.partitionBy(group, "__b").orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (group, "__b")])
    return (dealt.withColumn("__at", F.row_number().over(within) - 1).alias("l")
            .join(shifts.alias("r"), same)
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__at") + F.col("__shift")).alias(out)))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` (cheap to count, e.g. written) with a broadcast hint if rows of about ``row_bytes`` stay under ``limit``."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df

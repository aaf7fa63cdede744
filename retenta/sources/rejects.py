"""CSV rows that don't fit the declared schema, with file, record and column (S3).

``read_csv`` stops at the first bad row, as the bulk load it stands for. To mend a
delivery one wants them all: here every record is read as text, every field is tried
against its declared type, and what fails is listed instead of raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import materialize

WHOLE = "__record"
REJECTS = "table_name string, file string, record long, column_name string, reason string, value string"


def _typed(text: Column, kind: T.DataType) -> Column:
    """The field as its declared type; null where the text isn't one."""
    if isinstance(kind, T.StringType):
        return text
    form = {T.IntegerType: r"^[+-]?[0-9]+$", T.DecimalType: r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$",
            T.TimestampNTZType: r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"}[type(kind)]
    return F.when(text.rlike(form), text.try_cast(kind))


def read_with_rejects(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``path`` that fit the schema of ``table``, typed, and one row per fault of the others:
    table_name, file, record (from 1, the header and empty lines not counted), column_name, reason, value.

    A record with a wrong number of fields is one fault (no column; the value is the record); else
    each field that isn't of its type, and each null in a column declared NOT NULL, is one. Files that can be split are split:
    a record's number is its place in the split plus the records of the file's earlier splits, a table with one row per split.
    """
    schema = schemas.SCHEMAS[table]
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(WHOLE, T.StringType())])
    raw = (spark.read.schema(as_text).option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", table in schemas.FREE_TEXT).option("nullValue", "\u0001")
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", WHOLE).csv(path))
    raw = materialize(raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                                 F.monotonically_increasing_id().alias("__at")))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (raw.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
              .select("__file", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift")))
    faults = []
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            faults.append((text.isNotNull() & _typed(text, f.dataType).isNull(), f.name, f"not of type {f.dataType.simpleString()}"))
        if not f.nullable:
            faults.append((text.isNull(), f.name, "null in a column that must not be"))
    cells = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c).alias("column_name"), F.lit(why).alias("reason"),
                                                           F.col(f"`{c}`").alias("value"))) for bad, c, why in faults]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("wrong number of fields").alias("reason"),
                             F.col(WHOLE).alias("value")))
    judged = raw.withColumn("__faults", F.when(F.col(WHOLE).isNotNull(), whole).otherwise(cells))
    good = judged.filter(F.size("__faults") == 0).select(*[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])
    rejects = (judged.filter(F.size("__faults") > 0).select("__file", "__block", "__at", F.explode("__faults").alias("x"))
               .join(splits, ["__file", "__block"])
               .select(F.lit(table).alias("table_name"), F.col("__file").alias("file"), (F.col("__at") + F.col("__shift")).alias("record"),
                       "x.column_name", "x.reason", "x.value"))
    return good, rejects


def all_rejects(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The faults of all given tables (name to path) in one table."""
    out = spark.createDataFrame([], REJECTS)
    for table, path in files.items():
        out = out.unionByName(read_with_rejects(spark, path, table)[1])
    return out

"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Each group of equal texts is one vector (bytes, tokens, rows). It goes to the
shard whose residual capacity has the highest dot product with it.

A greedy placement is sequential, so it is run at two levels, each bounded:

1. Groups above 1/256 of a shard in any measure (at most 3 * 256 * shards of
   them, by counting) are placed one by one.
2. All others are dealt by hash to cells (as many as there are shuffle
   partitions); each cell packs its own groups into a fixed number of bundles of near-equal
   vectors, and the bundles are placed like large groups.

A group above half a shard in any measure would leave no room to balance; it is
cut into pieces by row, each at most about that large. All others stay whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, shuffle_partitions, written

LARGE = 256       # a group of over 1/LARGE of a shard is placed by itself
WHOLE = 2         # a group of over 1/WHOLE of a shard is cut into pieces
BUNDLES = 4       # bundles per cell and shard
FILES = 1_000_000  # part files of one task, and runs of 2^16 rows in a file, stay under it
MEASURES = ["bytes", "tokens", "rows"]
WEIGHTS = [1.0, 0.1, 0.1]   # of the measures in the dot product: the law holds bytes near equal


def place(items: np.ndarray, capacity: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item (rows of measures): largest first, to the highest dot product with the residual.

    Measures are taken relative to ``capacity``, that of one bin, and weighted. Ties go to the smaller bin.
    """
    weights = np.array(WEIGHTS[:items.shape[1]])
    scaled = items / np.where(capacity > 0, capacity, 1.0)
    residual = np.ones((bins, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-scaled.max(axis=1, initial=0.0), kind="stable"):
        at = int(np.argmax(residual @ (weights * scaled[i])))
        residual[at] -= scaled[i]
        out[i] = at
    return out


def arrival(docs: DataFrame) -> list[Column]:
    """file, at: the order in which rows arrive, by part file and row in it as written, else by partition and row in it.

    Files are read in any order (largest first), so that their own names and row numbers are taken.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        uid = F.monotonically_increasing_id()
        return [F.shiftright(uid, 33).alias("file"), uid.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")]
    name = F.col("_metadata.file_name")

    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))

    return [(number(r"^part-(\d+)") * FILES + number(r"-c(\d+)")).cast("long").alias("file"),
            F.col("_metadata.row_index").alias("at")]


def shard(docs: DataFrame, shards: int = 16, arriving: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1; a null text counts as the empty text. Law: ``bytes``.
    Rows of equal text share a shard unless the group is over half a shard.
    slot: gapless from 0 in each shard, by hash of the row or, if ``arriving``, in the order
    in which rows arrive. Repeated rows each keep a slot; null ids
    are allowed; other columns of ``docs`` are ignored. Empty input, empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id", F.xxhash64(text).alias("key"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.size(F.split(F.trim(text), r"\s+")).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("uid"), *(arrival(docs) if arriving else [])), "shard-rows")
    group = ["key", "text_crc32", "size"]
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    capacity = [float(x or 0) / shards for x in total]

    def over(part: int):
        return F.greatest(*[F.col(m) * part / F.lit(c or 1.0) for m, c in zip(MEASURES, capacity)])

    measured = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    # Under 3 * WHOLE * shards groups are that large, whatever the input.
    cut = (rows.groupBy(*group).agg(*measured).filter(over(WHOLE) > 1)
           .select(*group, F.ceil(over(WHOLE)).alias("pieces")))
    rows = (rows.join(F.broadcast(cut), group, "left")
            .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64("uid"), F.col("pieces"))).cast("long")).drop("pieces"))
    group = [*group, "piece"]
    cells = shuffle_partitions(spark)
    parts = rows.groupBy(*group).agg(*measured).withColumn("large", over(LARGE) > 1)
    schema = "key long, text_crc32 long, size long, piece long, bytes long, tokens long, rows long, cell long, bin long"

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        vectors = cell[MEASURES].to_numpy(float)
        return cell.assign(bin=place(vectors, vectors.sum(axis=0) / (BUNDLES * shards), BUNDLES * shards))

    # Negative cells name large pieces, which are bundles of one.
    large = parts.filter("large").withColumn("cell", F.lit(-1).cast("long")).withColumn(
        "bin", F.xxhash64(*group)).drop("large")
    small = (parts.filter("not large").drop("large").withColumn("cell", F.pmod(F.xxhash64(*group), F.lit(cells)))
             .groupBy("cell").applyInPandas(pack, schema))
    packed = written(small.unionByName(large), "shard-bundles")
    bundles = packed.groupBy("cell", "bin").agg(*[F.sum(m).alias(m) for m in MEASURES])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*MEASURES, "cell", "bin"], ascending=False, kind="stable")
        pdf["shard"] = place(pdf[MEASURES].to_numpy(float), np.array(capacity), shards)
        return pdf[["cell", "bin", "shard"]]

    placed = bundles.groupBy().applyInPandas(deal, "cell long, bin long, shard int")
    homes = packed.join(placed, ["cell", "bin"]).select(*group, "shard")
    order = ["file", "at"] if arriving else ["doc_id", "uid"]
    run = (F.col("file") * FILES + F.shiftright("at", 16)) if arriving else None   # 2^16 rows of a file
    dealt = rows.join(homes, group).select("doc_id", "size", "text_crc32", "shard", *order[-2 if arriving else -1:])
    numbered = gapless(dealt, "shard", order, "slot", run)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

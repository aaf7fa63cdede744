"""What the conversation operators share: turns in order, sweeps over halved blocks, digests of joined texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

Step = Callable[..., Column]


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``at``: the row's number in its conversation, from 0.

    Rows go by turn (null first), then role, then text; equal rows are
    interchangeable. Rows without conv_id are one conversation. The rows are
    range-partitioned in that order, so a conversation of any size spans as many
    tasks as it fills; each task counts the rows of its conversations, and only
    those that began in an earlier range are shifted. At every border between
    ranges at most one conversation goes on, so there are fewer shifts than
    ranges and the table of them can be broadcast at any input size.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    head = F.substring("text", 1, 64)      # a prefix of the order: borders stay small, equal heads meet in one range
    cut = (rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", "turn", "role", head)
           .sortWithinPartitions("conv_id", "turn", "role", "text")
           .withColumn("range", F.spark_partition_id()))
    counted = written(cut.mapInArrow(_count, "conv_id long, turn long, role string, text string, range int, here long"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (counted.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
              .withColumn("shift", F.sum("n").over(earlier)).filter("shift > 0")
              .select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "shift"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))
    return (counted.join(F.broadcast(shifts), same, "left")
            .select("conv_id", "turn", "role", "text", (F.col("here") + F.coalesce("shift", F.lit(0))).alias("at")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id: each row's number among those of its conversation in this task."""
    last, n = object(), 0
    for batch in batches:
        here = []
        for c in batch.column(0).to_pylist():
            n = n + 1 if c == last else 0
            last = c
            here.append(n)
        yield batch.append_column("here", pa.array(here, pa.int64()))


def sweep(blocks: DataFrame, value: str, combine: Step, top: Step, left: Step, right: Step) -> tuple[DataFrame, DataFrame]:
    """Recursion over halves of every conversation at once, level by level.

    ``blocks`` has conv_id (not null), ``j`` (block number from 0, gapless), ``m`` (the conversation's
    number of blocks) and the column ``value``. Going up, two neighbours become
    one block of twice the height, with ``combine(l, r)`` of their values; a last
    block without neighbour keeps its value. Going down, a whole conversation
    starts with ``top(value)``, and what a block was given, ``d``, goes to its
    halves as ``left(d, l, r)`` and ``right(d, l, r)``; a block without right half
    passes ``d`` on (functions on Python workers may still be called for it, with a null ``r``). Returns (conv_id, j, given) for all blocks, and (conv_id, value) for
    whole conversations. Levels halve in size and conversations leave as soon as
    they are one block, so the work is linear; keys are (conversation, block), which at
    most two rows share.
    """
    blocks = blocks.select("conv_id", "j", "m", F.col(value).alias("value"))
    most = blocks.agg(F.max("m")).first()[0] or 1
    levels = [blocks]
    for _ in range((most - 1).bit_length()):
        odd = F.col("j") % 2 == 1
        pairs = (levels[-1].filter("m > 1").groupBy("conv_id", F.shiftright("j", 1).alias("j"))
                 .agg(F.max(F.when(~odd, F.col("value"))).alias("l"), F.max(F.when(odd, F.col("value"))).alias("r"),
                      F.max(odd).alias("two"), F.max(F.shiftright(F.col("m") + 1, 1)).alias("m")))
        levels.append(written(pairs.withColumn("value", F.when(F.col("two"), combine(F.col("l"), F.col("r"))).otherwise(F.col("l"))), "half"))
    whole = [x.filter("m = 1").select("conv_id", F.lit(0).cast("long").alias("j"), top(F.col("value")).alias("given")) for x in levels]
    given = whole[-1]
    for upper, own in zip(levels[:0:-1], whole[-2::-1]):
        parts = upper.join(given, ["conv_id", "j"])
        d, l, r = F.col("given"), F.col("l"), F.col("r")
        low = F.struct((F.col("j") * 2).alias("j"), F.when(F.col("two"), left(d, l, r)).otherwise(d).alias("given"))
        high = F.struct((F.col("j") * 2 + 1).alias("j"), right(d, l, r).alias("given"))
        halves = parts.select("conv_id", F.inline(F.when(F.col("two"), F.array(low, high)).otherwise(F.array(low))))
        given = halves.unionByName(own)
    roots = [x.filter("m = 1").select("conv_id", "value") for x in levels]
    result = roots[0]
    for x in roots[1:]:
        result = result.unionByName(x)
    return given, result


def joined_sha256(df: DataFrame, keys: list[str], order: list[str], piece: Column, separator: str, out: str) -> DataFrame:
    """``keys`` and the SHA-256 (lower-case hex) of each group's pieces, joined in ``order``; null pieces are left out.

    A digest of one string is sequential, so a group is one task's; but the
    rows stream through it from a spilling sort and only the hash state is kept, whatever the group's
    size. Null keys are groups of their own.
    """
    fields = {f.name: f for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k].dataType.simpleString()}" for k in keys] + [f"`{out}` string"])
    names = [f.split(" ")[0].strip("`") for f in schema.split(", ")]
    mark, n = separator.encode(), len(keys)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first, types = None, None, True, None
        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(n)]
            done = []
            heads = list(zip(*[batch.column(i).to_pylist() for i in range(n)]))
            for head, text in zip(heads, batch.column(n)):
                if state is None or head != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state, first = head, hashlib.sha256(), True
                if text.is_valid:
                    if not first:
                        state.update(mark)
                    state.update(text.as_buffer())
                    first = False
            yield _batch(done, types, names)
        if state is not None:
            yield _batch([(*key, state.hexdigest())], types, names)

    dealt = (df.select(*keys, *[c for c in order if c not in keys], piece.cast("binary").alias("__piece"))
             .repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "__piece"))
    return dealt.mapInArrow(hashes, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string()])], names=names)

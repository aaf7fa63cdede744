"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows are cut into blocks. With integer shares a (sum Q), block
j = 0, 1, ... of a source is released at slot floor(j Q / a) and due by slot
ceil((j + 1) Q / a). Earliest-deadline-first over the released blocks fills
every slot and meets every deadline, so that after t slots a source has had less than one
block more or less than t a / Q.

Given weights are taken as the rational numbers they stand for (0.1 is 1/10, a float next to 1/3 is 1/3)
and put over their common denominator, so the shares are the weights and nothing drifts,
however many slots there are. The default target of a source is the square root of its rows, to the nearest
integer. Only where the shares would add up to more than the longest period are they rounded to it.

The schedule repeats after Q slots. One period is run as a fold over
Q slots, which depends on the weights alone; it has one row per slot, and every block finds its slot by
an equi-join with it. Once a source has no blocks left its slots stay empty; positions
close them up by a distributed prefix sum over the blocks. Sources without weight come after all others.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import cumulative_sums
from .common import gapless, packed, shuffle_partitions, written

PERIOD = 1 << 16   # most slots in a period
WORK = 1 << 24     # most slots x sources in a period's fold
BLOCK_ROWS = 16    # rows in a block
EXPONENT = 0.5     # default weights: rows of the source to this power
RUN = 1 << 12      # slots that are folded, and blocks that are listed, at a time


def exact_shares(weights: dict, period: int = PERIOD) -> dict:
    """Integer shares in proportion to the weights: over their common denominator where they add up to at most ``period``, else
    rounded to parts of ``period`` (1 at least). Weights that are negative or not finite are an error; zero stays zero."""
    for name, w in weights.items():
        if not math.isfinite(w) or w < 0:
            raise ValueError(f"weight of {name!r}: {w}")
    exact = {name: Fraction(w).limit_denominator(10**9) for name, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()]) if exact else 1
    whole = {name: int(w * unit) for name, w in exact.items()}
    common = math.gcd(*whole.values()) or 1
    total = sum(whole.values()) // common
    if total <= period:
        return {name: w // common for name, w in whole.items()}
    return {name: max(1, round(Fraction(w, common) * period / total)) if w else 0 for name, w in whole.items()}


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """``sizes`` (source, n) with ``a`` (share of a period) and ``s`` (0, 1, ... by source, null first).

    Without ``weights`` the target is n ** EXPONENT to the nearest integer. A source that ``weights``
    doesn't name has no share.
    """
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(EXPONENT)))
    else:
        given = sizes.sparkSession.createDataFrame([(name, float(a)) for name, a in exact_shares(weights, period).items()], "named string, w double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    # One row per source; all of them are gathered in one array, as the fold needs.
    gathered = weighted.agg(F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("all"))
    gathered = gathered.withColumn("sum", F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["w"]))
    most = F.least(F.lit(float(period)), F.lit(float(WORK)) / F.size("all"))
    gathered = gathered.withColumn("scale", F.when(F.col("sum") > most, most / F.col("sum")).otherwise(F.lit(1.0)))
    return gathered.select("scale", F.posexplode("all").alias("s", "x")).select(
        "s", F.col("x.source").alias("source"), F.col("x.n").alias("n"),
        F.when(F.col("x.w") > 0, F.greatest(F.lit(1), F.floor(F.col("x.w") * F.col("scale") + 0.5))).otherwise(0).cast("int").alias("a"))


def schedule(shared: DataFrame) -> DataFrame:
    """One period of earliest-deadline-first: s, k (block within the period), r (its slot), q; one row per slot."""
    sources = shared.filter("a > 0").agg(F.array_sort(F.collect_list(F.struct("s", "a"))).alias("src"))
    sources = sources.withColumn("q", F.aggregate("src", F.lit(0), lambda acc, x: acc + x["a"]))
    q = F.col("q")

    def slot(state: Column, t: Column) -> Column:
        # (deadline, place in src) of the released blocks; each source has one candidate
        due = F.transform(state["had"], lambda c, i: F.when(
            F.floor(c.cast("long") * q / F.col("src")[i]["a"]) <= t,
            F.struct(F.ceil((c.cast("long") + 1) * q / F.col("src")[i]["a"]).cast("long").alias("due"), i.alias("i"))))

        def taken(first: Column) -> Column:
            return F.struct(F.transform(state["had"], lambda c, i: c + F.when(i == first, 1).otherwise(0)).alias("had"),
                            F.concat(state["out"], F.array(F.struct(first.alias("i"), state["had"][first].alias("k")))).alias("out"))

        # in an array of one, the minimum is found once and not for every source again
        return F.element_at(F.transform(F.array(F.array_min(due)["i"]), taken), 1)

    empty = F.expr("cast(array() as array<struct<i:int,k:int>>)")

    def run(state: Column, begin: Column) -> Column:
        # short arrays grow slot by slot, the long one run by run
        part = F.aggregate(F.sequence(begin, F.least(begin + RUN, q) - 1), F.struct(state["had"].alias("had"), empty.alias("out")), slot)
        return F.struct(part["had"].alias("had"), F.concat(state["runs"], F.array(part["out"])).alias("runs"))

    start = F.struct(F.transform("src", lambda x: F.lit(0)).alias("had"), F.expr("cast(array() as array<array<struct<i:int,k:int>>>)").alias("runs"))
    slots = sources.filter("q > 0").select("src", "q", F.posexplode(F.flatten(
        F.aggregate(F.sequence(F.lit(0), q - 1, F.lit(RUN)), start, run, lambda st: st["runs"]))).alias("r", "x"))
    return slots.select(F.col("src")[F.col("x.i")]["s"].alias("s"), F.col("x.k").alias("k"), "r", "q")


def _placed(docs: DataFrame, weights: dict[str, float] | None, period: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with s, nth (number in the source), block and slot; the sources' shares; the period's slots."""
    keyed = packed(docs, F.col("source").alias("source"), F.col("doc_id").alias("doc_id"),
                   F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("at"))
    # Null and text sources are told apart by s, which is what rows are numbered in.
    shared = written(shares(docs.groupBy("source").agg(F.count("*").alias("n")), weights, period), "mix-shares")
    plan = written(schedule(shared), "mix-period")
    named = F.broadcast(shared.select("s", "a", F.col("source").alias("named")))   # one row per source
    ranked = gapless(keyed.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named"), "s", ["at", "doc_id"], "nth",
                     F.substring("at", 1, 3))
    blocks = ranked.withColumn("block", F.floor(F.col("nth") / block_rows).cast("long"))
    return _slotted(blocks, plan), shared, plan


def _slotted(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (s, a, block) with their slot; null where the source has no share. ``plan``: at most PERIOD rows, by construction."""
    k = blocks.withColumn("k", F.when(F.col("a") > 0, F.pmod(F.col("block"), F.greatest("a", F.lit(1)))).cast("int"))
    turn = F.floor(F.col("block") / F.greatest("a", F.lit(1))).cast("long")
    return (k.join(F.broadcast(plan), ["s", "k"], "left")
            .withColumn("slot", turn * F.col("q") + F.col("r")).drop("k", "r"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (doc_id, source, any others) as struct ``__row`` beside block, slot, release, deadline, position.

    Every row is kept once. ``position`` is gapless from 0, by slot; rows of sources without weight come last, by
    source, and have no slot, release and deadline. Within a source, rows
    go by md5 of doc_id, then doc_id; repeated rows get positions side by side. A null
    source is a source of its own, null ids hash as the empty text. Empty input, empty result.
    """
    rows, shared, plan = _placed(docs, weights, period, block_rows)
    # every block once, from the sources' sizes: in runs first, so that a large source's blocks are listed by many tasks
    count = F.ceil(F.col("n") / block_rows).cast("long")
    runs = shared.select("s", "a", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / RUN))).alias("run"))
    listed = runs.repartition(shuffle_partitions(docs.sparkSession), "s", "run").select(
        "s", "a", "n", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, count) - 1)).alias("block"))
    sized = _slotted(listed, plan).withColumn("rows", F.least(F.lit(block_rows), F.col("n") - F.col("block") * block_rows).cast("long"))
    order = F.struct(F.col("slot").isNull().alias("last"), "slot", "s", "block").alias("order")
    before = cumulative_sums(sized.select("s", "block", "rows", order), "order", ["rows"], descending=False).select(
        "s", "block", (F.col("cum_rows") - F.col("rows")).alias("before"))
    share = F.when(F.col("a") > 0, F.col("a"))
    return rows.join(before, ["s", "block"]).select(
        "__row", "doc_id", "source", "block", "slot",
        F.floor(F.col("block") * F.col("q") / share).cast("long").alias("release"),
        F.ceil((F.col("block") + 1) * F.col("q") / share).cast("long").alias("deadline"),
        (F.col("before") + F.col("nth") % block_rows).cast("long").alias("position"))


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with its own columns in the mixed order: partitions (and files written of them) are successive ranges of slots, sorted."""
    rows, _, _ = _placed(docs, weights, period, block_rows)
    order = [F.col("slot").asc_nulls_last(), F.col("s"), F.col("nth")]
    return rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("__row.*")

"""Values at given ranks of a few groups by narrowing histograms: no sort, no shuffle of rows.

A pass counts the rows of every open interval by ``bins`` equal steps and keeps each step's
smallest and largest value; the step that holds a rank is the next pass's interval. A
step of one value, or of at most ``bins`` rows, ends it. Each pass is one aggregate
with map-side combining over (group, value); the driver gets at most ``bins`` rows for an open rank.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
_MOST = sys.float_info.max


def _order(value):
    """Spark's order of numbers: NaN is greatest."""
    nan = isinstance(value, float) and math.isnan(value)
    return nan, 0 if nan else value


def _half(value) -> float:
    """A finite half, so that differences of halves are finite too."""
    return (_MOST if math.isnan(float(value)) else min(max(float(value), -_MOST), _MOST)) * 0.5


def _step(v, lo, hi, bins: int):
    """The number of the step between ``lo`` and ``hi`` that holds ``v``: rising with v, first for lo, last for hi."""
    low, high = _half(lo), _half(hi)
    x = v.cast("double")
    at = F.floor((x * 0.5 - F.lit(low)) / F.lit(high - low) * bins)
    at = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -1).otherwise(at))


def values_at_ranks(df: DataFrame, ranks, value: str = "_v", group: str = "_g", bins: int = BINS) -> dict:
    """{(group, k): (value, below, n)} for each 0-based rank k in ``ranks(group, rows)``, an iterable of them.

    The value at rank k among the group's non-null values (``value``: whole numbers or doubles), the rows with a
    smaller value and the rows with this one. Ranks out of range are left out. Groups
    (null is one) must be few. ``df`` is read once a pass: write it first where it is costly.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    kind = rows.schema["_v"].dataType
    held = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
    found, open_ = {}, defaultdict(list)         # (group, lo, hi, below, n): ranks
    for r in held:
        for k in ranks(r["_g"], r["n"]):
            if 0 <= k < r["n"]:
                open_[r["_g"], r["lo"], r["hi"], 0, r["n"]].append(k)
    while open_:
        slots = []
        for (g, lo, hi, below, n), ks in open_.items():
            if _order(lo) == _order(hi):
                found.update({(g, k): (lo, below, n) for k in ks})
            else:
                slots.append((g, lo, hi, below, n, ks))
        open_ = defaultdict(list)
        if not slots:
            break
        v = F.col("_v")
        slot = step = F.lit(None).cast("int")
        single = none = F.lit(None).cast(kind)
        for i, (g, lo, hi, _, n, _) in enumerate(slots):
            inside = F.col("_g").eqNullSafe(F.lit(g)) & (v >= F.lit(lo)) & (v <= F.lit(hi))
            slot = F.when(inside, F.lit(i)).otherwise(slot)
            each = n <= bins or _half(lo) == _half(hi)
            step = F.when(inside, F.lit(0) if each else _step(v, lo, hi, bins)).otherwise(step)
            single = F.when(inside, v if each else none).otherwise(single)
        counted = (rows.select(slot.alias("slot"), step.alias("step"), single.alias("single"), "_v").filter("slot is not null")
                   .groupBy("slot", "step", "single").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
        steps = defaultdict(list)
        for r in counted.collect():
            steps[r["slot"]].append((_order(r["lo"]), r["lo"], r["hi"], r["n"]))
        for i, (g, _, _, below, _, ks) in enumerate(slots):
            wanted = sorted(ks)
            for _, lo, hi, n in sorted(steps[i], key=lambda s: s[0]):
                while wanted and wanted[0] < below + n:
                    open_[g, lo, hi, below, n].append(wanted.pop(0))
                below += n
    return found


def median_values(df: DataFrame, columns: list[str]) -> dict:
    """{column: interpolated median (mean of the two middle values, nulls skipped), or None without values}."""
    pairs = [F.struct(F.lit(c).alias("_g"), F.col(c).cast("double").alias("_v")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    found = defaultdict(list)
    for (c, _), (v, _, _) in values_at_ranks(long, lambda c, n: {(n - 1) // 2, n // 2}).items():
        found[c].append(v)
    return {c: (min(found[c], key=_order) + max(found[c], key=_order)) / 2 if c in found else None for c in columns}

"""Repair of conversation structure as a lightest derivation.

A conversation is well formed when its roles' initials match ``(s?(ua)+)?``.
Reading it from the left, a grammar state is what came last: nothing, a system turn, a user
turn, an assistant turn. An item (row, state) says that the rows so far can be
edited into turns that end in that state. Each edit is a deduction from one
item to another with a cost; values are (cost, audit), the audit being the
edits' initials, and an agenda pops items by (cost, rows used, audit). Every
deduction raises the cost or uses a row, and the order of two audits of
equal cost over the same rows is decided before either ends, so appending keeps
it: the functions are monotone and superior, and an item's first pop is final (Knuth 1977).

A long conversation is cut into segments of ``SEGMENT`` rows. The agenda gives each
segment's lightest derivations from every state to every state; two neighbours
join by a deduction with two premises (sum of costs, audits joined), level by level, and going back down
each segment learns the two states that it runs between.

Faults: blank (no character but white space), duplicate (role and text seen
earlier), truncated (last such character not ``.``, ``!`` or ``?``); the first
that holds counts. Blank and duplicate rows must be deleted; a truncated row that stays adds 5.

Nulls: null role or text is one space, for damage a null turn or conv_id too; null turns come first
and a null conv_id is a conversation of its own. Equal turns go by role, then
text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .turns import in_order, joined_sha256, sweep

#: Rows of a segment.
SEGMENT = 64
#: Costs of the edits; a truncated row that stays costs CUT more.
RETAG, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Grammar states by what came last, the role each state wants next, and where a turn's initial leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WELL_FORMED = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
TABLE = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()),
                                  T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
EDITS = T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("op", T.StringType()),
                                  T.StructField("role", T.StringType())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20; equal rows stay adjacent in turn order."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array_repeat(F.lit(0), 1))
    return (rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
            .drop("copy"))


def diagnosed(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text, at) with ``fault``: blank, duplicate, truncated or null."""
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    same = [F.xxhash64(F.lit(i), "role", "text").alias(f"k{i}") for i in (1, 2)]
    rows = written(turns.select("*", shown.alias("shown"), *same), "repair-rows")
    firsts = (rows.groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("first"))
              .select(F.col("conv_id").alias("c"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first"))
    known = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
    fault = (F.when(F.col("shown") == "", "blank").when(F.col("at") > F.col("first"), "duplicate")
             .when(~F.substring(F.col("shown"), -1, 1).isin(".", "!", "?"), "truncated"))
    return rows.join(firsts, known).select("conv_id", "turn", "role", "text", "at", fault.alias("fault"))


@lru_cache(maxsize=1 << 14)
def derivations(kinds: str, faults: str, start: int) -> dict[int, tuple[int, str]]:
    """The agenda: for each state, the lightest (cost, audit) from ``start`` through all rows.

    ``kinds`` has a row's initial (s, u, a or x for any other), ``faults`` ``d``
    for a row that must go, ``t`` for a truncated one, else ``.``.
    """
    done: dict[tuple[int, int], tuple[int, str]] = {}
    agenda = [(0, 0, "", start)]
    while agenda:
        cost, used, audit, state = heapq.heappop(agenda)
        if (used, state) in done:
            continue
        done[used, state] = cost, audit
        want = WANTED[state]
        heapq.heappush(agenda, (cost + INSERT, used, audit + "I", NEXT[state, want]))
        if used == len(kinds):
            if len([1 for u, _ in done if u == used]) == 4:
                break
            continue
        kind, fault = kinds[used], faults[used]
        heapq.heappush(agenda, (cost + DELETE, used + 1, audit + "D", state))
        if fault != "d":
            stays = cost + (CUT if fault == "t" else 0)
            heapq.heappush(agenda, (stays + RETAG, used + 1, audit + "R", NEXT[state, want]))
            if (state, kind) in NEXT:
                heapq.heappush(agenda, (stays, used + 1, audit + "K", NEXT[state, kind]))
    return {state: value for (used, state), value in done.items() if used == len(kinds)}


def joined(left: list, right: list) -> dict[tuple[int, int], tuple[int, str, int]]:
    """The deduction with two premises: (p, q) to the lightest (cost, audit, state between); without ``right``, none."""
    best: dict[tuple[int, int], tuple[int, str, int]] = {}
    if right is None:
        return best
    for a in left:
        for b in right:
            if a["q"] == b["p"]:
                value = int(a["cost"] + b["cost"]), a["audit"] + b["audit"], int(a["q"])
                key = int(a["p"]), int(b["q"])
                if key not in best or value < best[key]:
                    best[key] = value
    return best


def rewritten(kinds: str, faults: str, start: int, end: int) -> list[tuple[int, str, str | None]]:
    """The edits of one segment between two states: (row or -1, initial, new role or None)."""
    edits, state, row = [], start, 0
    for op in derivations(kinds, faults, start)[end][1]:
        want = WANTED[state]
        edits.append((-1 if op == "I" else row, op, ROLES[want] if op in "IR" else None))
        if op != "D":
            state = NEXT[state, kinds[row] if op == "K" else want]
        row += op != "I"
    return edits


@F.pandas_udf(TABLE)
def _tables(kinds: pd.Series, faults: pd.Series) -> pd.Series:
    return pd.Series([[{"p": p, "q": q, "cost": c, "audit": a} for p in range(4) for q, (c, a) in sorted(derivations(k, f, p).items())]
                      for k, f in zip(kinds, faults)])


@F.pandas_udf(TABLE)
def _join(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a, _) in sorted(joined(x, y).items())]
                      for x, y in zip(left, right)])


@F.pandas_udf(T.IntegerType())
def _between(given: pd.DataFrame, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([joined(x, y).get((p, q), (0, "", 0))[2] for p, q, x, y in zip(given["p"], given["q"], left, right)], dtype="int32")


@F.pandas_udf(EDITS)
def _rewrite(kinds: pd.Series, faults: pd.Series, given: pd.DataFrame) -> pd.Series:
    return pd.Series([[{"row": r, "op": o, "role": new} for r, o, new in rewritten(k, f, p, q)]
                      for k, f, p, q in zip(kinds, faults, given["p"], given["q"])])


def _goal(table: Column) -> Column:
    """The lightest well-formed derivation of a whole conversation."""
    fit = F.filter(table, lambda x: (x["p"] == NOTHING) & x["q"].isin(*WELL_FORMED))
    return F.array_min(F.transform(fit, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), x["q"].alias("q"))))


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For diagnosed turns: (conv_id, cost, audit), the repaired turns (conv_id, seg, step, role, text), ordered by
    seg and step, and the segments (conv_id, seg, kinds) with the rows' initials."""
    turns = written(turns, "repair-turns")
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    code = (F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("."))
    ids = written(turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n")).withColumn("key", F.struct("conv_id")), "repair-ids")
    cells = turns.select("conv_id", F.expr(f"at div {segment}").alias("seg"), F.struct("at", kind.alias("k"), code.alias("f")).alias("x"))
    segs = cells.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("x")).alias("x"))
    segs = segs.select("conv_id", "seg", F.array_join("x.k", "").alias("kinds"), F.array_join("x.f", "").alias("faults"))
    segs = segs.alias("s").join(ids.alias("i"), F.col("s.conv_id").eqNullSafe(F.col("i.conv_id"))).select(
        "i.key", F.col("s.conv_id").alias("conv_id"), "seg", "kinds", "faults", F.expr(f"(n - 1) div {segment} + 1").alias("m"))
    segs = written(segs.withColumn("table", _tables("kinds", "faults")), "repair-segments")
    blocks = segs.select(F.col("key").alias("conv_id"), F.col("seg").alias("j"), "m", "table")   # a struct key is never null
    state = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    given, roots = sweep(blocks, "table", combine=_join, top=lambda v: state(F.lit(NOTHING), _goal(v)["q"]),
                         left=lambda d, l, r: state(d["p"], _between(d, l, r)), right=lambda d, l, r: state(_between(d, l, r), d["q"]))
    costs = roots.select("conv_id.conv_id", _goal(F.col("value")).alias("goal")).select("conv_id", "goal.cost", "goal.audit")
    runs = segs.join(given.select(F.col("conv_id").alias("key"), F.col("j").alias("seg"), "given"), ["key", "seg"])
    edits = written(runs.select("conv_id", "seg", F.posexplode(_rewrite("kinds", "faults", "given")).alias("step", "e"))
                    .select("conv_id", "seg", "step", (F.col("seg") * segment + F.col("e.row")).alias("row"), "e.op", "e.role"), "repair-edits")
    kept = edits.filter("op in ('K', 'R')").alias("e").join(
        turns.alias("t"), F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("e.row") == F.col("t.at")))
    kept = kept.select("e.conv_id", "e.seg", "e.step", F.coalesce("e.role", "t.role").alias("role"), "t.text")
    new = edits.filter("op = 'I'").select("conv_id", "seg", "step", "role", F.lit("").alias("text"))
    return costs, kept.unionByName(new), segs.select("conv_id", "seg", "kinds")


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per original conversation: what the damage left, the lightest repair and a digest of its result."""
    turns = written(diagnosed(in_order(damaged(conversations))), "repair-diagnosed")
    costs, repaired, segs = repair(turns, segment)
    found = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # pairs of neighbours: all but those that are legal, within segments and across their borders
    legal = "s(?=u)|u(?=a)|a(?=u)"
    inside = segs.select("conv_id", (F.length("kinds") - 1 - F.regexp_count("kinds", F.lit(legal))).alias("illegal"))
    nxt = segs.select(F.col("conv_id").alias("c"), (F.col("seg") - 1).alias("before"), F.substring("kinds", 1, 1).alias("head"))
    border = segs.join(nxt, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("before"))).select(
        "conv_id", (~F.concat(F.substring("kinds", -1, 1), "head").isin("su", "ua", "au")).cast("int").alias("illegal"))
    illegal = inside.unionByName(border).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    digest = joined_sha256(repaired, ["conv_id"], ["seg", "step"], F.concat("role", F.lit(":"), "text"), "\n", "repaired_sha256")
    out = conversations.select("conv_id").distinct()
    for part in (found, illegal, costs, digest):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

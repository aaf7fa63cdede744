"""The trie of all conversation prefixes, by recursion on half the depth.

Every conversation is a path of turns. A piece of ``2 h`` turns is cut at half
its height: the prefix up to the cut gets a name, the turns above the cut
belong to the upper trie, those below to a forest whose trees hang from cut
names. Both halves are cut again, all pieces of one height in one job, until
pieces of ``LEAF`` turns are left. A name is made from the name at the piece's
top and a digest of the turns down to the cut, so equal prefixes get equal
names without meeting in a task, and no conversation is ever one row.

Totals are grafted upward over the same halves: what a lower piece sums up is
added to all that hangs above it, first piece by piece, then from the whole
conversation back to its pieces; a node's total is the sum over the paths that pass it.

Nulls: null role or text is empty; rows without conv_id belong to no
conversation. Equal turn numbers go by role, then text; repeated rows are turns of
their own. An empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .turns import in_order, joined_sha256, sweep

#: Turns of a piece that isn't cut any more.
LEAF = 4
#: Members' ids are joined in runs of 2^ID_BITS values before they are hashed.
ID_BITS = 12
NODE = ["depth", "a", "b"]


def spliced(conversations: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of conversation c - c % family.

    h is crc32(decimal c) % heads; an absent conversation gives none, a short one all it has. Returns the turns (conv_id, at,
    role, text) and the conversations (conv_id, n turns), those without any turn included. At most
    ``heads - 1`` turns of a conversation are handed on, to less than ``2 family`` others.
    """
    own = in_order(conversations.filter("conv_id is not null")).select(
        "conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = written(own.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    of = F.col("conv_id") - F.col("conv_id") % family
    plan = sizes.select("conv_id", "n", of.alias("of"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    there = sizes.select(F.col("conv_id").alias("of"), F.col("n").alias("there"))
    plan = written(plan.join(there, "of", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "plan")
    lent = (own.filter(F.col("at") < heads - 1).withColumnRenamed("conv_id", "of")
            .join(plan.select("conv_id", "of", "h"), "of").filter("at < h").select("conv_id", "at", "role", "text"))
    rest = (own.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("at >= h")
            .select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "role", "text"))
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return lent.unionByName(rest), lengths


def _pair(*parts: Column) -> Column:
    """128 bits that name the parts."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _after(name: Column, way: Column) -> Column:
    return _pair(name["a"], name["b"], way["a"], way["b"])


def named_prefixes(turns: DataFrame, lengths: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per conversation and prefix (conv_id, at = its length, a, b = its name, bytes of its
    last text, ends = it is the whole conversation). ``turns``: conv_id, at, role, text; ``lengths``: conv_id, n."""
    leave = turns.select("conv_id", "at", _pair(F.col("role"), F.col("text")).alias("turn"), F.lit(None).cast("long").alias("bytes"))
    none = F.lit(None).cast("struct<a:bigint,b:bigint>").alias("turn")
    reach = turns.select("conv_id", (F.col("at") + 1).alias("at"), none, F.octet_length("text").cast("long").alias("bytes"))
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("at"), none, F.lit(0).cast("long").alias("bytes"))
    steps = leave.unionByName(reach).unionByName(root).groupBy("conv_id", "at").agg(F.max("turn").alias("turn"), F.max("bytes").alias("bytes"))
    step = F.struct("at", "turn", "bytes")
    pieces = (steps.groupBy("conv_id", F.expr(f"at div {leaf}").alias("j")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
              .join(lengths, "conv_id"))
    # ways[i]: the digest of the piece's first i turns
    start = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    ways = F.aggregate("steps", start, lambda acc, s: F.when(s["turn"].isNull(), acc).otherwise(
        F.concat(acc, F.array(_after(F.element_at(acc, -1), s["turn"])))))
    pieces = written(pieces.withColumn("ways", ways).withColumn("m", F.expr(f"n div {leaf} + 1")), "pieces")
    whole = pieces.withColumn("way", F.element_at("ways", -1))
    given, _ = sweep(whole, "way", combine=_after, top=lambda v: F.element_at(start, 1),
                     left=lambda d, l, r: d, right=lambda d, l, r: _after(d, l))
    prefix = F.posexplode("steps").alias("i", "s")
    rows = pieces.join(given, ["conv_id", "j"]).select("conv_id", "n", "given", "ways", prefix)
    name = F.when(F.col("i") == 0, F.col("given")).otherwise(_after(F.col("given"), F.col("ways")[F.col("i")]))
    return written(rows.select("conv_id", F.col("s.at").alias("at"), name.alias("name"), F.coalesce("s.bytes", F.lit(0)).alias("bytes"),
                               (F.col("s.at") == F.col("n")).alias("ends"))
                   .select("conv_id", F.col("at").alias("depth"), "name.a", "name.b", "bytes", "ends"), "prefixes")


def grafted(prefixes: DataFrame, weights: DataFrame, lengths: DataFrame, values: list[str], leaf: int = LEAF) -> DataFrame:
    """Each node's ``values`` summed over its subtree.

    ``weights`` has every node once, at (conv_id, depth) of its smallest member. Each
    conversation's path sums what lies at or below a depth; a node's members together hold every node below it exactly once.
    """
    own = prefixes.select("conv_id", *NODE).join(weights, ["conv_id", "depth"], "left")
    cell = F.struct("depth", "a", "b", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
    total = F.struct(*[F.sum(F.coalesce(v, F.lit(0))).alias(v) for v in values])
    pieces = written(own.groupBy("conv_id", F.expr(f"depth div {leaf}").alias("j"))
                     .agg(F.array_sort(F.collect_list(cell)).alias("cells"), total.alias("sum"))
                     .join(lengths, "conv_id").withColumn("m", F.expr(f"n div {leaf} + 1")), "graft")

    def add(x: Column, y: Column) -> Column:
        return F.struct(*[(x[v] + y[v]).alias(v) for v in values])

    nothing = F.struct(*[F.lit(0).cast("long").alias(v) for v in values])
    below, _ = sweep(pieces, "sum", combine=add, top=lambda v: nothing, left=lambda d, l, r: add(d, r), right=lambda d, l, r: d)
    cells = (pieces.join(below, ["conv_id", "j"])
             .select("given", F.posexplode("cells").alias("i", "x"), "cells"))

    def from_here(v: str) -> Column:
        here = F.slice(F.col("cells"), F.col("i") + 1, F.lit(leaf))
        return (F.aggregate(here, F.lit(0).cast("long"), lambda t, y: t + y[v]) + F.col("given")[v]).alias(v)

    sums = cells.select("x.depth", "x.a", "x.b", *[from_here(v) for v in values])
    return sums.groupBy(*NODE).agg(*[F.sum(v).alias(v) for v in values])


def trie(turns: DataFrame, lengths: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    lengths = written(lengths, "lengths")
    prefixes = named_prefixes(turns, lengths, leaf)
    nodes = written(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                                F.max("bytes").alias("bytes")), "nodes")
    # the parent's name, read one turn up on the path of the smallest member
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    edges = written(nodes.join(above, ["conv_id", "depth"]).select(*NODE, "pa", "pb"), "edges")
    children = edges.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    parent = edges.join(parents, ["depth", "pa", "pb"], "left").select(*NODE, "parent_conv_id")
    weights = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = grafted(prefixes, weights, lengths, ["n_leaves", "saved_tokens"], leaf)
    run = F.shiftright("conv_id", ID_BITS).alias("run")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = prefixes.filter("ends").groupBy(*NODE, run).agg(ids.alias("ids"))
    digests = joined_sha256(runs, NODE, ["run"], F.col("ids"), ",", "ends_sha256")
    return (nodes.join(parent, NODE, "left").join(totals, NODE).join(digests, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The trie of the spliced conversations."""
    return trie(*spliced(conversations), leaf)

"""SimHash near-duplicate detection with BK-trees.

Fingerprints within r bits agree on at least one of r + 1 bands of their bits.
Rows of one band value form a shard; its BK-tree (children keyed by their
integer Hamming distance to the parent) is grown in the task that holds the
shard, and every fingerprint is searched in it before it is added, following
only edges within r of its distance. A shard thus gets just the fingerprints
that can link to its own, which a broadcast of all trees would not bound.

A shard of over ``SHARD`` fingerprints is dealt again by bands of its other
bits: two of its members differ in r bits of those at most, so no link is lost.
Trees emit links that join two so far unjoined parts: under one per member, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, row_keys, written
from .components import components

SHINGLE = 3
RADIUS = 2
SHARD = 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = min(shingle, n) - 1
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(line[a:b], seed) for a, b in zip(starts, ends[last:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):   # bounded memory for very long texts
        block = h[part:part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct fingerprints; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.root = None

    def search(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
        return found

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        value, children = self.root
        while d := (value ^ fp).bit_count():
            if d not in children:
                children[d] = (fp, {})
                return
            value, children = children[d]


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, parts)]


def _masked(bits: list[int]):
    mask = sum(1 << int(b) for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _spread(df: DataFrame, keyed) -> DataFrame:
    return df.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), *v) for i, v in enumerate(keyed)])).alias("x")).select("fp", "x.*")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links among the distinct ``fps`` (fp long) that connect all that are within ``radius`` bits."""
    bands = _bands(list(range(64)), radius + 1)
    rows = _spread(fps, [[_masked(b).alias("v1")] for b in bands])
    key = ["band", "v1"]
    counted = rows.join(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), key)
    large = counted.filter(F.col("n") > shard)
    inner = []
    for i, band in enumerate(bands):
        rest = [b for b in range(64) if b not in band]
        inner += [(i, j, _masked(sub)) for j, sub in enumerate(_bands(rest, radius + 1))]
    again = (large.select("fp", "band", "v1", F.explode(F.array(*[
        F.struct(F.lit(i).alias("of"), F.lit(j).alias("sub"), v.alias("v2")) for i, j, v in inner])).alias("x"))
        .filter("x.of = band").select("fp", "band", "v1", "x.sub", "x.v2"))
    again = again.join(again.groupBy("band", "v1", "sub", "v2").agg(F.count("*").alias("m")).filter("m > 1").drop("m"),
                       ["band", "v1", "sub", "v2"])
    whole = counted.filter(F.col("n") <= shard).select(
        "fp", "band", "v1", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("v2"))
    key = ["band", "v1", "sub", "v2"]
    shards = whole.unionByName(again).repartition(*key).sortWithinPartitions(*key, "fp")

    def grow(batches):
        at, tree, parent = None, None, {}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for pdf in batches:
            a, b = [], []
            for *shard_key, fp in zip(*[pdf[c].tolist() for c in [*key, "fp"]]):
                if shard_key != at:
                    at, tree, parent = shard_key, BKTree(), {}
                parent[fp] = fp
                for near in tree.search(fp & (1 << 64) - 1, radius):
                    near = near - (1 << 64) if near >> 63 else near
                    if (x := top(fp)) != (y := top(near)):
                        parent[x] = y
                        a.append(fp)
                        b.append(near)
                tree.add(fp & (1 << 64) - 1)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return shards.select(*key, "fp").mapInPandas(grow, "a long, b long").distinct()


def _named(docs: DataFrame, shingle: int, radius: int, shard: int, *keys) -> DataFrame:
    """doc_id, keys, fp and component_id of each row."""
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    rows = written(docs.select("doc_id", *keys, hashed("text").alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), radius, shard))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(names.select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id
    reachable (null only if all its ids are). A null, empty or blank text has
    fingerprint zero, linked like any other. Repeated rows are kept; other columns are ignored.
    """
    return _named(docs, shingle, radius, shard).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``docs`` with its own columns: of each component one row, that of the smallest doc_id.

    Null ids come last; rows of one id go by a hash of their text, repeated rows count as one.
    """
    rows = _named(docs, shingle, radius, shard, *row_keys())
    heads = (rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2")).alias("h"))
             .select("h.__k1", "h.__k2"))
    kept = packed(docs, *row_keys()).join(heads, ["__k1", "__k2"])
    return kept.dropDuplicates(["__k1", "__k2"]).select("__row.*")

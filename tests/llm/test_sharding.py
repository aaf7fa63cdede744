import collections
import random
import zlib

from pyspark.sql import functions as F

from retenta.llm import sharding


def check(df, shards=16, near=0.1):
    got = sharding.shard(df, shards).collect()
    data = df.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in data)
    slots = collections.defaultdict(list)
    total = collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    assert max(total.values()) <= (1 + near) * mean and min(total[s] for s in range(shards)) >= (1 - near) * mean
    return got


def test_balanced_with_a_hot_group(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 400)) for i in range(1200)] + [(2000 + i, "copy of one text " * 20) for i in range(800)]
    rows += [(5000, None), (5001, ""), (None, "no id"), (None, None)] + [(7, "same row")] * 30
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot long")
    got = check(df)
    # groups that are small enough stay together
    homes = collections.defaultdict(set)
    for r in got:
        if r["size"] == len("same row") + 1:
            homes[r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_one_group_only(spark):
    df = spark.range(640).select(F.col("id").alias("doc_id"), F.lit("all alike").alias("text"))
    check(df, near=0.5)


def test_place_uses_the_dot_product():
    import numpy as np
    items = np.array([[4.0, 0], [0, 4], [3, 0], [0, 3]])
    assert sharding.place(items, np.array([4.0, 4.0]), 2).tolist() == [0, 0, 1, 1]


def test_empty(none):
    assert sharding.shard(none).count() == 0

import collections
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from retenta.llm import decontam, mixing, quality, simhash
from retenta.llm.common import table
from retenta.llm.registry import ORACLES, QUERIES
from .conftest import rows
from .test_mixing import brute

SF = "/root/testdata/sf0.001"


def test_stages_match_their_operators_one_by_one(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "near_dedup", "decontaminate", "mix", "shard"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        results.append(kept)
    ids = [sorted(d for (d,) in rows(r, "doc_id")) for r in results]
    good = [d for d, p in rows(quality.classify(docs, table(spark, SF, "labels")), "doc_id", "predicted") if p]
    assert ids[0] == sorted(good)
    first = docs.filter(docs["doc_id"].isin(good))
    assert ids[1] == sorted({c for _, c in rows(simhash.near_duplicates(first), "doc_id", "component_id")})
    second = docs.filter(docs["doc_id"].isin(ids[1]))
    assert ids[2] == sorted(d for d, c in rows(decontam.decontaminate(second, table(spark, SF, "benchmark")), "doc_id", "contaminated") if not c)
    assert ids[3] == ids[4] == ids[2]
    assert all(r.columns == docs.columns for r in results[:4])


def test_run_writes_between_stages(spark):
    got = rows(corpus_pipeline.run(spark, SF), "doc_id", "shard", "slot")
    assert got and len({(s, n) for _, s, n in got}) == len(got)


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    def clean(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    theirs = [tuple(clean(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()]
    assert rows(df, *columns) == sorted(theirs, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("through_files", [True, False])
def test_slots_of_a_shard_follow_the_mixed_order(spark, tmp_path, through_files):
    """Against the order of a slot-by-slot simulation, from written files (which Spark reads largest first) and directly."""
    sizes = {"hot": 2500, "b": 400, None: 300, "c": 100}
    data = [(i, s, f"text {i} " + "long " * ((i * 7919) % 60)) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(data, "doc_id long, source string, text string").repartition(5), SF)
    if through_files:
        mixed.write.parquet(str(tmp_path / "mixed"))
        mixed = spark.read.parquet(str(tmp_path / "mixed"))
    a = {s: int(n ** 0.5 + 0.5) for s, n in sizes.items()}
    q, slots = brute(sizes, a, mixing.BLOCK_ROWS)
    own = {s: sorted((i for i, x, _ in data if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sizes}
    order = [i for _, (s, k) in sorted(slots.items()) for i in own[s][k * mixing.BLOCK_ROWS:(k + 1) * mixing.BLOCK_ROWS]]
    got = corpus_pipeline.shard(spark, mixed, SF).select("doc_id", "shard", "slot").collect()
    shards = {r["doc_id"]: r["shard"] for r in got}
    for n in range(16):
        want = [i for i in order if shards[i] == n]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == n] == want
    # While all sources last, the first slots of the shards hold the target shares.
    prefix = [r["doc_id"] for r in got if r["slot"] < 30]
    held = collections.Counter(data[i][1] for i in prefix)
    assert all(abs(held[s] / len(prefix) - a[s] / q) < 0.06 for s in sizes)

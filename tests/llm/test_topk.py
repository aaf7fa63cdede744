import math

import numpy as np
import pytest

from retenta.llm import topk


def brute(data, k, step):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, (q, a) in enumerate(kept):
        if q % step == 0:
            scores = []
            for n, (c, b) in enumerate(kept):
                if n != m:
                    s = sum(x * y for x, y in zip(a, b))
                    scores.append((-min(max(s, -2 ** 63), 2 ** 63 - 1), c))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, data, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, label int, norm string")
    got = topk.top_k(df, **options).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


@pytest.mark.parametrize("block,queries", [(16, 4), (1024, 256)])
def test_matches_brute_force(spark, block, queries):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    data += [(400 + i, data[7][1]) for i in range(60)]                       # ties
    data += [(500, [0.0] * 12), (550, None), (551, [None] * 12), (552, [float("nan")] * 12), (553, [float("inf")] * 12),
             (600, [1.0, -2.0]), (None, data[3][1]), (0, data[0][1]), (650, [])]
    assert run(spark, data, k=5, query_step=50, block=block, queries=queries, leading=3) == brute(data, 5, 50)


def test_few_rows_and_large_components(spark):
    data = [(0, [3e18, 1.0]), (1, [3e18, 2.0]), (2, [-3e18, 0.0]), (50, [1e12, 1e12])]
    assert run(spark, data) == brute(data, 5, 50)
    assert run(spark, [(50, [1.0])]) == [] and run(spark, []) == []


def test_rows_of_a_repeated_id_count_one_by_one(spark):
    data = [(50, [1.0, 0.0]), (50, [9.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    got = run(spark, data)
    assert got == brute(data, 5, 50) and len(got) == 8
    twice = [(100, [1.0]), (100, [1.0]), (3, [1.0])]
    assert run(spark, twice) == brute(twice, 5, 50) == [(100, 1, 3, 65536), (100, 1, 3, 65536), (100, 2, 100, 65536), (100, 2, 100, 65536)]


def test_blocks_meet_in_cells_and_are_never_broadcast(spark, monkeypatch):
    """A copy of all queries for each partition, in one broadcast, grows with queries times partitions."""
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, [2.0] * 8) for i in range(300)]
    monkeypatch.setattr(topk, "CELL", (2, 3))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.top_k(df, k=5, query_step=5, block=16, queries=4, leading=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "FlatMapCoGroupsInPandas" in plan
    assert sorted(map(tuple, got.collect())) == brute(data, 5, 5)

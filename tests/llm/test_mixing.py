from fractions import Fraction

import numpy as np
import pytest

from retenta.llm import mixing
from .conftest import rows


def brute(sizes, shares, block):
    """Earliest deadline first over released blocks, slot by slot."""
    names = sorted((s for s in sizes if shares[s]), key=lambda s: (s is not None, s))
    q, had, slots, t = sum(shares.values()), {s: 0 for s in names}, {}, 0
    blocks = {s: -(-sizes[s] // block) for s in names}
    while any(had[s] < blocks[s] for s in names):
        ready = [(-(-(had[s] + 1) * q // shares[s]), i, s) for i, s in enumerate(names) if had[s] * q // shares[s] <= t]
        _, _, s = min(ready)
        if had[s] < blocks[s]:
            slots[t] = (s, had[s])
        had[s] += 1
        t += 1
    return q, slots


def drift(slots, targets, until):
    """The largest distance of a source's blocks from its exact target (integer parts of their sum), after any of the first slots."""
    names = sorted(targets)
    parts, had, whole, most = np.array([targets[s] for s in names]), np.zeros(len(names), np.int64), sum(targets.values()), 0
    at = {s: i for i, s in enumerate(names)}
    for t in range(until):
        had[at[slots[t][0]]] += 1
        most = max(most, int(np.abs(had * whole - (t + 1) * parts).max()))
    return Fraction(most, whole)


def placed(spark, sizes, **options):
    data = [(i, s, "x", "y") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, source string, slot string, position string").repartition(3)
    got = mixing.mix(df, **options).collect()
    assert sorted(r["position"] for r in got) == list(range(sum(sizes.values())))
    return got


def test_schedule_matches_slot_by_slot_simulation(spark):
    sizes = {"hot": 700, "b": 90, "c": 41, None: 17, "d": 3, "unweighted": 20, "zero": 9}
    weights = {"hot": 5.0, "b": 2.5, "c": 1.5, None: 1.0, "d": 0.01, "zero": 0.0}
    got = placed(spark, sizes, weights=weights, block_rows=4)
    q, slots = brute(sizes, {**mixing.exact_shares(weights), "unweighted": 0}, 4)
    assert q == 1001
    assert {(r["slot"], (r["source"], r["block"])) for r in got if r["slot"] is not None} == set(slots.items())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got if r["slot"] is not None)
    by_slot = sorted(got, key=lambda r: r["position"])
    weighted = [r["slot"] for r in by_slot if r["slot"] is not None]
    assert weighted == sorted(weighted)
    assert [r["source"] for r in by_slot[-29:]] == ["unweighted"] * 20 + ["zero"] * 9


def test_thirds_do_not_drift(spark):
    got = placed(spark, {"a": 2000, "b": 4000}, weights={"a": 1 / 3, "b": 2 / 3}, block_rows=1)
    slots = {r["slot"]: (r["source"], r["block"]) for r in got}
    assert drift(slots, {"a": 1, "b": 2}, 6000) < 1


def test_two_thousand_and_one_sources_keep_their_targets(spark):
    weights = {"hot": 0.5, **{f"s{i:04d}": 0.00025 for i in range(2000)}}
    sizes = {"hot": 2000, **{s: 1 for s in weights if s != "hot"}}
    got = placed(spark, sizes, weights=weights, block_rows=1)
    slots = {r["slot"]: (r["source"], r["block"]) for r in got}
    assert drift(slots, {s: 2000 if s == "hot" else 1 for s in weights}, 4000) < 1
    free = {r["source"]: r["a"] for r in mixing.shares(spark.createDataFrame([("hot", 10**6), *[(f"s{i}", 10**3) for i in range(2000)]], "source string, n long")).collect()}
    assert abs(free["hot"] / sum(free.values()) - 1000 / (1000 + 2000 * 1000**0.5)) < 0.0015


def test_period_of_several_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    sizes, weights = {"a": 300, "b": 200, "c": 41}, {"a": 0.5, "b": 0.31, "c": 0.19}
    got = placed(spark, sizes, weights=weights, block_rows=2)
    q, slots = brute(sizes, mixing.exact_shares(weights), 2)
    assert q == 100 and {(r["slot"], (r["source"], r["block"])) for r in got} == set(slots.items())


def test_shares_are_the_weights_or_an_error():
    assert mixing.exact_shares({"a": 0.1, "b": 0.2, "c": 0.7}) == {"a": 1, "b": 2, "c": 7}
    assert mixing.exact_shares({"a": 3.0, "b": 0.0}) == {"a": 1, "b": 0} and mixing.exact_shares({}) == {}
    rounded = mixing.exact_shares({"a": 0.123456789, "b": 0.876543211}, period=1000)
    assert rounded == {"a": 123, "b": 877}
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.exact_shares({"a": 1.0, "b": wrong})


def test_interleaved_keeps_rows_and_columns(docs):
    out = mixing.interleaved(docs)
    assert out.columns == docs.columns
    assert rows(out, *docs.columns) == rows(docs, *docs.columns)


def test_default_weights_repeats_and_empty(docs, none):
    got = mixing.mix(docs.select("doc_id", "source"))
    assert sorted(r["position"] for r in got.collect()) == list(range(docs.count()))
    assert mixing.mix(none).count() == 0 and mixing.interleaved(none).count() == 0

"""Bucketed layout: same results, fewer exchanges on the per-order aggregates."""

import os

import pytest

from retenta.operators import base
from retenta.plans import features, kpis
from retenta.sources.fixtures import load_fixture_tables
from retenta.sources.layout import write_bucketed

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_bucketed_layout_same_results_fewer_shuffles(spark, tmp_path):
    t = load_fixture_tables(spark, SF)
    bt = write_bucketed(spark, t, "layout_test", 4, base_path=str(tmp_path))
    for fn in (kpis.repeat_purchase_rate, kpis.customer_lifetime_value):
        assert fn(t).collect() == fn(bt).collect()
    a = sorted(features.first_order_features(t).collect(), key=repr)
    b = sorted(features.first_order_features(bt).collect(), key=repr)
    assert a == b
    # per-order item totals: no exchange on the bucketed items
    assert exchanges(base.order_item_totals(bt.order_items)) == 0
    assert exchanges(base.order_item_totals(t.order_items)) >= 1

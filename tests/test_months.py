"""Layout by months: same results, one month replaced alone, other months' folders not read."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from retenta.plans import dashboards
from retenta.sources import months
from tests.edge_tables import edge_tables


@pytest.fixture()
def laid_out(spark, tmp_path):
    t = edge_tables(spark)
    path = str(tmp_path / "months")
    months.write_months(t, path, files=2)
    return t, path


def files(spark, path, name, month=None):
    found = spark.read.parquet(f"{path}/{name}").inputFiles()
    return sorted(f for f in found if month is None or f"{months.MONTH}={month}/" in f)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_rows_and_trend(spark, laid_out):
    t, path = laid_out
    back = months.read_months(spark, path, t)
    assert bag(back.orders) == bag(t.orders) and bag(back.order_items) == bag(t.order_items)
    assert bag(dashboards.monthly_trend(back)) == bag(dashboards.monthly_trend(t))


def test_range_reads_its_folders_only(spark, laid_out):
    t, path = laid_out
    seen = sorted(r[0] for r in t.orders.select(months.month_of("order_purchase_timestamp")).distinct().collect() if r[0])
    part = months.read_months(spark, path, t, since=seen[1], until=seen[1])
    plan = part.orders._jdf.queryExecution().executedPlan().toString()
    assert f"{months.MONTH}" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(part.orders.inputFiles()) >= 1
    want = t.orders.filter(months.month_of("order_purchase_timestamp") == seen[1])
    assert bag(part.orders) == bag(want)
    text = f"{seen[1] // 100}-{seen[1] % 100:02d}"
    assert bag(dashboards.monthly_trend(part)) == [r for r in bag(dashboards.monthly_trend(t)) if r[0] == text]


def test_one_month_is_replaced_alone(spark, laid_out):
    t, path = laid_out
    month = t.orders.agg(F.max(months.month_of("order_purchase_timestamp"))).first()[0]
    before = {n: files(spark, path, n) for n in months.LAID_OUT}
    batch = t.orders.filter(months.month_of("order_purchase_timestamp") == month)
    changed = batch.withColumn("order_status", F.lit("canceled"))
    months.replace_months(replace(t, orders=changed), path, files=2)
    for n in months.LAID_OUT:
        kept = [f for f in before[n] if f"{months.MONTH}={month}/" not in f]
        assert set(kept) <= set(files(spark, path, n))
        assert not set(before[n]) - set(kept) & set(files(spark, path, n))
    back = months.read_months(spark, path, t)
    assert back.orders.count() == t.orders.count()
    assert bag(back.orders.filter("order_status = 'canceled'").select("order_id")) == bag(
        t.orders.filter((F.col("order_status") == "canceled") | (months.month_of("order_purchase_timestamp") == month)).select("order_id"))
    # A batch without orders replaces nothing.
    months.replace_months(replace(t, orders=t.orders.limit(0)), path)
    assert back.orders.count() == t.orders.count()


def test_items_are_joined_without_a_sort(spark, tmp_path, monkeypatch):
    """The items are the larger side: a sort of them spills, a hash table of the orders' ids does not."""
    t = edge_tables(spark)
    monkeypatch.setattr(months, "FEW_ORDERS", 0)
    monkeypatch.setattr(months, "ORDERS_A_TASK", 1)
    plans, write = [], months._write

    def seen(frames, *rest):
        plans.append(frames["order_items"]._jdf.queryExecution().executedPlan().toString())
        write(frames, *rest)

    monkeypatch.setattr(months, "_write", seen)
    path = str(tmp_path / "m")
    months.write_months(t, path)
    months.replace_months(t, path)
    assert all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in plans) and len(plans) == 2
    back = months.read_months(spark, path, t)
    assert bag(back.orders) == bag(t.orders) and bag(back.order_items) == bag(t.order_items)

"""The shared-base publication job gives the same tables as the one-by-one queries."""

import os

from retenta.plans import dashboards, publish
from tests.edge_tables import edge_tables


def test_shared_base_same_results(spark):
    t = edge_tables(spark)
    st = publish.share_base(t)
    for fn in (dashboards.kpi_summary, dashboards.delivery_vs_repeat, dashboards.cohort_heatmap):
        assert sorted(fn(t).collect()) == sorted(fn(st).collect())


def test_publish_writes_one_csv_per_dashboard(spark, tmp_path):
    t = edge_tables(spark)
    names = publish.publish_dashboards(t, str(tmp_path),
                                       params={"repeat_rate_by_category": {"min_customers": 1}})
    assert len(names) == 6
    for n in names:
        parts = [f for f in os.listdir(tmp_path / n) if f.endswith(".csv")]
        assert len(parts) == 1


def test_jobs_load_check_and_publish(spark, tmp_path):
    import jobs
    from retenta.plans.ingest import conform
    from retenta.sources import sinks
    t = edge_tables(spark)
    for name, df in t.as_dict().items():
        sinks.write_csv(conform(df, name), str(tmp_path / "csv" / name))
    jobs.main(["load", str(tmp_path / "csv"), str(tmp_path / "tables")])
    jobs.main(["check", str(tmp_path / "tables"), str(tmp_path / "report")])
    jobs.main(["features", str(tmp_path / "tables"), str(tmp_path / "features")])
    jobs.main(["dashboard", str(tmp_path / "tables"), str(tmp_path / "dashboards")])
    assert spark.read.parquet(str(tmp_path / "features")).count() > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() > 10
    assert len(os.listdir(tmp_path / "dashboards")) == 6

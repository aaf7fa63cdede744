"""Publication jobs: the dashboard tables and the feature table, built from one shared base.

The reference runs its six dashboard statements one by one, each rescanning
orders ⋈ customers. Here the valid person-orders relation is computed once
and written to the shared checkpoint folder; every dashboard and the feature
table read it. Small aggregates go out as single CSV files; the feature table
(person grain, grows with the data) as Parquet, split by partition.
"""

from __future__ import annotations

import dataclasses

from ..operators import base
from ..session import materialize
from ..sources import sinks
from ..sources.tables import Tables
from . import dashboards, features, modelling


def share_base(t: Tables) -> Tables:
    """The same tables with the valid person-orders relation computed once (checkpointed)."""
    po = materialize(base.person_orders(t))
    return dataclasses.replace(t, shared_person_orders=po)


DASHBOARDS = {
    "kpi_summary": dashboards.kpi_summary,
    "repeat_rate_by_state": dashboards.repeat_rate_by_state,
    "repeat_rate_by_category": dashboards.repeat_rate_by_category,
    "cohort_retention": dashboards.cohort_heatmap,
    "monthly_trend": dashboards.monthly_trend,
    "delivery_vs_repeat": dashboards.delivery_vs_repeat,
}


def publish_dashboards(t: Tables, out_dir: str, params: dict | None = None,
                       with_decision_matrix: bool = False) -> list[str]:
    """Write each dashboard table as one header CSV under ``out_dir`` (D1-D6, optional D7)."""
    params = params or {}
    st = share_base(t)
    written = []
    for name, fn in DASHBOARDS.items():
        df = fn(st, **params.get(name, {}))
        sinks.write_csv(df, f"{out_dir.rstrip('/')}/{name}", single_file=True)
        written.append(name)
    if with_decision_matrix:
        rep = modelling.evaluation_report(st)
        sinks.write_csv(rep["decision_matrix"], f"{out_dir.rstrip('/')}/threshold_decision_matrix",
                        single_file=True)
        sinks.write_importances(rep["importances"], f"{out_dir.rstrip('/')}/feature_importance")
        written += ["threshold_decision_matrix", "feature_importance"]
    return written


def publish_reports(t: Tables, out_dir: str) -> list[str]:
    """Write the tables of both model reports (X4), baseline and improved, as one header CSV each."""
    st = share_base(t)
    written = []
    for variant, report in (("baseline", modelling.baseline_report(st)), ("improved", modelling.evaluation_report(st))):
        for name, df in report.items():
            sinks.write_csv(df, f"{out_dir.rstrip('/')}/{variant}_{name}", single_file=True)
            written.append(f"{variant}_{name}")
    return written


def publish_features(t: Tables, out_dir: str) -> None:
    """Write the first-order feature table (X1) as Parquet (many files, one per task)."""
    sinks.write_parquet(features.first_order_features(share_base(t)), out_dir)

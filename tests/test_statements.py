"""Query texts from files: splitting, names, bound parameters, the four KPIs."""

import pytest

from retenta.plans import kpis
from retenta.sources import statements
from tests.edge_tables import edge_tables


def test_split_keeps_semicolons_in_quotes_and_comments():
    text = "SELECT ';' AS a, \"x;y\", `b;c` -- no; end\n/* nor; here */ FROM t;\n;;  -- only a comment;\n SELECT 'it''s;' ; SELECT 'a\\';b'"
    got = statements.split_statements(text)
    assert len(got) == 3 and got[1].endswith("SELECT 'it''s;'") and got[2] == "SELECT 'a\\';b'"
    assert statements.split_statements(" \n-- nothing\n;") == []


def test_names():
    got = statements.named_statements("-- name: first\nSELECT 1; SELECT 2; -- name: not this; it is inside\n-- name: third\nSELECT 3")
    assert list(got) == ["first", "2", "third"]
    with pytest.raises(ValueError):
        statements.named_statements("-- name: a\nSELECT 1;\n-- name: a\nSELECT 2")


def test_four_kpis_from_a_file_equal_the_functions(spark, tmp_path):
    t = edge_tables(spark)
    got = kpis.from_text(t, min_orders=0)
    want = {"repeat_purchase_rate": kpis.repeat_purchase_rate(t), "cohort_retention": kpis.cohort_retention(t),
            "customer_lifetime_value": kpis.customer_lifetime_value(t), "category_dissatisfaction": kpis.category_dissatisfaction(t, min_orders=0)}
    assert list(got) == list(want)
    for name, df in want.items():
        assert got[name].dtypes == df.dtypes and list(map(tuple, got[name].collect())) == list(map(tuple, df.collect())), name
    assert not [x for x in spark.catalog.listTables() if x.isTemporary and x.name in t.as_dict()]


def test_parameters_are_bound_and_views_not_overwritten(spark, tmp_path):
    t = edge_tables(spark)
    path = tmp_path / "q.sql"
    path.write_text("SELECT count(*) AS n FROM orders WHERE order_status = :status")
    odd = statements.run_file(t, str(path), {"status": "x' OR '1' = '1", "unused": 1})
    assert odd["1"].first()["n"] == 0
    assert statements.run_file(t, str(path), {"status": "shipped"})["1"].first()["n"] == 1
    with pytest.raises(Exception, match="UNBOUND"):
        statements.run_file(t, str(path))
    t.orders.createOrReplaceTempView("orders")
    try:
        with pytest.raises(ValueError):
            statements.run_file(t, str(path), {"status": "shipped"})
    finally:
        spark.catalog.dropTempView("orders")

"""CSV ingest (quoting, newlines, FAILFAST) and the data-quality jobs."""

import pytest

from retenta.operators import quality
from retenta.sources.csv import read_csv
from tests.edge_tables import edge_tables


def test_csv_quotes_commas_newlines(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,4,"He said ""great""","line one, with comma\nline two",2017-01-02 00:00:00,\n'
        "r2,o2,,,,2017-01-03 10:11:12,2017-01-04 00:00:00\n")
    rows = {r["review_id"]: r for r in read_csv(spark, str(p), "order_reviews").collect()}
    assert rows["r1"]["review_comment_title"] == 'He said "great"'
    assert rows["r1"]["review_comment_message"] == "line one, with comma\nline two"
    assert rows["r2"]["review_score"] is None
    assert rows["r2"]["review_creation_date"].second == 12


def test_csv_fail_fast(spark, tmp_path):
    p = tmp_path / "pay.csv"
    p.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                 "o1,one,boleto,1,1.00\n")
    with pytest.raises(Exception):
        read_csv(spark, str(p), "order_payments").collect()


def test_quality_jobs_find_planted_violations(spark):
    t = edge_tables(spark)
    dup = quality.duplicate_keys(t.order_items, ["order_id", "order_item_id"]).collect()
    assert [(r["order_id"], r["order_item_id"], r["n_rows"]) for r in dup] == [("o8", 1, 2)]
    orph = quality.orphans(t.order_items, "seller_id", t.sellers, "seller_id").collect()
    assert [r["order_id"] for r in orph] == ["o10"]
    cat = quality.orphans(t.products, "product_category_name", t.category_translation,
                          "product_category_name").collect()
    assert [r["product_id"] for r in cat] == ["px"]
    rep = {(r["kind"], r["table_name"], r["columns"]): r["violations"]
           for r in quality.constraint_report(t).collect()}
    assert rep[("primary_key", "order_items", "order_id,order_item_id")] == 2
    assert rep[("not_null", "customers", "customer_unique_id")] == 0


def test_stream_ingest_exactly_once(spark, tmp_path):
    from retenta.streaming.ingest import ingest
    src, out, cp = tmp_path / "src", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    header = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    (src / "a.csv").write_text(header + "o1,1,boleto,1,1.00\no2,1,voucher,2,2.50\n")
    ingest(spark, str(src), "order_payments", str(out), checkpoint=str(cp))
    (src / "b.csv").write_text(header + "o3,1,credit_card,3,3.00\n")
    ingest(spark, str(src), "order_payments", str(out), checkpoint=str(cp))  # only the new file
    got = sorted(r["order_id"] for r in spark.read.parquet(str(out)).collect())
    assert got == ["o1", "o2", "o3"]


def test_empty_quoted_text_stays_and_line_breaks_are_read(spark, tmp_path):
    from retenta.sources import csv
    head = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
    (tmp_path / "r.csv").write_text(head + 'r1,o1,5,"",,2018-01-01 00:00:00,2018-01-02 00:00:00\n'
                                    'r2,o2,,t,"two\nlines",2018-01-01 00:00:00,2018-01-02 00:00:00\n')
    got = [tuple(r)[:5] for r in csv.read_csv(spark, str(tmp_path / "r.csv"), "order_reviews").orderBy("review_id").collect()]
    assert got == [("r1", "o1", 5, "", None), ("r2", "o2", None, "t", "two\nlines")]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest
    from retenta import session
    class Conf:
        def get(self, key, default=None):
            return default
    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake())

"""Bad CSV rows are listed with file, record and column; good rows are read as always."""

from retenta import schemas
from retenta.sources import csv, rejects

PAY = ",".join(schemas.SCHEMAS["order_payments"].names) + "\n"
REVIEW = ",".join(schemas.SCHEMAS["order_reviews"].names) + "\n"


def listed(df):
    found = [(r["table_name"], r["file"].rsplit("/", 1)[1], r["record"], r["column_name"], r["value"]) for r in df.collect()]
    return sorted(found, key=str)


def test_faults_in_three_files(spark, tmp_path):
    pay = tmp_path / "pay"
    pay.mkdir()
    (pay / "a.csv").write_text(PAY + "o1,1,boleto,1,1.00\no2,one,boleto,x,1.00\n\no3,2,voucher,1,9.999\n")
    (pay / "b.csv").write_text(PAY + "o4,1,boleto\no5,1,boleto,1,1e3\no6,,boleto,1,5\n")
    reviews = tmp_path / "reviews.csv"
    reviews.write_text(REVIEW + 'r1,o1,4,"two\nlines",ok,2017-01-02 00:00:00,\nr2,o2,4,t,m,2017-02-30 00:00:00,\nr3,o3,,,,,,,\n')
    got = rejects.all_rejects(spark, {"order_payments": str(pay), "order_reviews": str(reviews)})
    assert listed(got) == sorted([
        ("order_payments", "a.csv", 2, "payment_sequential", "one"), ("order_payments", "a.csv", 2, "payment_installments", "x"),
        ("order_payments", "b.csv", 1, None, "o4,1,boleto"), ("order_payments", "b.csv", 2, "payment_value", "1e3"),
        ("order_payments", "b.csv", 3, "payment_sequential", None), ("order_reviews", "reviews.csv", 2, "review_creation_date", "2017-02-30 00:00:00"),
        ("order_reviews", "reviews.csv", 3, None, "r3,o3,,,,,,,")], key=str)
    good, _ = rejects.read_with_rejects(spark, str(pay), "order_payments")
    assert sorted(r["order_id"] for r in good.collect()) == ["o1", "o3"]


def test_good_rows_equal_the_strict_reader(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(REVIEW + 'r1,o1,5,"","a ""b"",\nc",2018-01-01 00:00:00,2018-01-02 00:00:00\nr2,o2,,t,,2018-01-01 00:00:00,\n')
    good, bad = rejects.read_with_rejects(spark, str(p), "order_reviews")
    strict = csv.read_csv(spark, str(p), "order_reviews")
    assert good.dtypes == strict.dtypes and sorted(good.collect()) == sorted(strict.collect()) and bad.count() == 0


def test_record_numbers_go_on_across_splits(spark, tmp_path):
    p = tmp_path / "pay.csv"
    p.write_text(PAY + "".join(f"o{i},{i if i % 700 else 'bad'},boleto,1,1.00\n" for i in range(1, 5001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = rejects.read_with_rejects(spark, str(p), "order_payments")[1]
        assert [r["record"] for r in found.orderBy("record").collect()] == list(range(700, 5001, 700))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

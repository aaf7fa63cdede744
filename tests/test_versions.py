"""All-or-nothing loads: a bad row or a broken constraint leaves the old version of all eight tables."""

import dataclasses
import threading

import pytest
from pyspark.sql import functions as F

from retenta import schemas
from retenta.plans import ingest
from retenta.session import together
from retenta.sources import csv, sinks, versions
from tests.edge_tables import edge_tables

BROKEN_BY_DESIGN = frozenset({("primary_key", "order_items"), ("foreign_key", "order_items"), ("foreign_key", "products")})


def contents(t):
    return {name: sorted(map(repr, df.collect())) for name, df in t.as_dict().items()}


@pytest.fixture()
def store(spark, tmp_path):
    t = edge_tables(spark)
    root = str(tmp_path / "store")
    assert versions.replace_all(t, root, BROKEN_BY_DESIGN) == 1
    return t, root


def test_bad_row_in_the_fifth_table_leaves_all_eight(spark, tmp_path, store):
    t, root = store
    before = contents(versions.live(spark, root))
    assert before == contents(t)
    bad = tmp_path / "orders.csv"
    bad.write_text(",".join(schemas.SCHEMAS["orders"].names) + "\no1,c1,shipped,yesterday,,,,\n")
    # everything else would be new: other customers, no reviews
    other = dataclasses.replace(t, customers=t.customers.withColumn("customer_city", F.lit("elsewhere")),
                                order_reviews=t.order_reviews.limit(0), orders=csv.read_csv(spark, str(bad), "orders"))
    with pytest.raises(Exception, match="MALFORMED|yesterday|FAILFAST"):
        versions.replace_all(other, root, BROKEN_BY_DESIGN)
    assert contents(versions.live(spark, root)) == before
    assert versions.live_manifest(spark, root)[0] == 1


def test_broken_constraint_leaves_all_eight(spark, store):
    t, root = store
    orphaned = dataclasses.replace(t, customers=t.customers.filter("customer_id <> 'c1'"))
    with pytest.raises(versions.LoadRejected) as e:
        versions.replace_all(orphaned, root, BROKEN_BY_DESIGN)
    assert e.value.violations == [("foreign_key", "orders", "customer_id->customers.customer_id", 1)]
    assert contents(versions.live(spark, root)) == contents(t)


def test_second_load_replaces_and_old_frames_go_on(spark, store):
    t, root = store
    old = versions.live(spark, root)
    newer = dataclasses.replace(t, sellers=t.sellers.withColumn("seller_city", F.lit("x")))
    assert versions.replace_all(newer, root, BROKEN_BY_DESIGN) == 2
    assert contents(versions.live(spark, root)) == contents(newer)
    assert contents(old) == contents(t)
    assert versions.restore(spark, root, 1) == 3
    assert contents(versions.open_tables(spark, root)) == contents(t)
    h = versions.history(spark, root).filter("is_live and table_name = 'orders'").collect()
    assert [(r["number"], r["n_rows"]) for r in h] == [(3, 10)]


def test_loads_at_once_and_torn_manifests(spark, store):
    t, root = store
    first, second = versions.stage(t, root), versions.stage(t, root)
    assert versions.publish(first) == 2
    with pytest.raises(versions.LoadConflict):
        versions.publish(second)
    # a writer that died in the middle of its manifest
    with open(f"{root}/manifests/000000000003.json", "w") as f:
        f.write("0123\n{\"version\"")
    assert versions.live_manifest(spark, root)[0] == 2
    assert versions.replace_all(t, root, BROKEN_BY_DESIGN) == 4
    assert versions.drop_old(spark, root, keep=2)
    assert contents(versions.live(spark, root)) == contents(t)


def test_plain_folder_and_checksums(spark, tmp_path, store):
    t, root = store
    csv.load_tables(t, str(tmp_path / "plain"))
    plain = versions.open_tables(spark, str(tmp_path / "plain"))
    sums = sorted(versions.checksums(plain).collect())
    assert sums == sorted(versions.checksums(versions.live(spark, root)).collect())
    changed = dataclasses.replace(t, orders=t.orders.withColumn("order_status", F.lit("delivered")))
    assert sums != sorted(versions.checksums(changed).collect())


def test_unpublished_store_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.live(spark, str(tmp_path / "none"))


def test_job_loads_checks_and_lists_rejects(spark, tmp_path):
    import jobs
    t = edge_tables(spark)
    for name, df in t.as_dict().items():
        sinks.write_csv(df, str(tmp_path / "csv" / name))
    allow = [x for kind, table in BROKEN_BY_DESIGN for x in ("--allow", f"{kind}:{table}")]
    jobs.main(["load", str(tmp_path / "csv"), str(tmp_path / "store"), "--strict", *allow])
    assert contents(versions.live(spark, str(tmp_path / "store"))) == contents(t)
    jobs.main(["rejects", str(tmp_path / "csv"), str(tmp_path / "rejects")])
    assert spark.read.option("header", True).csv(str(tmp_path / "rejects")).count() == 0


def test_parents_are_loaded_in_an_earlier_step():
    at = {name: i for i, names in enumerate(schemas.LOAD_STEPS) for name in names}
    assert set(at) == set(schemas.LOAD_ORDER) and sum(map(len, schemas.LOAD_STEPS)) == len(at) == 8
    assert all(at[parent] < at[child] for child, _, parent, _ in schemas.FOREIGN_KEYS)


def test_actions_run_side_by_side_and_the_first_failure_is_raised(spark):
    both, ended = threading.Barrier(2, timeout=20), []

    def fail(text):
        raise ValueError(text)

    together(spark, [both.wait, both.wait])
    with pytest.raises(ValueError, match="first"):
        together(spark, [lambda: fail("first"), lambda: ended.append(spark.range(3).count()), lambda: fail("second")])
    assert ended == [3]


def test_failed_loads_leave_no_tables_behind(spark, tmp_path, store):
    t, root = store
    bad = tmp_path / "orders.csv"
    bad.write_text(",".join(schemas.SCHEMAS["orders"].names) + "\no1,c1,shipped,yesterday,,,,\n")
    with pytest.raises(Exception, match="MALFORMED|yesterday|FAILFAST"):
        versions.replace_all(dataclasses.replace(t, orders=csv.read_csv(spark, str(bad), "orders")), root, BROKEN_BY_DESIGN)
    with pytest.raises(versions.LoadRejected):
        versions.replace_all(dataclasses.replace(t, customers=t.customers.filter("customer_id <> 'c1'")), root, BROKEN_BY_DESIGN)
    held = [p.name for p in (tmp_path / "store" / "versions").iterdir()]
    assert held == [versions.live_manifest(spark, root)[1]["version"]]
    assert contents(versions.live(spark, root)) == contents(t)


def test_csv_of_a_load_is_compressed_and_dealt_to_files(spark, tmp_path, monkeypatch):
    """As plain text the CSV copies of all tables filled the disk; one compressed file must not hold a whole table."""
    t = edge_tables(spark)
    many = t.orders.filter("order_id = 'o1'").crossJoin(spark.range(5000)).withColumn("order_id", F.col("id").cast("string")).drop("id")
    t = dataclasses.replace(t, orders=many.coalesce(1))
    monkeypatch.setattr(sinks, "ZIPPED_ROWS", 2000)
    ingest.write_csvs(t, str(tmp_path / "csv"))
    sinks.write_csv(ingest.conform(t.orders, "orders"), str(tmp_path / "plain"))
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / folder).glob("part-*"))
    assert size("csv/orders") * 3 < size("plain")
    assert len(list((tmp_path / "csv/orders").glob("part-*"))) == 3
    back = csv.read_csv_dir(spark, {name: str(tmp_path / "csv" / name) for name in schemas.SCHEMAS})
    assert contents(back) == contents(t)

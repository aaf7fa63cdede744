"""The analyses as spark-submit jobs.

    spark-submit jobs.py load      CSV_DIR TABLES_DIR    CSV files (one folder or file per table) as a new live version of
                                                         all eight tables, or none if a row is bad (with --strict: or a constraint)
    spark-submit jobs.py rejects   CSV_DIR OUT_DIR       every bad row of the CSV files, with file, record and column
    spark-submit jobs.py check     TABLES_DIR OUT_DIR    constraint report
    spark-submit jobs.py features  TABLES_DIR OUT_DIR    first-order feature table
    spark-submit jobs.py dashboard TABLES_DIR OUT_DIR    dashboard tables
    spark-submit jobs.py models    TABLES_DIR OUT_DIR    both model reports
"""

from __future__ import annotations

import argparse

from retenta import schemas
from retenta.operators import quality
from retenta.plans import publish
from retenta.session import build_session
from retenta.sources import csv, rejects, sinks, versions


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["load", "rejects", "check", "features", "dashboard", "models"])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--strict", action="store_true", help="load: broken constraints reject the load")
    parser.add_argument("--allow", action="append", default=[], metavar="KIND:TABLE",
                        help="load --strict: a constraint that may be broken, e.g. not_null:customers")
    args = parser.parse_args(argv)
    spark = build_session(app=f"retenta-{args.job}")
    files = {name: f"{args.source.rstrip('/')}/{name}" for name in schemas.SCHEMAS}
    if args.job == "load":
        allowed = frozenset(tuple(pair.split(":", 1)) for pair in args.allow)
        print(versions.replace_all(csv.read_csv_dir(spark, files), args.target, allowed, check=args.strict))
        return
    if args.job == "rejects":
        sinks.write_csv(rejects.all_rejects(spark, files), args.target)
        return
    tables = versions.open_tables(spark, args.source)
    if args.job == "check":
        sinks.write_csv(quality.constraint_report(tables), args.target, single_file=True)
    elif args.job == "features":
        publish.publish_features(tables, args.target)
    elif args.job == "dashboard":
        publish.publish_dashboards(tables, args.target)
    else:
        publish.publish_reports(tables, args.target)


if __name__ == "__main__":
    main()

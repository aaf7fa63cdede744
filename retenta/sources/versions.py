"""All-or-nothing loads of the eight tables.

A store is a folder. Every load writes its tables under a name of its own in
``versions/``; nothing that readers see changes while it runs. When all eight
are written and the constraint jobs (S6-S8) have passed, one small file, the manifest, names
them, and from then on they are the live version. Manifests are numbered and
never changed: the live one is the highest that is complete. A load that fails
at any table, or that breaks a constraint, leaves no manifest, so readers go on with the old
version of all eight. Two loads at once can't both win: a number is taken by
creating its file, which the file system does for one of them only, and the other is told.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import quality
from ..session import together
from .tables import Tables, from_parquet_dir

MANIFESTS, VERSIONS = "manifests", "versions"


class LoadRejected(Exception):
    """The staged tables break constraints; ``violations`` lists (kind, table, columns, rows)."""

    def __init__(self, violations: list[tuple]):
        super().__init__("; ".join(f"{t}: {k} ({c}) in {n} rows" for k, t, c, n in violations))
        self.violations = violations


class LoadConflict(Exception):
    """Another load was published since this one began."""


@dataclass(frozen=True)
class Staged:
    """Tables written under a version's name, not yet live."""
    root: str
    name: str
    based_on: int
    tables: Tables

    def path(self, table: str) -> str:
        return f"{self.root}/{VERSIONS}/{self.name}/{table}"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _files(spark, f"{root}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)


def _manifest(spark: SparkSession, root: str, number: int) -> dict | None:
    """A manifest's content, None if its writer died before the end (its digest tells)."""
    text = spark.read.text(f"{root}/{MANIFESTS}/{number:012d}.json", wholetext=True).first()
    head, _, body = (text[0] if text else "").partition("\n")
    return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == head else None


def live_manifest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """Number and content of the live version's manifest."""
    for number in _numbers(spark, root):
        found = _manifest(spark, root, number)
        if found:
            return number, found
    return None


def stage(tables: Tables, root: str) -> Staged:
    """Write all eight tables, parents first, under a new version's name. A bad row fails here: nothing is live, and what was
    written goes."""
    root, spark = root.rstrip("/"), tables.orders.sparkSession
    taken = _numbers(spark, root)
    staged = Staged(root, uuid.uuid4().hex, taken[0] if taken else 0, tables)
    frames = tables.as_dict()
    try:
        for names in schemas.LOAD_STEPS:
            together(spark, (lambda name=name: frames[name].write.option("compression", "zstd").parquet(staged.path(name)) for name in names))
    except BaseException:
        discard(staged)
        raise
    return Staged(root, staged.name, staged.based_on, from_parquet_dir(spark, f"{root}/{VERSIONS}/{staged.name}"))


def discard(staged: Staged) -> None:
    """Delete staged tables that no manifest will name."""
    fs, path = _files(staged.tables.orders.sparkSession, f"{staged.root}/{VERSIONS}/{staged.name}")
    fs.delete(path, True)


def gate(staged: Staged, allowed: frozenset[tuple[str, str]] = frozenset()) -> list[tuple]:
    """The constraint report (S6-S8) of the staged tables as (kind, table, columns, rows); raises ``LoadRejected`` where
    a constraint that isn't among the ``allowed`` (kind, table) pairs is broken."""
    report = [tuple(r) for r in quality.constraint_report(staged.tables).collect()]      # a row per declared constraint
    broken = [r for r in report if r[3] and (r[0], r[1]) not in allowed]
    if broken:
        raise LoadRejected(broken)
    return report


def publish(staged: Staged, report: list[tuple] = ()) -> int:
    """Make the staged tables live, all at once; returns the new manifest's number."""
    spark = staged.tables.orders.sparkSession
    body = json.dumps({
        "version": staged.name, "based_on": staged.based_on, "at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "rows": {name: df.count() for name, df in staged.tables.as_dict().items()},
        "checks": [list(r) for r in report]}, sort_keys=True)
    _write(spark, staged.root, staged.based_on + 1, body)
    return staged.based_on + 1


def _write(spark: SparkSession, root: str, number: int, body: str) -> None:
    fs, path = _files(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise LoadConflict(f"manifest {number} was written since this load began") from e
        raise
    out.write(bytearray(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode()))
    out.close()


def replace_all(tables: Tables, root: str, allowed: frozenset[tuple[str, str]] = frozenset(), check: bool = True) -> int:
    """Stage, check and publish: either all eight tables are replaced, or none. Without ``check``, constraints aren't looked at."""
    staged = stage(tables, root)
    try:
        report = gate(staged, allowed) if check else []
    except LoadRejected:
        discard(staged)
        raise
    return publish(staged, report)


def live(spark: SparkSession, root: str) -> Tables:
    """The live version. Frames read before a later load keep reading the version that they began with."""
    found = live_manifest(spark, root.rstrip("/"))
    if not found:
        raise FileNotFoundError(f"{root}: no load was published")
    return from_parquet_dir(spark, f"{root.rstrip('/')}/{VERSIONS}/{found[1]['version']}")


def open_tables(spark: SparkSession, path: str) -> Tables:
    """The live version of a store, or the tables of a plain folder (one Parquet folder per table)."""
    return live(spark, path) if live_manifest(spark, path.rstrip("/")) else from_parquet_dir(spark, path)


def restore(spark: SparkSession, root: str, number: int) -> int:
    """Make an earlier version live again, by a new manifest."""
    root = root.rstrip("/")
    old = _manifest(spark, root, number)
    if not old:
        raise ValueError(f"manifest {number} is not complete")
    last = _numbers(spark, root)[0]
    _write(spark, root, last + 1, json.dumps({**old, "based_on": last, "restored": number}, sort_keys=True))
    return last + 1


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row per manifest and table: number, version, table_name, n_rows, is_live."""
    root = root.rstrip("/")
    now = live_manifest(spark, root)
    rows = [(n, m["version"], t, c, n == now[0]) for n in _numbers(spark, root) if (m := _manifest(spark, root, n))
            for t, c in sorted(m["rows"].items())]
    return spark.createDataFrame(rows, "number int, version string, table_name string, n_rows long, is_live boolean")


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the tables of versions that only manifests before the newest ``keep`` name; staged loads are not touched."""
    root = root.rstrip("/")
    named = [m["version"] for n in _numbers(spark, root) if (m := _manifest(spark, root, n))]
    gone = sorted(set(named[keep:]) - set(named[:keep]))
    for version in gone:
        fs, path = _files(spark, f"{root}/{VERSIONS}/{version}")
        fs.delete(path, True)
    return gone


def checksums(t: Tables, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Per table and column: n_values (not null) and the sum of the first 32 bits of the values' MD5: equal for
    equal bags of values. One aggregate per table."""
    parts = []
    for name, df in t.as_dict().items():
        cells = []
        for c in (columns or {}).get(name, df.columns):
            digest = F.conv(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
            cells.append(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                                  F.count(c).alias("n_values"), F.coalesce(F.sum(digest), F.lit(0)).alias("checksum")))
        parts.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""SparkSession construction and the few session-level settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings every query in this package assumes:
# - UTC session zone: month truncation of TIMESTAMP_NTZ goes through the session
#   zone, so it must be fixed for results to be zone-independent.
# - AQE on: runtime partition coalescing, skew-join splitting and runtime
#   broadcast conversion from measured (not estimated) sizes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "retenta",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster leave ``master`` unset and let spark-submit decide. In tests
    pass ``local[N]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent, ``fallback`` or a temporary folder is set, but
    only with a local master: on a cluster executors would write to their own
    disks, so there its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not fallback and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = fallback or tempfile.mkdtemp(prefix="retenta-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; the file system removes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/retenta/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, lost
    executors re-read the files, and later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, actions: Iterable[Callable[[], None]]) -> None:
    """Run a few Spark actions side by side, so that the last tasks of one leave no executor idle. The first that
    fails, in the given order, is raised when all have ended."""
    actions = [inheritable_thread_target(spark)(a) for a in actions]
    with ThreadPoolExecutor(max(1, len(actions))) as threads:
        running = [threads.submit(a) for a in actions]
    for r in running:
        r.result()

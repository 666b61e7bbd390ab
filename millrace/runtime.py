"""Session, table and scratch helpers that every other module shares."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A single-JVM session for tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the session names in spark.checkpoint.dir. Only where that is unset on one machine (tests) a temporary
    folder is taken, and then kept in the session's settings; on a cluster it must be set, as executors don't share one.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-scratch-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


#: Paths that scratch_path has given and that are still there.
HELD: list[str] = []


@contextlib.contextmanager
def released(spark: SparkSession, *keep: str) -> Iterator[list[str]]:
    """Removes what is settled within it, but for tables whose paths are put into the list that it gives."""
    before, kept = len(HELD), list(keep)
    yield kept
    for path in [x for x in HELD[before:] if x not in kept]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a settled table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    HELD.remove(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under scratch_root, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    HELD.append(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut, and a lost executor costs nothing
    that was settled before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def data_home() -> str:
    return os.environ.get("MILLRACE_DATA", "/root/testdata")

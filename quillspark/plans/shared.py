"""Tables written to the folder that driver and executors share.

Iterative and multi-pass operators cut their lineage here: a written table survives the loss of
an executor, unlike a cached or locally checkpointed one.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_folder: contextvars.ContextVar[str] = contextvars.ContextVar("folder", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Where none is configured a temporary one is set on a local master; RuntimeError on any other."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_folder.get() or f'{shared_dir(spark)}/quillspark'}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside without a path of their own are deleted at the end."""
    path = new_path(spark, "temporary")
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        delete(spark, path)


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def task_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, at least the cores at hand."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Partitions of a shuffle for each one that a table is scanned in.
SCAN_FACTOR = 8


def scan_partitions(scan: DataFrame) -> int:
    """Partitions for a shuffle of a table's scan: they follow the table's size, so that a task's share doesn't; at least the session's number."""
    return max(task_partitions(scan), SCAN_FACTOR * scan.rdd.getNumPartitions())


def dealt(scan: DataFrame, *keys: str) -> DataFrame:
    """A table's scan, dealt by keys over `scan_partitions`. Whatever groups by these keys and others needs no further shuffle."""
    return scan.repartition(scan_partitions(scan), *keys)


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan, dealt over all cores and by its size: a file may have fewer row groups than partitions that it is scanned in, and then most of these are empty."""
    return scan.repartition(scan_partitions(scan))

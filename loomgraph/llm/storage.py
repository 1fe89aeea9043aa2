"""Intermediate tables in the folder that the whole cluster shares.

The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset in
local mode, as in tests, a temporary folder of the driver is set once for the
session; a cluster must name one.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows may hold whole texts or sets; so few of them go to Python at once.
BATCH_ROWS = "1000"


def keep_batches_small(spark: SparkSession) -> None:
    """For plans that are run later, by whoever writes them: fewer rows go to Python at once from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(BATCH_ROWS) or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, and read it from there: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

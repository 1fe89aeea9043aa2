"""Tables: reading, writing, and intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset in local mode, as in tests, a folder of the driver. A cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes what :func:`written` wrote; from then on nothing reads ``df`` or what was made of it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, path: str, by: str | None = "repo_id") -> None:
    """Overwrites only the partitions that ``df`` has rows of."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def drop_partition(spark: SparkSession, path: str, repo: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={repo}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

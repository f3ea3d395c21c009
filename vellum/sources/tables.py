"""Tables between the steps of a query: written once in a folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set for a session on one machine; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/vellum-{uuid.uuid4().hex}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, folder: str):
    """(Hadoop file system, path) of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; deleted when the JVM ends, if not released before."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, folder)
    fs.mkdirs(p)  # only what exists can be marked for deletion
    fs.deleteOnExit(p)
    return f"{folder}/table"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: it outlives executors and cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote for these; nothing that still is to be computed may read them."""
    for t in tables:
        fs, p = file_system(t.sparkSession, t._written_at)
        fs.delete(p.getParent(), True)

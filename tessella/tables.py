"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which every executor can reach.

    Where none is set, a local run gets a temporary folder and a cluster an error: its executors would each write to
    their own disk.  The folder is removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/tessella-shared"
    path = f"{root}/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/table"


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out to all cores where it lies in too few and small files for them to have work: then the shuffle of a small
    table is less than what idle cores lose.  A table whose files or splits suffice is read where it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not 0 < 2 * len(df.inputFiles()) <= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if 2 * size <= split * cores else df


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` written as a table in the shared folder and read back: its lineage is cut, and losing an executor loses nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_folder = path.rpartition("/")[0]
    return out


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._shared_folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, source, content) of records and chunks."""
    return records(spark, folder).unionByName(read(spark, folder, "chunks").select(F.lit("chunks").alias("tbl"), F.col("id").alias("rec_id"), "source", "content"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "records").select(F.lit("records").alias("tbl"), F.col("id").alias("rec_id"), "source", "content")

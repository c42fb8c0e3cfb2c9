"""Readers of raw record files, and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file or folder with `src_ord`, their order in it.  Blank lines are skipped, a malformed
    line fails, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("src_ord", F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # Within a file, splits are numbered in order; several files follow by name.
    return rows.withColumn("src_ord", F.monotonically_increasing_id())


def read_raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/{name}.jsonl", RAW[name])


def read_dimension(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(id, *fields) of a JSON file that is a list of objects with id, or an object by id; of a repeated id the last
    holds, and items without id are left out.  A missing file is empty."""
    names = [f.split()[0] for f in fields.split(",")]
    if not exists(spark, path):
        return spark.createDataFrame([], f"id string, {fields}")
    text = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", f"map<string,struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>")
    as_list = F.from_json("value", f"array<struct<id:string,{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>")
    listed = F.ltrim(F.col("value")).startswith("[")
    of_map = text.where(~listed).select(F.explode(as_map).alias("id", "v")).select("id", F.lit(0).alias("at"), *(F.col(f"v.{n}").alias(n) for n in names))
    of_list = text.where(listed).select(F.posexplode(as_list).alias("at", "v")).where("v.id is not null").select("v.id", "at", *(F.col(f"v.{n}").alias(n) for n in names))
    rows = of_map.unionByName(of_list)
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "at").alias("v")).select("id", *(F.col(f"v.{n}").alias(n) for n in names))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_dimension(spark, path, "name string, title string, department string, is_bot boolean")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return read_dimension(spark, path, "name string, topic string, purpose string, is_private boolean, num_members bigint")

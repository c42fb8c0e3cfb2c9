"""Vectors remembered by model and content, so that only new contents are embedded."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.raw import exists
from ..tables import materialize, remove
from .providers import Embedder, embed_column, model_key

CACHE = "model_key string, content_hash string, embedding array<float>"


def misses(chunks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(content_hash, content), one row per content that the cache lacks for the model."""
    have = cache.where(F.col("model_key") == key).select("content_hash")
    return chunks.where("content is not null").select(content_hash(F.col("content")).alias("content_hash"), "content").dropDuplicates(["content_hash"]).join(have, "content_hash", "left_anti")


def fill(chunks: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows to append to the cache."""
    key = model_key(embedder.provider, embedder.model)
    return embed_column(misses(chunks, cache, key), embedder).select(F.lit(key).alias("model_key"), "content_hash", "embedding")


def bootstrap(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Cache rows of vectors (id, embedding) that an index has already, one for each content of its chunks (id, content)."""
    rows = chunks.where("content is not null").select("id", content_hash(F.col("content")).alias("content_hash")).join(vectors.where("embedding is not null"), "id")
    return rows.groupBy("content_hash").agg(F.min_by("embedding", "id").alias("embedding")).select(F.lit(key).alias("model_key"), "content_hash", "embedding")


#: Contents that one write embeds: what a run that is stopped loses at most.
PART = 100_000


def fill_folder(chunks: DataFrame, folder: str, embedder: Embedder, part: int = PART) -> int:
    """Embeds what the cache in `folder` lacks, part by part, each appended when it is done; returns how many contents.

    A run that fails leaves its finished parts, and the next one goes on with the rest."""
    spark, key = chunks.sparkSession, model_key(embedder.provider, embedder.model)
    have = read_folder(spark, folder)
    missing = materialize(misses(chunks, have, key))
    n = missing.count()
    parts = math.ceil(n / part)
    for k in range(parts):
        some = missing.where(F.pmod(F.xxhash64("content_hash"), F.lit(parts)) == k)
        embed_column(some, embedder).select(F.lit(key).alias("model_key"), "content_hash", "embedding").write.mode("append").parquet(folder)
    remove(missing)
    return n


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The cache in `folder`, which may not exist yet."""
    return spark.read.schema(CACHE).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], CACHE)


def assemble(chunks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """`chunks` with their embedding; a content without one has null."""
    w = Window.partitionBy("content_hash").orderBy("embedding")
    one = cache.where(F.col("model_key") == key).select("content_hash", "embedding").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return chunks.withColumn("content_hash", content_hash(F.col("content"))).join(one, "content_hash", "left").drop("content_hash")

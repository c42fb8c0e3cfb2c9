"""Raw records that keep arriving, as micro-batches: each is normalized, embedded where new, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache
from ..operators.providers import Embedder
from ..schema import RAW


def stream_raw(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """Raw records of a folder that scrapers add files to."""
    return spark.readStream.schema(RAW[name]).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest_stream(rows: DataFrame, normalize: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Documents of every micro-batch, written under the batch's number, so that a batch that is run again after a
    failure replaces itself.  A document that changes appears again; `current` picks the last one."""
    def write(batch: DataFrame, number: int) -> None:
        docs = normalize(batch.withColumn("src_ord", F.monotonically_increasing_id()))
        docs.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current(docs: DataFrame) -> DataFrame:
    """The last version of every document of all batches."""
    cols = [c for c in docs.columns if c not in ("id", "batch", "src_ord")]
    return docs.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("batch", "src_ord")).alias("r")).select("id", "r.*")


def embed_stream(docs: DataFrame, cache_path: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Vectors of contents that the cache lacks, a micro-batch at a time: a stopped run goes on where it was."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema(cache.CACHE).parquet(cache_path)
        cache.fill(batch, have.where(F.lit(True)), embedder).write.mode("append").parquet(cache_path)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Rows and sums of (ts, event_type, value) by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def high_water_stream(messages: DataFrame) -> DataFrame:
    """Newest ts per channel: where the next scrape begins."""
    return messages.groupBy("channel_id").agg(F.max(F.col("ts").try_cast("decimal(24,6)")).alias("last_ts"), F.count("*").alias("n"))

"""Figures about documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, content_hash


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def docs_and_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, docs, chunks, ratio) by source, and in all as source 'TOTAL'."""
    both = docs.select("source", F.lit(1).alias("d"), F.lit(0).alias("c")).unionAll(chunks.select("source", F.lit(0).alias("d"), F.lit(1).alias("c")))
    n = both.rollup("source").agg(F.sum("d").alias("docs"), F.sum("c").alias("chunks"), F.grouping("source").alias("g"))
    return n.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "docs", "chunks", F.round(F.try_divide("chunks", "docs"), 6).alias("ratio"))


def lengths(chunks: DataFrame) -> DataFrame:
    """One row: least, median, 90th percentile and greatest characters and tokens, whole numbers."""
    x = chunks.select(F.length("content").alias("chars"), approx_tokens(F.col("content")).alias("tokens"))
    return x.agg(*(f.cast("int").alias(f"{name}_{c}") for c in ("chars", "tokens") for name, f in (("min", F.min(c)), ("median", F.median(c)), ("p90", F.percentile(c, F.lit(0.9))), ("max", F.max(c)))))


def duplicates(chunks: DataFrame) -> DataFrame:
    """(n_chunks, n_contents, n_repeats)."""
    n, u = F.count("*"), F.countDistinct(content_hash(F.col("content")))
    return chunks.agg(n.alias("n_chunks"), u.alias("n_contents"), (n - u).alias("n_repeats"))


def raw_files(lines: DataFrame) -> DataFrame:
    """(file, n_records, n_bytes) of text lines read with their file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return lines.groupBy(name.alias("file")).agg(F.count(F.when(F.trim("value") != "", 1)).alias("n_records"), F.max("_metadata.file_size").alias("n_bytes"))


def sample(chunks: DataFrame, n: int, seed: int = 0, source: str | None = None) -> DataFrame:
    """n rows at random, the same for the same seed: the sampling is the feature."""
    rows = chunks if source is None else chunks.where(F.col("source") == source)
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)

"""Prompts: retrieved results as numbered context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "You answer questions about a team's knowledge from the context given. Say so when the context does not hold the answer, and cite what you use as [Source: title]."


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, title, source, content), numbered by rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("source", F.lit("")), F.lit(")\n"), F.coalesce("content", F.lit("")))
    # A list holds what one search returned, a few dozen rows.
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def messages(question: str, context: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"}]

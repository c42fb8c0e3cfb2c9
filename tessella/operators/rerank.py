"""Rerankers: providers that score (query, content), with a deterministic lexical one as default."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import words
from .lexical import top_k

Scorer = Callable[[Column, Column], Column]

# The chat form that a yes-or-no reranking model was trained on.
INSTRUCTION = "Given a question about an internal company knowledge base, retrieve relevant documents that answer the question"
ASKED = (
    "<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. "
    "Note that the answer can only be \"yes\" or \"no\".<|im_end|>\n<|im_start|>user\n<Instruct>: {instruction}\n<Query>: {query}\n"
)
SHOWN = "<Document>: {document}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def templated(predict: Callable[[list[tuple[str, str]]], list[float]], instruction: str = INSTRUCTION) -> Callable[[list[tuple[str, str]]], list[float]]:
    """`predict` of a yes-or-no model, its pairs put into the form above."""
    return lambda pairs: predict([(ASKED.replace("{instruction}", instruction).replace("{query}", q or ""), SHOWN.replace("{document}", d or "")) for q, d in pairs])


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's different words that the content has; an empty query scores 0."""
    q, c = F.array_distinct(words(query)), F.array_distinct(words(content))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def model_score(predict: Callable[[list[tuple[str, str]]], list[float]]) -> Scorer:
    """A scorer of a model that rates pairs of texts, batch by batch."""
    @F.pandas_udf(DoubleType())
    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(query, content))), dtype="float64")

    return run


def rerank(hits: DataFrame, k: int, scorer: Scorer = overlap_score) -> DataFrame:
    """The k best of each query's hits (query_id, id, query, content, ...) by the scorer, as rerank_score and rank."""
    scored = hits.drop("rank").withColumn("score", scorer(F.col("query"), F.col("content")))
    return top_k(scored, k).withColumnRenamed("score", "rerank_score")

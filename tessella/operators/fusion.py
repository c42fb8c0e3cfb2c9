"""Ranked lists fused by reciprocal rank, and lists cleared of near-duplicates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import words
from .lexical import top_k

MISSING_RANK = 1000


def reciprocal_ranks(signals: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, score, rank_<signal>...) of lists (query_id, id, rank from 1).

    Ranks count from 0 in the formula 1 / (k + rank); a signal without the id counts as rank 1000.  Signals are unioned
    and pivoted in one aggregation, so any number of them costs one shuffle."""
    rows = reduce(DataFrame.unionByName, (d.select("query_id", "id", (F.col("rank") - 1).alias("at"), F.lit(name).alias("signal")) for name, d in signals.items()))
    ranks = rows.groupBy("query_id", "id").agg(*(F.min(F.when(F.col("signal") == name, F.col("at"))).alias(f"rank_{name}") for name in signals))
    score = reduce(lambda a, b: a + b, (1 / (k + F.coalesce(f"rank_{name}", F.lit(MISSING_RANK)).cast("double")) for name in signals))
    return ranks.withColumn("score", score)


def fuse(signals: dict[str, DataFrame], top: int, k: int = 60) -> DataFrame:
    """The `top` best of each query, with rank."""
    return top_k(reciprocal_ranks(signals, k), top, digits=9)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets; two empty ones are equal."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def group_near_duplicates(hits: DataFrame, threshold: float, k: int = 60) -> DataFrame:
    """Result lists (query_id, id, content, rank, score) with groups of similar results reduced to their first.

    In rank order a result joins the first group that has a member above `threshold`; the first of a group gains
    1 / (k + i) for each of its members i = 0, 1, ...  The new rank goes by the new score.  A list is at most a few
    dozen rows (what a search returned), so one group of rows is one query's list."""
    schema = S.StructType([f for f in hits.schema.fields if f.name not in ("score", "rank")] + [S.StructField("score", S.DoubleType()), S.StructField("rank", S.IntegerType()), S.StructField("group_size", S.IntegerType())])
    names = schema.names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable").reset_index(drop=True)
        sets = [frozenset((c or "").lower().split()) for c in pdf["content"]]
        groups: list[list[int]] = []
        for i, s in enumerate(sets):
            for g in groups:
                if any((len(s & sets[j]) / len(s | sets[j]) if s | sets[j] else 1.0) > threshold for j in g):
                    g.append(i)
                    break
            else:
                groups.append([i])
        out = pdf.iloc[[g[0] for g in groups]].copy()
        out["group_size"] = [len(g) for g in groups]
        out["score"] = [pdf["score"][g[0]] + sum(1 / (k + i) for i in range(len(g))) for g in groups]
        out = out.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        out["rank"] = range(1, len(out) + 1)
        return out[names]

    return hits.groupBy("query_id").applyInPandas(run, schema)

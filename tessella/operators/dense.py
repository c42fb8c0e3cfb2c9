"""Exact inner-product search for many queries at once.

Queries go to the executors in blocks of a bounded size, as a matrix; each task
multiplies its vectors with it and keeps its own k best per query, so what is
shuffled is k rows per query and task, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .best import Best, in_blocks
from .lexical import top_k

QUERY_BLOCK, ROWS = 4096, 2000


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays, null stays null."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _block(vectors: DataFrame, ids: list, matrix: np.ndarray, k: int, q_kind: str) -> DataFrame:
    kind = vectors.schema["id"].dataType.simpleString()
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, m = shipped.value
        best = Best(len(ids), k)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                scores = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1) @ m.T
                row, query = np.nonzero(scores >= best.least - 1e-6)
                best.add(query, part.column(0), row, scores[row, query])
        t = best.prune()
        if t is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(t.column("q").combine_chunks()), t.column("id").combine_chunks(), t.column("score").combine_chunks()], ["query_id", "id", "score"])

    return vectors.select("id", "embedding").mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors (id, embedding) with the largest inner product with each query
    (query_id, embedding).  Null vectors never match.  Filter `vectors` first to search a part of them."""
    q_kind = queries.schema["query_id"].dataType.simpleString()

    def one(rows: list) -> DataFrame:
        if not rows:
            kind = vectors.schema["id"].dataType.simpleString()
            return vectors.sparkSession.createDataFrame([], f"query_id {q_kind}, id {kind}, score double")
        return _block(vectors, [r[0] for r in rows], np.array([r[1] for r in rows], np.float64), k, q_kind)

    return top_k(in_blocks(queries.where("embedding is not null").select("query_id", "embedding"), block, one), k)


def overfetched(vectors: DataFrame, queries: DataFrame, keep: DataFrame, k: int, factor: int = 5) -> DataFrame:
    """Search all, then filter: may return fewer than k.  Kept for results equal to systems that filter afterwards."""
    hits = dense_search(vectors, queries, k * factor).drop("rank")
    return top_k(hits.join(keep.select("id").distinct(), "id", "left_semi").select("query_id", "id", "score"), k)

"""The best rows of every query while a table is read, and query sets that are taken in blocks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..tables import shared_folder

#: Rows beyond k that a task keeps, for scores that the last digit compared rounds to another side here and there.
MARGIN = 8
DIGITS = 6


class Best:
    """The k best of each query among what a task has seen, by score (to `DIGITS` places) and id.

    What is held is bounded by the queries of a block and k; a score below a query's k-th is dropped where it is made."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k + MARGIN
        self.least = np.full(n_queries, -np.inf)
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: pa.Array, row: np.ndarray, score: np.ndarray) -> None:
        """Scores of pairs (query number, row of `ids`)."""
        rounded = np.round(score, DIGITS)
        keep = rounded >= self.least[query]
        if not keep.any():
            return
        query, row, score, rounded = query[keep], row[keep], score[keep], rounded[keep]
        self.held.append(pa.table({"q": pa.array(query.astype(np.int32)), "id": ids.take(pa.array(row)), "score": pa.array(score), "r": pa.array(-rounded)}))
        self.size += len(query)
        if self.size > 4 * self.n * self.k + 100_000:
            self.prune()

    def prune(self) -> pa.Table | None:
        if not self.held:
            return None
        t = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("r", "ascending"), ("id", "ascending")]).combine_chunks()
        q = t.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = place == self.k - 1
        self.least[q[last]] = -t.column("r").to_numpy()[last]
        t = t.filter(pa.array(place < self.k))
        self.held, self.size = [t], len(t)
        return t


def in_blocks(queries: DataFrame, size: int, search: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """`search` over all rows of `queries` (query_id, ...), `size` of them at a time.

    The driver holds one block; with more than one, every block's results (k rows a query and task) are written to the
    shared folder before the next is read, so neither the plan nor the memory grows with the number of queries."""
    rows = queries.limit(size + 1).collect()
    if len(rows) <= size:
        return search(rows)
    n = math.ceil(queries.count() / size)
    path = shared_folder(queries.sparkSession)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    out = None
    for k in range(n):
        out = search(queries.where(block == k).collect())
        out.write.mode("append").parquet(f"{path}/part-{uuid.uuid4().hex}")
    return queries.sparkSession.read.schema(out.schema).parquet(f"{path}/part-*")

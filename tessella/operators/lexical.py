"""BM25 over a table of counted texts, for many queries at once.

Texts are counted once, into a table with a row per text.  Queries go to the
executors in blocks, as a table of their terms' weights; each task scores its
texts against all of them and keeps its own k best per query.  So neither a
term that every text has nor the number of pairs of text and query makes rows:
what is shuffled is k rows per query and task.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..tables import materialize, spread
from .best import Best, in_blocks

QUERY_BLOCK, ROWS = 2048, 500


class LexicalIndex(NamedTuple):
    texts: DataFrame  # id, dl, terms, tfs: a row per text
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n, avgdl: one row


def counted(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, dl, terms, tfs) of every text: its length in words, its different words and how often each occurs."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                ends, terms, tfs, dls = [0], [], [], []
                for text in part.column(1).to_pylist():
                    w = text.lower().split() if text else []
                    n = Counter(w)
                    terms += n.keys()
                    tfs += n.values()
                    dls.append(len(w))
                    ends.append(len(terms))
                off = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dls, pa.int32()), pa.ListArray.from_arrays(off, pa.array(terms, pa.string())), pa.ListArray.from_arrays(off, pa.array(tfs, pa.int32()))], ["id", "dl", "terms", "tfs"])

    return spread(chunks.select(F.col(id_col).alias("id"), F.col(text_col))).mapInArrow(run, f"id {kind}, dl int, terms array<string>, tfs array<int>")


def postings(index: LexicalIndex) -> DataFrame:
    """(term, id, tf, dl)."""
    pair = F.explode(F.arrays_zip("terms", "tfs"))
    return index.texts.select("id", "dl", pair.alias("p")).select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").cast("bigint").alias("tf"), "dl")


def build_index(chunks: DataFrame, id_col: str = "id", text_col: str = "content", epsilon: float = 0.25) -> LexicalIndex:
    """Counted texts, idf (a negative one becomes `epsilon` times the mean) and corpus figures.

    Null or blank texts count as texts of no terms."""
    return index_of(materialize(counted(chunks, id_col, text_col)), epsilon)


def index_of(texts: DataFrame, epsilon: float = 0.25) -> LexicalIndex:
    """The index over texts counted before."""
    terms = materialize(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    stats = texts.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    raw = terms.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw"))
    return LexicalIndex(texts, raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), stats)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text); a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


class _Weights(NamedTuple):
    """A block of queries: for term number t, the queries queries[first[t]:first[t + 1]] with qtf * idf in `weight`."""

    ids: list
    number: dict[str, int]
    first: np.ndarray
    queries: np.ndarray
    weight: np.ndarray


def _weights(ids: list, rows: list) -> _Weights:
    """Of rows (query_id, term, qtf, idf)."""
    place = {q: i for i, q in enumerate(ids)}
    number = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
    t = np.array([number[r["term"]] for r in rows], np.int64)
    order = np.argsort(t, kind="stable")
    q, w = np.array([place[r["query_id"]] for r in rows], np.int64), np.array([r["qtf"] * r["idf"] for r in rows], np.float64)
    return _Weights(ids, number, np.searchsorted(t[order], np.arange(len(number) + 1)), q[order], w[order])


def _scored(texts: DataFrame, shipped, avgdl: float, k: int, k1: float, b: float, q_kind: str) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        w = shipped.value
        names, n = pa.array(list(w.number), pa.string()), len(w.ids)
        per = np.diff(w.first)
        best = Best(n, k)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(2)
                term = pa.compute.index_in(lists.flatten(), names)
                held = term.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))[held]
                term = term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)[held].astype(np.float64)
                dl = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                # Every term of a text, once for each query that has it.
                times = per[term]
                ends = np.cumsum(times)
                at_query = np.repeat(w.first[term] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
                cell = np.repeat(row, times) * n + w.queries[at_query]
                total = np.bincount(cell, np.repeat(gain, times) * w.weight[at_query], len(part) * n)
                seen = np.flatnonzero(total > 0)
                seen = seen[total[seen] >= best.least[seen % n] - 1e-6]
                best.add(seen % n, part.column(0), seen // n, total[seen])
        t = best.prune()
        if t is not None:
            yield pa.RecordBatch.from_arrays([pa.array(w.ids).take(t.column("q").combine_chunks()), t.column("id").combine_chunks(), t.column("score").combine_chunks()], ["query_id", "id", "score"])

    return texts.select("id", "dl", "terms", "tfs").mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int = 20, keep: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of the k texts that score highest, above 0, for each query (query_id, text).

    `keep` (id) restricts the texts before they are scored.  A block's terms and weights, those of `block` queries, are
    what the driver holds and broadcasts."""
    q_kind = queries.schema["query_id"].dataType.simpleString()
    avgdl = index.stats.first()["avgdl"] or 1.0
    texts = index.texts if keep is None else index.texts.join(keep.select("id").distinct(), "id", "left_semi")
    spark = queries.sparkSession

    def one(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        some = spark.createDataFrame([tuple(r) for r in rows], queries.select("query_id", "text").schema)
        # Terms that no text has weigh nothing.
        weighed = query_terms(some).join(index.terms.select("term", "idf"), "term").collect()
        return _scored(texts, spark.sparkContext.broadcast(_weights(ids, weighed)), avgdl, k, k1, b, q_kind)

    return top_k(in_blocks(queries.select("query_id", "text").distinct(), block, one), k).where("score > 0")


def top_k(scores: DataFrame, k: int, score: Column | str = "score", digits: int = 6) -> DataFrame:
    """The k best rows of each query with `rank` from 1; equal scores (to `digits` places) go by id."""
    c = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scores.withColumn("score", F.round(c, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

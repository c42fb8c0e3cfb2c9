"""Searches of a chunk table, many queries at once: substring, lexical, dense, hybrid, and the full engine.

One plan builder serves every surface; presets differ in pools, filters and
whether lists are cleared of near-duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.filters import compile_filter, date_range
from . import dense, fusion, lexical
from .rerank import Scorer, overlap_score, rerank


@dataclass(frozen=True)
class Options:
    dense_k: int = 20
    bm25_k: int = 20
    pool: int = 40
    top_k: int = 5
    rrf_k: int = 60
    dedup_threshold: float = 0.0
    source: str | None = None
    filters: dict | None = None
    after: str | None = None
    before: str | None = None


def restrict(chunks: DataFrame, o: Options) -> DataFrame:
    """Chunks of the source, the filter and the dates: filters go below every top-k, so a match is never cut off."""
    out = chunks if o.source is None else chunks.where(F.col("source") == o.source)
    if o.filters:
        out = out.where(compile_filter(o.filters, F.col("metadata")))
    return out.where(date_range(F.col("metadata"), o.after, o.before)) if o.after or o.before else out


def _restricted(o: Options) -> bool:
    return bool(o.source is not None or o.filters or o.after or o.before)


def grep(chunks: DataFrame, term: str, n: int = 10, options: Options = Options(), context: int = 200) -> DataFrame:
    """The first n chunks (by chunk_ord) that contain the term in any case, with snippet, pos and total_matches."""
    hits = restrict(chunks, options).withColumn("pos", F.instr(F.lower("content"), term.lower())).where("pos > 0")
    total = hits.agg(F.count("*").alias("total_matches"))
    best = hits.orderBy("chunk_ord").limit(n).crossJoin(F.broadcast(total))  # one row
    return best.select(F.row_number().over(Window.orderBy("chunk_ord")).alias("rank"), "id", "source", T.short_title(F.col("title")).alias("title"), T.snippet(F.col("content"), context, term).alias("snippet"), "metadata", "total_matches")


def grep_counts(chunks: DataFrame, term: str) -> DataFrame:
    return chunks.where(F.instr(F.lower("content"), term.lower()) > 0).groupBy("source").agg(F.count("*").alias("matches"))


def semantic(chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, o: Options = Options()) -> DataFrame:
    """(query_id, id, score, rank): the dense list alone, in its own order and with its own scores."""
    table = vectors.join(restrict(chunks, o).select("id"), "id", "left_semi") if _restricted(o) else vectors
    return dense.dense_search(table, query_vectors, k)


def signals(chunks: DataFrame, queries: DataFrame, o: Options = Options(), index: lexical.LexicalIndex | None = None, vectors: dict[str, DataFrame] | None = None, query_vectors: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every model's dense list, by `dense_<name>`, and BM25's.

    `vectors` and `query_vectors` are tables by model: (id, embedding) and (query_id, embedding)."""
    part = restrict(chunks, o)
    keep = part.select("id") if _restricted(o) else None
    index = index or lexical.build_index(chunks)
    out = {f"dense_{n}": dense.dense_search(t if keep is None else t.join(keep, "id", "left_semi"), query_vectors[n], o.dense_k) for n, t in sorted((vectors or {}).items())}
    return out | {"bm25": lexical.bm25_search(index, queries, o.bm25_k, keep)}


def fused(lists: dict[str, DataFrame], o: Options = Options()) -> DataFrame:
    """(query_id, id, dense_score, bm25_score, rrf_score, rank) of the lists of `signals`; dense_score is the greatest of the models'."""
    pool = fusion.fuse(lists, o.pool, o.rrf_k)
    scores = pool.select("query_id", "id", F.col("score").alias("rrf_score"), "rank").join(lists["bm25"].select("query_id", "id", F.col("score").alias("bm25_score")), ["query_id", "id"], "left")
    best = F.lit(0.0)
    for name in lists:
        if name != "bm25":
            scores = scores.join(lists[name].select("query_id", "id", F.col("score").alias(name)), ["query_id", "id"], "left")
            best = F.greatest(best, F.coalesce(name, F.lit(0.0)))
    return scores.select("query_id", "id", best.alias("dense_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "rrf_score", "rank")


def hybrid(chunks: DataFrame, queries: DataFrame, o: Options = Options(), **given) -> DataFrame:
    """The lists of `signals`, `fused`."""
    return fused(signals(chunks, queries, o, **given), o)


def stages(chunks: DataFrame, queries: DataFrame, o: Options = Options(), scorer: Scorer = overlap_score, **given) -> dict[str, DataFrame]:
    """Hits (query_id, id, source, rank) after each stage of a search: every dense list and BM25's, the fused pool of both
    pools' size, and what reranking leaves of it."""
    lists = signals(chunks, queries, o, **given)
    pool = fused(lists, replace(o, pool=o.dense_k + o.bm25_k))
    found = lists | {"rrf": pool, "rerank": answer_lists(chunks, queries, pool, replace(o, dedup_threshold=0.0), scorer)}
    source = chunks.select("id", "source")
    return {("dense" if n.startswith("dense_") and len(lists) == 2 else n): x.select("query_id", "id", "rank").join(source, "id") for n, x in found.items()}


def answer_lists(chunks: DataFrame, queries: DataFrame, hits: DataFrame, o: Options = Options(), scorer: Scorer = overlap_score) -> DataFrame:
    """Hits with their content, reranked, and cleared of near-duplicates where the threshold is above 0."""
    full = hits.join(chunks.select("id", "source", "title", "content", "metadata"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    if o.dedup_threshold <= 0:
        return rerank(full, o.top_k, scorer)
    wide = rerank(full, 3 * o.top_k, scorer).withColumn("score", F.col("rrf_score"))
    plain = wide.select("query_id", "id", "source", "title", "content", "rerank_score", "dense_score", "bm25_score", "score", "rank")
    return fusion.group_near_duplicates(plain, o.dedup_threshold, o.rrf_k).where(F.col("rank") <= o.top_k).withColumnRenamed("score", "rrf_score")


def search(chunks: DataFrame, queries: DataFrame, o: Options = Options(), scorer: Scorer = overlap_score, **given) -> DataFrame:
    return answer_lists(chunks, queries, hybrid(chunks, queries, o, **given), o, scorer)


def hit_score(rerank_score: Column, rrf_score: Column, dense_score: Column, bm25_score: Column) -> Column:
    """The first of rerank and fused score that is not 0, else the greater of the two signals."""
    return F.when(F.coalesce(rerank_score, F.lit(0.0)) != 0, rerank_score).when(F.coalesce(rrf_score, F.lit(0.0)) != 0, rrf_score).otherwise(F.greatest(dense_score, bm25_score))


def record_hits(hits: DataFrame, k: int) -> DataFrame:
    """Chunk hits (query_id, id, rank, ...) folded to the first of each record, k records per query; none for k < 1."""
    first = Window.partitionBy("query_id", "record_id").orderBy("rank")
    rows = hits.withColumn("record_id", T.record_id(F.col("id"))).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    again = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("record_rank", F.row_number().over(again)).where(F.col("record_rank") <= max(k, 0))

"""The library's front: an index of documents in a folder, with a record collection."""

from __future__ import annotations

import json
import time
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import parse_filters
from .operators import cache, collection, evaluation, lexical, search
from .operators.chunking import chunk_documents
from .operators.numbering import numbered
from .operators.prompt import contexts, messages
from .operators.providers import AnswerProvider, Embedder, HashEmbedder, model_key
from .operators.rerank import Scorer, overlap_score
from .schema import CHUNK
from .sources.raw import exists
from .store import Store
from .tables import materialize, remove


class QueryResult(NamedTuple):
    query: str
    sources: list
    answer: str
    timings: dict[str, float]


def in_chunk_order(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with chunk_ord, the number of their place among all: by source, then document, then index."""
    order = [c for c in ("source_rank", "src_ord", "ord") if c in docs.columns]
    keyed = chunks.join(docs.select(F.col("id").alias("doc_id"), *order), "doc_id")
    return numbered(keyed, [*order, "doc_id", "chunk_idx"], "chunk_ord").drop(*order)


class Index:
    """Ingest, search and the mutable collection.  Vectors and postings are tables; unchanged contents are never embedded
    again, in whichever model."""

    def __init__(self, spark: SparkSession, index_dir: str, embedders: list[Embedder] | None = None, *, scorer: Scorer = overlap_score, max_chunk_tokens: int = 512, chunk_overlap_tokens: int = 64, dedup_threshold: float = 0.0, answerer: AnswerProvider | None = None):
        self.spark, self.dir = spark, index_dir.rstrip("/")
        self.store, self.catalog, self.cache = Store(spark, f"{self.dir}/search"), Store(spark, f"{self.dir}/catalog"), f"{self.dir}/cache/vectors"
        self.embedders = embedders or [HashEmbedder()]
        self.scorer, self.most, self.overlap, self.answerer = scorer, max_chunk_tokens, chunk_overlap_tokens, answerer
        self.options = search.Options(dedup_threshold=dedup_threshold)

    # --- Ingest ---

    def exists(self) -> bool:
        return self.store.exists("chunks", "texts", *(f"vectors_{self._key(e)}" for e in self.embedders))

    @staticmethod
    def _key(e: Embedder) -> str:
        return model_key(e.provider, e.model)

    def ingest(self, docs: DataFrame, force: bool = False, changed: DataFrame | None = None) -> dict:
        """Publishes a new version over `docs`; without documents the search tables are removed.

        `changed` (id) says which documents are new or other than in the current version: only those are cut and counted
        again, and the rows of documents that are gone are left out.  `force` embeds everything again."""
        began = time.monotonic()
        if docs.isEmpty():
            self.store.clear()
            return {"documents": 0, "chunks": 0, "sources": {}, "elapsed_s": time.monotonic() - began}
        with self.store.locked():
            before = self.store if changed is not None and not force and self.exists() else None
            fresh = docs if before is None else docs.join(changed.select("id").distinct(), "id", "left_semi")
            new = chunk_documents(fresh, self.most, self.overlap)
            if before is not None:
                stay = before.read("chunks").drop("chunk_ord").join(docs.select(F.col("id").alias("doc_id")).join(changed.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "doc_id", "left_semi")
                new, old = materialize(new), materialize(stay)
                chunks = materialize(in_chunk_order(old.unionByName(new.select(*old.columns)), docs))
                texts = before.read("texts").join(old.select("id"), "id", "left_semi").unionByName(lexical.counted(new))
                index = lexical.index_of(materialize(texts))
            else:
                chunks = materialize(in_chunk_order(new, docs))
                index = lexical.build_index(chunks)
            if force:
                remove_folder(self.spark, self.cache)
            elif self.exists() and not exists(self.spark, self.cache):
                # An index without its cache: its own vectors are the cache's beginning.
                for e in self.embedders:
                    cache.bootstrap(self.store.read("chunks"), self.store.read(f"vectors_{self._key(e)}"), self._key(e)).write.mode("append").parquet(self.cache)
            for e in self.embedders:
                cache.fill_folder(chunks, self.cache, e)
            known = cache.read_folder(self.spark, self.cache)
            tables = {"chunks": chunks, "texts": index.texts, "terms": index.terms, "stats": index.stats}
            for e in self.embedders:
                tables[f"vectors_{self._key(e)}"] = cache.assemble(chunks.select("id", "content"), known, self._key(e)).select("id", "embedding")
            self.store.publish(tables, {"chunks": ["source"]})
            remove(chunks)
        sources = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per source
        return {"documents": sum(sources.values()), "chunks": self.chunks().count(), "sources": sources, "elapsed_s": time.monotonic() - began}

    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    # --- Search ---

    def search(self, queries: DataFrame, **options) -> DataFrame:
        """Result lists of queries (query_id, text); options are those of `operators.search.Options`."""
        o = replace(self.options, **options)
        return search.search(self.chunks(), queries, o, self.scorer, **self._signals(queries))

    def _signals(self, queries: DataFrame) -> dict:
        return {
            "index": lexical.LexicalIndex(self.store.read("texts"), self.store.read("terms"), self.store.read("stats")),
            "vectors": {self._key(e): self.store.read(f"vectors_{self._key(e)}") for e in self.embedders},
            "query_vectors": {self._key(e): self._embedded(queries, e) for e in self.embedders},
        }

    def semantic(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """The dense list of the first model alone: chunks with their score, in its order."""
        e = self.embedders[0]
        hits = search.semantic(self.chunks(), self.store.read(f"vectors_{self._key(e)}"), self._embedded(queries, e), k, replace(self.options, **options))
        return hits.join(self.chunks().select("id", "source", "title", "content", "metadata"), "id")

    def evaluate(self, path: str | None = None, n: int = 50) -> DataFrame:
        """Four stages of search measured on questions that the index gives itself; with `path` a report is saved there.

        Returns the mean metrics of each stage."""
        found = evaluation.mentions(self.chunks())
        asked = materialize(evaluation.synthesized_queries(found, evaluation.entities(found), n))
        truth = evaluation.labels(found).join(asked.select("query_id"), "query_id", "left_semi")
        measured = materialize(evaluation.evaluate(search.stages(self.chunks(), asked, self.options, self.scorer, **self._signals(asked)), truth))
        if path:
            with open(path, "w", encoding="utf-8") as f:
                json.dump(evaluation.report(measured, asked, truth), f, indent=2, ensure_ascii=False)
        return evaluation.summary(measured)

    @staticmethod
    def _embedded(queries: DataFrame, e: Embedder) -> DataFrame:
        from .operators.providers import embed_column

        return embed_column(queries, e, "text").select("query_id", "embedding")

    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([("q", text)], "query_id string, text string")

    def query(self, text: str, answer: bool = False, **options) -> QueryResult:
        began = time.monotonic()
        hits = self.search(self._one(text), **options)
        rows = hits.orderBy("rank").collect()  # top_k rows
        timings = {"search": time.monotonic() - began}
        said = ""
        if answer and self.answerer is not None and rows:
            context = contexts(self.spark.createDataFrame(rows, hits.schema)).first()["context"]
            said = self.answerer.generate(messages(text, context))
            timings["generate"] = time.monotonic() - began - timings["search"]
        return QueryResult(text, rows, said, timings)

    def grep(self, term: str, n: int = 10, context: int = 200, docs: DataFrame | None = None, **options) -> DataFrame:
        """The first chunks that contain the term; where nothing is indexed yet, the first of `docs`."""
        if docs is None or self.exists():
            return search.grep(self.chunks(), term, n, replace(self.options, **options), context)
        return search.grep(numbered(docs, ["source_rank", "src_ord", "id"], "chunk_ord"), term, n, replace(self.options, **options), context)

    # --- Records ---

    def _state(self) -> DataFrame:
        return self.catalog.read("records") if self.catalog.exists("records") else collection.empty(self.spark)

    def _save(self, state: DataFrame, changed: DataFrame, force: bool = False) -> dict:
        self.catalog.publish({"records": state})
        return self.ingest(self._state(), force, changed)

    def upsert_records(self, records: DataFrame | list[dict], force: bool = False) -> int:
        """Merges records; only theirs are cut, counted and (where new) embedded again.  Returns how many were given."""
        batch = records if isinstance(records, DataFrame) else collection.records_of(self.spark, records)
        bad = collection.problems(batch).limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r['id']!r}: {r['problem']}" for r in bad))
        with self.catalog.locked():
            n = batch.count()
            self._save(collection.upsert(self._state(), batch), batch.select("id"), force)
        return n

    def delete_records(self, ids: list[str]) -> int:
        gone_ids = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        with self.catalog.locked():
            before = self._state()
            gone = before.join(gone_ids, "id", "left_semi").count()
            if gone:
                self._save(collection.delete(before, ids), gone_ids)
        return gone

    def clear_records(self, source: str | None = None, filters: dict | None = None) -> int:
        with self.catalog.locked():
            before = self._state()
            kept = collection.clear(before, source, filters)
            gone = before.count() - kept.count()
            if gone:
                self._save(kept, before.join(kept.select("id"), "id", "left_anti").select("id"))
        return gone

    def records(self, source: str | None = None, filters: dict | list[str] | None = None) -> DataFrame:
        """Records in their order."""
        return collection.select_records(self._state(), source, _filter(filters)).orderBy("ord")

    def documents(self) -> DataFrame:
        """What is indexed: the documents that the current version's chunks belong to, a row each."""
        return self.chunks().groupBy(F.col("doc_id").alias("id")).agg(F.first("source").alias("source"), F.first("title").alias("title"), F.count("*").alias("chunks"), F.min("chunk_ord").alias("first"))

    def export_records(self, path: str) -> None:
        """The collection as JSON lines."""
        collection.write_records(self._state(), path)

    def fetch_records(self, ids: list[str]) -> DataFrame:
        """Records in the order of `ids`; unknown and repeated ids are left out."""
        return collection.fetch(self._state(), ids)

    def fetch_records_metadata(self, ids: list[str]) -> dict[str, dict]:
        rows = collection.fetch(self._state(), ids)
        order = {i: k for k, i in enumerate(ids)}
        flat = {r["id"]: {k: collection.scalar(v) for k, v in r["fields"].items()} for r in collection.flat_metadata(rows).collect()}  # the ids asked for
        return {i: flat[i] for i in sorted(flat, key=order.__getitem__)}

    def list_record_ids(self, source: str | None = None, filters: dict | list[str] | None = None) -> DataFrame:
        return collection.select_records(self._state(), source, _filter(filters)).orderBy("ord").select("id")

    def count_records(self, source: str | None = None, filters: dict | list[str] | None = None) -> int:
        return collection.select_records(self._state(), source, _filter(filters)).count()

    def search_records(self, text: str, k: int = 5, **options) -> DataFrame:
        """The first hit of each record, k records at most, with the record's fields; three times as many chunks are searched."""
        hits = self.search(self._one(text), top_k=3 * max(k, 0), **options)
        score = search.hit_score(F.col("rerank_score"), F.col("rrf_score"), F.col("dense_score"), F.col("bm25_score"))
        folded = search.record_hits(hits.withColumn("hit_score", score), k)
        records = self._state().select(F.col("id").alias("record_id"), F.col("title").alias("record_title"), F.col("metadata").alias("record_metadata"))
        return folded.join(records, "record_id", "left").select("record_id", F.coalesce("record_title", "title").alias("title"), "source", "content", F.coalesce("record_metadata", "metadata").alias("metadata"), F.col("hit_score").alias("score"), "record_rank")


def remove_folder(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_OPENED: dict[tuple[str, str], Index] = {}


def opened(spark: SparkSession, index_dir: str, **settings) -> Index:
    """The index of a folder, made once in this process for each folder and settings; tables are read per version anyway."""
    key = (index_dir.rstrip("/"), repr(sorted(settings.items(), key=lambda x: x[0])))
    if key not in _OPENED or _OPENED[key].spark is not spark:
        _OPENED[key] = Index(spark, index_dir, **settings)
    return _OPENED[key]


def forget() -> None:
    """Clears what `opened` remembers."""
    _OPENED.clear()


def fetched(spark: SparkSession, places: list[str], local: str) -> str:
    """The first of `places` that has an index; one on another file system is copied to `local` first, for a server to start with."""
    conf = spark._jsc.hadoopConfiguration()
    for place in places:
        p = spark._jvm.org.apache.hadoop.fs.Path(place)
        fs = p.getFileSystem(conf)
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place.rstrip('/')}/search/CURRENT")):
            continue
        to = spark._jvm.org.apache.hadoop.fs.Path(local)
        if fs.getUri().equals(to.getFileSystem(conf).getUri()):
            return place
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to.getFileSystem(conf), to, False, True, conf)
        return local
    raise FileNotFoundError(f"no index in {', '.join(places)}")


def _filter(f: dict | list[str] | None) -> dict | None:
    return parse_filters(f) if isinstance(f, list) else f


__all__ = ["CHUNK", "Index", "QueryResult", "fetched", "forget", "in_chunk_order", "opened"]

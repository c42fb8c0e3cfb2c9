"""Queries over the test tables, and the SQL that says the same.

Documents are rows of `documents` (or `records`), chunks rows of `chunks`,
search queries the titles of all documents whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.documents import adf_to_text
from ..functions.filters import compile_filter, date_range, parse_filters
from ..operators import collection as C
from ..operators import dense, evaluation, fusion, inspect, lexical, prompt, search
from ..operators.cache import assemble, bootstrap, misses
from ..operators.chunking import chunk_documents, word_windows
from ..operators.numbering import numbered
from ..schema import text_metadata
from ..sources import normalize, scrape
from ..streaming.ingest import activity
from ..tables import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f
    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- Tables ----------------------------------------------------------------------------------------------------------

def _read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), "title", F.col("doc_id").alias("chunk_ord"), F.expr("CAST(map() AS map<string,struct<kind:string,s:string,d:double,cf:string>>)").alias("metadata"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "records").dropDuplicates(["id"]).withColumn("metadata", text_metadata(F.col("metadata")))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _asked_vectors(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


def _turned(v: DataFrame) -> DataFrame:
    """A second model: the same vectors backwards, half of them with their sign turned."""
    return v.withColumn("embedding", F.transform(F.reverse("embedding"), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))


def _raw(s: SparkSession, d: str, t: str, *order: str) -> DataFrame:
    """Rows of a raw table, latest scrape of each key, with their order."""
    rows = _read(s, d, t)
    w = Window.partitionBy(*order).orderBy(F.desc("scraped_at"), *(F.desc(c) for c in ("text", "reply_count", "reaction_count") if c in rows.columns))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


_BL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _tok(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '{_BL}'), lambda t: t <> '')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_BL}|{_BL}$', '', 'g')"


_REC = "(SELECT DISTINCT ON (id) * FROM records ORDER BY id)"
_ASK = "(SELECT doc_id AS query_id, title AS text FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"

# --- Text functions --------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, len({_tok('text')})::BIGINT AS n_words, greatest(len({_tok('text')}), length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def doc_token_stats(s, d):
    t = F.col("text")
    return _read(s, d, "documents").select("doc_id", F.size(T.words(t)).cast("bigint").alias("n_words"), T.approx_tokens(t).cast("bigint").alias("tokens"))


_AT = (r"<@([\p{L}\p{N}_]+)>", r"@\1")
_MRK = [(r"<mailto:([^|>]+)\|([^>]+)>", r"\2"), (r"<tel:([^|>]+)\|([^>]+)>", r"\2"), (r"<#[\p{L}\p{N}_]+\|([^>]+)>", r"#\1"), (r"<(https?://[^|>]+)\|([^>]+)>", r"\2"), (r"<(https?://[^>]+)>", r"\1"), (r":[\p{L}\p{N}_+\-]+:", ""), (r"\*([^*]+)\*", r"\1"), (r"_([^_]+)_", r"\1"), (r"~([^~]+)~", r"\1"), (r"[ \t]+", " ")]
_HTML = [(r"<br\s*/?>", "\n"), (r"<li[^>]*>", "- "), (r"<h[1-6][^>]*>", "\n## "), (r"</h[1-6]>", "\n"), (r"<p[^>]*>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n")]


def _chain(c: str, steps: list[tuple[str, str]]) -> str:
    for a, b in steps:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


@_query(f"SELECT doc_id, md5({_strip(_chain('text', [_AT, *_MRK]))}) AS cleaned FROM documents WHERE text IS NOT NULL")
def chat_text(s, d):
    return spread(_read(s, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", F.md5(T.chat_text(F.col("text"))).alias("cleaned"))


@_query(f"SELECT doc_id, md5({_strip(_chain('text', _HTML))}) AS plain FROM documents WHERE text IS NOT NULL")
def html_text(s, d):
    return spread(_read(s, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", F.md5(T.html_to_text(F.col("text"))).alias("plain"))


@_query("SELECT doc_id, sha256(text) AS content_hash FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def content_hash_dedup(s, d):
    rows = _read(s, d, "documents").where("text is not null").withColumn("content_hash", T.content_hash(F.col("text")))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@_query(r"SELECT hash, pr_seen, branch_seen, CAST(len(list_filter(files_changed, lambda f: NOT regexp_matches(f.path, '\.ya?ml$')))AS BIGINT) AS files FROM (SELECT DISTINCT ON (hash) hash, try_cast(regexp_extract(subject, 'pull request #([0-9]+)', 1) AS BIGINT) AS pr_seen, nullif(regexp_extract(subject, 'Merged in (\S+)', 1), '') AS branch_seen, files_changed FROM git ORDER BY hash)")
def git_subjects(s, d):
    rows = _read(s, d, "git").dropDuplicates(["hash"])
    return rows.select("hash", T.pr_number(F.col("subject")).alias("pr_seen"), T.merged_branch(F.col("subject")).alias("branch_seen"), F.size(T.filter_files(F.col("files_changed"), [r"\.ya?ml$"])).cast("bigint").alias("files"))


_SECTIONS = "string_split(chr(10) || diff, chr(10) || 'diff --git a/')"


@_query(rf"""WITH g AS (SELECT DISTINCT ON (hash) hash, subject, CASE WHEN length(diff) <= 50000 THEN diff END AS diff FROM git ORDER BY hash),
s AS (SELECT hash, {_SECTIONS} AS parts FROM g WHERE coalesce(diff, '') <> ''),
k AS (SELECT hash, i, CASE WHEN i = 1 THEN substr(parts[1], 2) ELSE 'diff --git a/' || parts[i] END || CASE WHEN i < len(parts) AND parts[i] <> '' THEN chr(10) ELSE '' END AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)),
j AS (SELECT hash, coalesce(string_agg(part, '' ORDER BY i) FILTER (WHERE regexp_replace(part, '\s', '', 'g') <> '' AND NOT regexp_matches(regexp_extract(part, '^diff --git a/(\S+) b/', 1), '\.ya?ml$|^conf/')), '') AS kept FROM k GROUP BY hash)
SELECT g.hash, coalesce(j.kept, g.diff) AS diff, try_cast(nullif(regexp_extract(subject, 'pull request #([0-9]+)', 1), '') AS BIGINT) AS pr_number, nullif(regexp_extract(subject, 'Merged in (\S+)', 1), '') AS branch FROM g LEFT JOIN j USING (hash)""")
def git_diffs_filtered(s, d):
    return scrape.commits(_read(s, d, "git").dropDuplicates(["hash"]).select("hash", "subject", "diff", "files_changed"), [r"\.ya?ml$", r"^conf/"]).select("hash", "diff", "pr_number", "branch")


# --- Figures ---------------------------------------------------------------------------------------------------------


@_query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(s, d):
    return inspect.source_counts(_read(s, d, "documents"))


@_query("SELECT coalesce(CASE WHEN g = 1 THEN 'TOTAL' ELSE source END, '?') AS source, docs, chunks, round(chunks / docs, 6) AS ratio FROM (SELECT source, grouping(source) AS g, sum(d)::BIGINT AS docs, sum(c)::BIGINT AS chunks FROM (SELECT source, 1 AS d, 0 AS c FROM records UNION ALL SELECT source, 0, 1 FROM chunks) GROUP BY ROLLUP (source))")
def docs_and_chunks(s, d):
    return inspect.docs_and_chunks(_read(s, d, "records"), _read(s, d, "chunks")).withColumn("source", F.coalesce("source", F.lit("?")))


_TOKENS = f"greatest(len(list_filter(string_split_regex(coalesce(content, ''), '{_BL}'), lambda t: t <> '')), length(coalesce(content, '')) // 4)"


@_query("SELECT " + ", ".join(f"CAST(trunc({f}) AS INTEGER) AS {n}_{c}" for c in ("chars", "tokens") for n, f in (("min", f"min({c})"), ("median", f"quantile_cont({c}::DOUBLE, 0.5)"), ("p90", f"quantile_cont({c}::DOUBLE, 0.9)"), ("max", f"max({c})"))) + f" FROM (SELECT length(content) AS chars, {_TOKENS} AS tokens FROM chunks)")
def length_percentiles(s, d):
    return inspect.lengths(_read(s, d, "chunks"))


@_query("SELECT count(*) AS n_chunks, count(DISTINCT sha256(content)) AS n_contents, count(*) - count(DISTINCT sha256(content)) AS n_repeats FROM chunks")
def duplicate_summary(s, d):
    return inspect.duplicates(_read(s, d, "chunks"))


@_query("SELECT id, source FROM (SELECT DISTINCT id, source FROM chunks) ORDER BY md5('0:' || id), id LIMIT 20")
def chunk_sample(s, d):
    return inspect.sample(_read(s, d, "chunks").select("id", "source").distinct(), 20)


# --- Filters and substring search ------------------------------------------------------------------------------------


@_query(f"SELECT id FROM {_REC} WHERE lower(metadata['message_count']) = '2' AND lower(source) = 'slack'")
def filter_typed(s, d):
    return _records(s, d).where(compile_filter({"message_count": 2, "source": "Slack"}, F.col("metadata"), core=True)).select("id")


@_query(f"SELECT id FROM {_REC} WHERE lower(metadata['message_count']) = '2' AND lower(source) = 'slack'")
def filter_parsed(s, d):
    """Conditions as they are given on the command line."""
    return _records(s, d).where(compile_filter(parse_filters(["message_count=2", "source=Slack"]), F.col("metadata"), core=True)).select("id")


@_query(f"SELECT id FROM {_REC} WHERE lower(metadata['message_count']) = '3' OR lower(metadata['repo']) = 'quartz-kiln' OR (lower(source) = 'code' AND lower(metadata['language']) = 'python')")
def filter_or(s, d):
    options = {"$or": [{"message_count": 3}, {"repo": "Quartz-Kiln"}, {"source": "code", "language": "python"}]}
    return _records(s, d).where(compile_filter(options, F.col("metadata"), core=True)).select("id")


@_query(f"SELECT id, source FROM {_REC} WHERE length(substr(metadata['date'], 1, 10)) >= 10 AND substr(metadata['date'], 1, 10) >= '2024-06-01' AND substr(metadata['date'], 1, 10) < '2025-02-01'")
def filter_date_range(s, d):
    return _records(s, d).where(date_range(F.col("metadata"), "2024-06-01", "2025-02-01")).select("id", "source")


_SNIP = "(CASE WHEN length(c) <= 80 THEN c WHEN p > 0 THEN (CASE WHEN greatest(0, p - 21) > 0 THEN '...' ELSE '' END) || substr(c, greatest(0, p - 21)::INT + 1, 80) || (CASE WHEN least(length(c), greatest(0, p - 21) + 80) < length(c) THEN '...' ELSE '' END) ELSE substr(c, 1, 80) || '...' END)"


@_query(f"SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank, doc_id AS id, source, CASE WHEN length(title) <= 80 THEN title ELSE substr(title, 1, 77) || '...' END AS title, {_SNIP} AS snippet, total_matches FROM (SELECT *, instr(lower(c), 'runbook') AS p FROM (SELECT doc_id, source, title, {_strip(chr(114) + 'eplace(text, chr(10), chr(32))')} AS c, count(*) OVER () AS total_matches FROM documents WHERE instr(lower(text), 'runbook') > 0)) ORDER BY doc_id LIMIT 25")
def grep_term(s, d):
    return search.grep(_docs(s, d), "Runbook", 25, context=80).drop("metadata")


@_query("SELECT source, count(*) AS matches FROM documents WHERE instr(lower(text), 'timeout') > 0 GROUP BY source")
def grep_counts(s, d):
    return search.grep_counts(_docs(s, d), "timeout")


# --- Lexical and dense search ----------------------------------------------------------------------------------------

def _bm25(docs: str) -> str:
    """BM25 of `_ASK` over rows (id, w): common table expressions up to `bmr`, the twenty best of each query."""
    return f"""docs AS ({docs}),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('text')}) AS term FROM {_ASK}) GROUP BY ALL),
bm AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idfs USING (term) JOIN post USING (term), stats GROUP BY query_id, id),
bmr AS (SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= 20 AND score > 0)"""


_BM = _bm25(f"SELECT doc_id AS id, {_tok('text')} AS w FROM documents")


@_query(f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_terms(s, d):
    return lexical.build_index(_docs(s, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@_query(f"WITH {_BM} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bmr")
def bm25_batch_topk(s, d):
    return lexical.bm25_search(lexical.build_index(_docs(s, d)), _asked(s, d), 20)


@_query(f"WITH {_BM} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm JOIN documents ON doc_id = id WHERE score > 0 AND source = 'slack') WHERE rank <= 20 AND score > 0")
def bm25_filtered(s, d):
    docs = _docs(s, d)
    return lexical.bm25_search(lexical.build_index(docs), _asked(s, d), 20, keep=search.restrict(docs, search.Options(source="slack")))


_DV = """dv AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
dvr AS (SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM dv) WHERE rank <= 20)"""
_TURN = "[(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * list_reverse(embedding)[i + 1] FOR i IN range(len(embedding))]::DOUBLE[]"
_DW = f"""e2 AS (SELECT vec_id, {_TURN} AS e FROM embeddings),
dw AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.e, q.embedding::DOUBLE[]) AS score FROM e2 v, embeddings q WHERE q.vec_id % 100 = 0),
dwr AS (SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM dw) WHERE rank <= 20)"""


@_query(f"WITH {_DV} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM dvr")
def dense_batch_topk(s, d):
    v = _vectors(s, d)
    return dense.dense_search(v, _asked_vectors(v), 20)


@_query(f"WITH {_DV} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM dv JOIN documents ON doc_id = id WHERE source = 'slack') WHERE rank <= 20")
def dense_filtered(s, d):
    v = _vectors(s, d)
    return dense.dense_search(v.join(_docs(s, d).where("source = 'slack'").select("id"), "id", "left_semi"), _asked_vectors(v), 20)


@_query(f"WITH {_DV} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM dv JOIN documents ON doc_id = id WHERE source = 'git') WHERE rank <= 5")
def semantic_search(s, d):
    """The dense list alone, of one source: neither fused nor reranked."""
    v = _vectors(s, d)
    return search.semantic(_docs(s, d), v, _asked_vectors(v), 5, search.Options(source="git"))


@_query(f"WITH {_DV} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r0 FROM (SELECT query_id, id, round(score, 6) AS score FROM dv)) JOIN documents ON doc_id = id WHERE r0 <= 50 AND source = 'slack') WHERE rank <= 10")
def dense_overfetched(s, d):
    v = _vectors(s, d)
    return dense.overfetched(v, _asked_vectors(v), _docs(s, d).where("source = 'slack'").select("id"), 10)


@_query("SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS square, round(sqrt(list_dot_product(e, e)), 5) AS length FROM (SELECT vec_id, embedding, [x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding] AS e FROM embeddings)")
def vector_norms(s, d):
    n = dense.normalized(F.col("embedding"))
    return _vectors(s, d).select("id", F.round(dense.inner_product(F.col("embedding"), F.col("embedding")), 5).alias("square"), F.round(F.sqrt(dense.inner_product(n, n)), 5).alias("length"))


# --- Fusion, hybrid search, result lists -----------------------------------------------------------------------------


def _rrf(*signals: str) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, id, rank - 1 AS pos, '{s}' AS signal FROM {s}" for s in signals)
    score = " + ".join(f"1 / (60 + coalesce(min(pos) FILTER (WHERE signal = '{s}'), 1000))::DOUBLE" for s in signals)
    return f"SELECT query_id, id, {score} AS score FROM ({rows}) GROUP BY query_id, id"


def _best(sql: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM ({sql})) WHERE rank <= {k}"


def _signals(s, d) -> dict[str, DataFrame]:
    v = _vectors(s, d)
    return {"dense_a": dense.dense_search(v, _asked_vectors(v), 20), "bm25": lexical.bm25_search(lexical.build_index(_docs(s, d)), _asked(s, d), 20)}


@_query(f"WITH {_BM}, {_DV} {_best(_rrf('dvr', 'bmr'), 40)}")
def rrf_two_signals(s, d):
    return fusion.fuse(_signals(s, d), 40).select("query_id", "id", "score", "rank")


@_query(f"WITH {_BM}, {_DV}, {_DW} {_best(_rrf('dvr', 'dwr', 'bmr'), 40)}")
def rrf_many_signals(s, d):
    v = _vectors(s, d)
    x = _signals(s, d)
    return fusion.fuse({"dense_a": x["dense_a"], "dense_b": dense.dense_search(_turned(v), _asked_vectors(v), 20), "bm25": x["bm25"]}, 40).select("query_id", "id", "score", "rank")


def _hybrid(s, d, **more) -> DataFrame:
    v = _vectors(s, d)
    return search.hybrid(_docs(s, d), _asked(s, d), search.Options(**more), vectors={"a": v, "b": _turned(v)}, query_vectors={"a": _asked_vectors(v), "b": _asked_vectors(v)})


_HYBRID = f"""WITH {_BM}, {_DV}, {_DW}, f AS ({_best(_rrf('dvr', 'dwr', 'bmr'), 40)}),
h AS (SELECT f.query_id, f.id, greatest(0.0, coalesce(dvr.score, 0.0), coalesce(dwr.score, 0.0)) AS dense_score, coalesce(bmr.score, 0.0) AS bm25_score, f.score AS rrf_score, f.rank FROM f LEFT JOIN dvr USING (query_id, id) LEFT JOIN dwr USING (query_id, id) LEFT JOIN bmr USING (query_id, id))"""


@_query(f"{_HYBRID} SELECT * FROM h")
def hybrid_search(s, d):
    return _hybrid(s, d)


_RERANK = f"""r AS (SELECT query_id, id, dense_score, bm25_score, rrf_score, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / len(q)::DOUBLE END, 6) AS rerank_score FROM (SELECT h.*, list_distinct({_tok('a.text')}) AS q, list_distinct({_tok('d.text')}) AS c FROM h JOIN {_ASK} a USING (query_id) JOIN documents d ON d.doc_id = h.id)),
rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 5)"""


@_query(f"{_HYBRID}, {_RERANK} SELECT query_id, id, rerank_score, rrf_score, dense_score, bm25_score, rank FROM rr")
def hybrid_reranked(s, d):
    return search.answer_lists(_docs(s, d), _asked(s, d), _hybrid(s, d)).select("query_id", "id", "rerank_score", "rrf_score", "dense_score", "bm25_score", "rank")


@_query(f"{_HYBRID}, {_RERANK} SELECT query_id, md5(string_agg('[' || rank || '] Source: ' || coalesce(title, '') || ' (' || coalesce(source, '') || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS context FROM rr JOIN documents ON doc_id = id GROUP BY query_id")
def prompt_contexts(s, d):
    return prompt.contexts(search.answer_lists(_docs(s, d), _asked(s, d), _hybrid(s, d))).select("query_id", F.md5("context").alias("context"))


_WIDE = _RERANK.replace("rank <= 5", "rank <= 15")


@_query(f"""{_HYBRID.replace("WITH ", "WITH RECURSIVE ", 1)}, {_WIDE},
w AS (SELECT query_id, id, rank, rrf_score, list_distinct({_tok('text')}) AS w FROM rr JOIN documents ON doc_id = id),
near AS (SELECT a.query_id, a.rank, list(b.rank) AS js FROM w a JOIN w b ON a.query_id = b.query_id AND b.rank < a.rank WHERE (CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END) > 0.5 GROUP BY ALL),
grp(query_id, rank, first) AS (SELECT query_id, 0, []::INTEGER[] FROM (SELECT DISTINCT query_id FROM w) UNION ALL SELECT g.query_id, g.rank + 1, list_append(g.first, coalesce(list_min(list_transform(n.js, lambda j: g.first[j])), g.rank + 1)) FROM grp g JOIN w ON w.query_id = g.query_id AND w.rank = g.rank + 1 LEFT JOIN near n ON n.query_id = g.query_id AND n.rank = g.rank + 1),
whole AS (SELECT query_id, arg_max(first, rank) AS first FROM grp GROUP BY query_id),
sizes AS (SELECT query_id, f AS rank, count(*) AS n FROM (SELECT query_id, unnest(first) AS f FROM whole) GROUP BY ALL),
out AS (SELECT w.query_id, w.id, w.rrf_score + list_sum([1 / (60 + i)::DOUBLE FOR i IN range(n)]) AS score, CAST(n AS INTEGER) AS group_size FROM sizes JOIN w USING (query_id, rank))
SELECT query_id, id, rrf_score, group_size, rank FROM (SELECT query_id, id, round(score, 6) AS rrf_score, group_size, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM out) WHERE rank <= 5""")
def near_duplicate_lists(s, d):
    o = search.Options(dedup_threshold=0.5)
    return search.answer_lists(_docs(s, d), _asked(s, d), _hybrid(s, d), o).select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), "group_size", "rank")


@_query(f"{_HYBRID}, l AS (SELECT query_id, id, rank, list_distinct({_tok('text')}) AS w FROM h JOIN documents ON doc_id = id WHERE rank <= 10) SELECT a.query_id, a.id AS id_a, b.id AS id_b, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6) AS similarity FROM l a JOIN l b ON a.query_id = b.query_id AND a.rank < b.rank")
def list_similarities(s, d):
    """Similarity of the results of each list of ten."""
    hits = _hybrid(s, d).where("rank <= 10").join(_docs(s, d).select("id", "content"), "id")
    a, b = hits.select("query_id", F.col("id").alias("id_a"), F.col("rank").alias("ra"), F.col("content").alias("ca")), hits.select("query_id", F.col("id").alias("id_b"), F.col("rank").alias("rb"), F.col("content").alias("cb"))
    return a.join(b, "query_id").where("ra < rb").select("query_id", "id_a", "id_b", F.round(fusion.jaccard(F.col("ca"), F.col("cb")), 6).alias("similarity"))


_CHUNK_BM = _bm25(f"SELECT id, {_tok('content')} AS w FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id)")


@_query(f"WITH {_CHUNK_BM} SELECT query_id, id, record_id, record_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS record_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, record_id ORDER BY rank) AS nth FROM (SELECT *, regexp_replace(id, ':[^:]*$', '') AS record_id FROM bmr)) WHERE nth = 1) WHERE record_rank <= 10")
def record_hits(s, d):
    """Chunks of every source found for each query, folded to records."""
    chunks = _read(s, d, "chunks").dropDuplicates(["id"])
    lists = lexical.bm25_search(lexical.build_index(chunks), _asked(s, d), 20)
    return search.record_hits(lists, 10).select("query_id", "id", "record_id", "record_rank")


# --- Chunks ----------------------------------------------------------------------------------------------------------



def _size(c: str) -> str:
    return f"greatest(len({_words(c)}), length({c}) // 4)"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_BL}'), lambda t: t <> '')"


_SEPS = "(VALUES (1, chr(10) || chr(10)), (2, chr(10)), (3, chr(9)), (4, '. '), (5, ' ')) AS s(k, sep)"
# Each separator's packing is a fold over the parts: `held` grows until the next part would make it too large.
_CHUNKS = f"""WITH RECURSIVE doc AS (SELECT id, source, coalesce(content, '') AS text, content FROM {_REC}),
large AS (SELECT *, {_size('text')} AS n FROM doc WHERE source IS NULL OR source NOT IN ('bookmark', 'pin')),
cut AS (SELECT id, k, sep, string_split(text, sep) AS parts FROM large, {_SEPS} WHERE n > 512 AND contains(text, sep)),
fold(id, k, i, held, out) USING KEY (id, k) AS (SELECT id, k, 0::BIGINT, '', []::VARCHAR[] FROM cut
UNION SELECT id, k, i + 1, CASE WHEN fits THEN longer WHEN len(tail) > 64 THEN {_strip("array_to_string(tail[-64:], ' ') || sep || part")} ELSE part END, CASE WHEN fits OR {_strip('held')} = '' THEN out ELSE list_append(out, {_strip('held')}) END
FROM (SELECT *, held = '' OR {_size('longer')} <= 512 AS fits, {_words('held')} AS tail FROM (SELECT f.*, c.sep, c.parts[f.i + 1] AS part, CASE WHEN held = '' THEN c.parts[f.i + 1] ELSE held || c.sep || c.parts[f.i + 1] END AS longer FROM fold f JOIN cut c ON f.id = c.id AND f.k = c.k WHERE f.i < len(c.parts)))),
packed AS (SELECT id, k, CASE WHEN {_strip('held')} = '' THEN out ELSE list_append(out, {_strip('held')}) END AS pieces FROM fold),
best AS (SELECT id, arg_min(pieces, k) AS pieces FROM packed WHERE len(pieces) > 1 GROUP BY id),
all_pieces AS (SELECT l.id, l.source, coalesce(b.pieces, [array_to_string(w[i + 1 : i + 512], ' ') FOR i IN range(0, len(w), 448)]) AS pieces FROM (SELECT *, {_words('text')} AS w FROM large WHERE n > 512) l LEFT JOIN best b USING (id)),
short AS (SELECT id, source, p[j * 4000 + 1 : (j + 1) * 4000] AS content, i, j FROM (SELECT *, unnest(range((length(p) - 1) // 4000 + 1)) AS j FROM (SELECT id, source, unnest(pieces) AS p, unnest(range(len(pieces))) AS i FROM all_pieces))),
whole AS (SELECT id, source, content, 0 AS i, 0 AS j FROM doc WHERE id NOT IN (SELECT id FROM large WHERE n > 512) UNION ALL SELECT * FROM short)
SELECT id || ':' || idx AS id, id AS doc_id, source, content, CAST(idx AS INTEGER) AS chunk_idx FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS idx FROM whole)"""


@_query(_CHUNKS)
def chunk_recursive(s, d):
    return chunk_documents(_records(s, d).select("id", "source", "content", "title", "metadata")).select("id", "doc_id", "source", "content", "chunk_idx")


@_query(f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, md5(array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ')) AS content FROM (SELECT doc_id, w, unnest(range((len(w) - 1) // 448 + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '{_BL}'), lambda t: t <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)")
def chunk_word_windows(s, d):
    rows = _read(s, d, "documents").select("doc_id", F.posexplode(word_windows(F.col("text"), 512, 64)).alias("chunk_idx", "content"))
    return rows.withColumn("content", F.md5("content"))


# --- Sources ---------------------------------------------------------------------------------------------------------

_MSG = "(SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY channel_id, ts ORDER BY scraped_at DESC NULLS LAST, text DESC NULLS LAST, reply_count DESC NULLS LAST, reaction_count DESC NULLS LAST) = 1)"


def _messages(s, d) -> DataFrame:
    return _raw(s, d, "messages", "channel_id", "ts").where("ts is not null and channel_id is not null").withColumn("src_ord", F.col("channel_id"))


_CLEANED = f"{_strip(_chain(chr(116), _MRK))}"
_THREADS = f"""WITH u AS (SELECT map_from_entries(list((id, coalesce(name, id)))) AS names FROM users),
m AS (SELECT m.*, list_reduce(list_prepend(coalesce(text, ''), list_distinct(regexp_extract_all(coalesce(text, ''), '<@([\\p{{L}}\\p{{N}}_]+)>', 1))), lambda a, b: replace(a, '<@' || b || '>', '@' || coalesce(names[b], b))) AS t FROM {_MSG} m, u WHERE ts IS NOT NULL AND channel_id IS NOT NULL AND coalesce(subtype, '') NOT IN {normalize.SYSTEM_SUBTYPES}),
c AS (SELECT m.*, {_CLEANED} AS clean, coalesce(u.name, m.user_id, '') || CASE WHEN coalesce(u.title, '') <> '' THEN ' (' || u.title || ')' ELSE '' END AS label, CASE WHEN coalesce(thread_ts, '') <> '' THEN thread_ts WHEN coalesce(reply_count, 0) > 0 THEN ts END AS key, coalesce(try_cast(ts AS DOUBLE), 0) AS tsd FROM m LEFT JOIN users u ON u.id = m.user_id),
d AS (SELECT key, channel_id, coalesce(string_agg(label || ': ' || clean, chr(10) ORDER BY tsd) FILTER (WHERE clean <> ''), '') AS content, arg_min(coalesce(channel_name, ''), tsd) AS channel, arg_min(clean, tsd) AS clean, min(tsd) AS tsd, count(*) AS n, sum(coalesce(reaction_count, 0))::BIGINT AS reactions FROM c WHERE key IS NOT NULL GROUP BY key, channel_id
UNION ALL SELECT ts, channel_id, label || ': ' || clean, coalesce(channel_name, ''), clean, tsd, 1, coalesce(reaction_count, 0) FROM c WHERE key IS NULL AND length(clean) >= 20)
SELECT 'slack:' || channel || ':' || key AS id, md5(content) AS content, '#' || channel || ': ' || substr(clean, 1, 80) AS title, n::VARCHAR AS message_count, reactions::VARCHAR AS reaction_count, strftime(make_timestamp((tsd * 1000000)::BIGINT), '%Y-%m-%d') AS date FROM d WHERE length(content) >= 20"""


@_query(_THREADS)
def thread_documents(s, d):
    docs = normalize.messages(_messages(s, d), _read(s, d, "users"), by_channel=True)
    m = lambda k: F.col("metadata")[k]["s"]
    return docs.select("id", F.md5("content").alias("content"), "title", m("message_count").alias("message_count"), m("reaction_count").alias("reaction_count"), m("date").alias("date"))


_THREADS_BY_TS = _THREADS.replace("ORDER BY tsd)", "ORDER BY tsd, channel_id, label || ': ' || clean)").replace("SELECT key, channel_id, coalesce(", "SELECT key, NULL AS channel_id, coalesce(").replace("arg_min(coalesce(channel_name, ''), tsd)", "arg_min(coalesce(channel_name, ''), (tsd, channel_id))").replace("arg_min(clean, tsd)", "arg_min(clean, (tsd, channel_id))").replace("WHERE key IS NOT NULL GROUP BY key, channel_id", "WHERE key IS NOT NULL GROUP BY key")


@_query(_THREADS_BY_TS)
def thread_documents_by_ts(s, d):
    """Threads keyed by thread_ts alone, as a folder of raw files is read."""
    docs = normalize.messages(_messages(s, d), _read(s, d, "users"))
    m = lambda k: F.col("metadata")[k]["s"]
    return docs.select("id", F.md5("content").alias("content"), "title", m("message_count").alias("message_count"), m("reaction_count").alias("reaction_count"), m("date").alias("date"))


def _normal(docs: DataFrame, *fields: str) -> DataFrame:
    m = lambda k: F.try_element_at("metadata", F.lit(k))["s"]
    return docs.select("id", F.md5("content").alias("content"), "title", *(m(f).alias(f) for f in fields))


_H12 = "substr(sha256({}), 1, 12)"


@_query(f"SELECT 'atlassian:' || {_H12.format('t')} AS id, md5(text) AS content, substr(t, 1, 120) AS title, kind AS source_type, coalesce(space, '') AS space FROM (SELECT *, CASE WHEN kind = 'jira' THEN 'K-' || doc_id || ': ' || coalesce(title, '') ELSE coalesce(title, '') END AS t FROM (SELECT *, CASE WHEN source = 'atlassian' THEN 'jira' ELSE 'confluence' END AS kind FROM documents)) WHERE length(coalesce(text, '')) >= 20")
def wiki_documents(s, d):
    """Documents as wiki pages, those of the ticket source as tickets."""
    kind = F.when(F.col("source") == "atlassian", "jira").otherwise("confluence")
    rows = _read(s, d, "documents").select(kind.alias("type"), "title", F.col("text").alias("content"), "space", F.lit("").alias("ancestors"), F.concat(F.lit("K-"), "doc_id").alias("key"), F.col("title").alias("summary"), F.col("space").alias("project"), F.col("doc_id").alias("src_ord"))
    return _normal(normalize.atlassian(rows), "source_type", "space")


@_query(f"SELECT 'gdrive:' || coalesce(rec_id, {_H12.format(chr(99) + 'oalesce(title, chr(32))').replace('chr(32)', chr(39) * 2)}) AS id, md5({_strip('text')}) AS content, substr(coalesce(title, ''), 1, 120) AS title, coalesce(space, '') AS path, replace(lower(coalesce(lang, 'doc')), 'google ', '') AS doc_type FROM documents WHERE length({_strip(chr(99) + 'oalesce(text, chr(32))')}) >= 20")
def drive_documents(s, d):
    rows = _read(s, d, "documents").select(F.col("rec_id").alias("file_id"), F.col("title").alias("name"), F.lit("").alias("owner"), F.col("text").alias("content"), F.lit("text/plain").alias("mime_type"), F.col("lang").alias("file_type"), F.col("space").alias("path"), F.col("doc_id").alias("src_ord"))
    return _normal(normalize.gdrive(rows), "path", "doc_type")


@_query(f"SELECT 'file:' || coalesce(rec_id, '') AS id, md5({_strip('text')}) AS content, coalesce(title, 'unknown') AS title, coalesce(lang, '') AS file_type, coalesce(source, '') AS channel_name FROM documents WHERE length({_strip(chr(99) + 'oalesce(text, chr(32))')}) >= 20")
def file_documents(s, d):
    rows = _read(s, d, "documents").select(F.col("rec_id").alias("file_id"), F.col("title").alias("file_name"), F.col("lang").alias("file_type"), F.lit("txt").alias("extraction_method"), F.col("source").alias("channel_name"), F.col("text").alias("content"), F.col("doc_id").alias("src_ord"))
    return _normal(normalize.files_extracted(rows), "file_type", "channel_name")


@_query(f"SELECT 'bookmark:' || {_H12.format('link')} AS id, md5(text || ': ' || link) AS content, text AS title, coalesce(channel_name, '') AS channel_name, link FROM (SELECT text, channel_name, unnest(links) AS link FROM messages) WHERE coalesce(text, '') <> '' AND coalesce(link, '') <> ''")
def bookmark_documents(s, d):
    rows = _read(s, d, "messages").select(F.col("text").alias("title"), "channel_name", F.explode("links").alias("link"), F.lit(0).alias("src_ord"))
    return _normal(normalize.bookmarks(rows), "channel_name", "link")


@_query(_THREADS[:_THREADS.index("c AS (SELECT")].rstrip().rstrip(",") + f", c AS (SELECT *, {_CLEANED} AS clean FROM m) SELECT 'pin:' || coalesce(channel_name, '') || ':' || coalesce(ts, '0') AS id, md5(clean) AS content, 'Pinned in #' || coalesce(channel_name, '') || ': ' || substr(clean, 1, 60) AS title, coalesce(channel_name, '') AS channel_name FROM c WHERE length(clean) >= 20")
def pin_documents(s, d):
    rows = _messages(s, d).where(~F.coalesce("subtype", F.lit("")).isin(*normalize.SYSTEM_SUBTYPES)).withColumn("src_ord", F.lit(0))
    return _normal(normalize.pins(rows, _read(s, d, "users")), "channel_name")


@_query(f"SELECT 'code:' || repo || ':' || path AS id, md5('# ' || repo || '/' || path || chr(10) || chr(10) || content) AS content, repo || '/' || path AS title, language, path FROM (SELECT coalesce(metadata['repo'], '') AS repo, coalesce(metadata['path'], '') AS path, coalesce(metadata['language'], '') AS language, content FROM {_REC} WHERE source = 'code') WHERE length(content) >= 100")
def code_documents(s, d):
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    rows = _read(s, d, "records").dropDuplicates(["id"]).where("source = 'code'").select(m("repo").alias("repo"), m("path").alias("path"), m("language").alias("language"), "content", F.length("content").alias("size_bytes"), F.lit(0).alias("src_ord"))
    return _normal(normalize.code(rows), "language", "path")


@_query(f"""WITH g AS (SELECT DISTINCT ON (hash) * FROM git ORDER BY hash),
c AS (SELECT *, {_strip("coalesce(body, '')")} AS about, concat_ws(chr(10), nullif(CASE WHEN about <> '' THEN coalesce(author, '') || ': ' || about END, ''), nullif(array_to_string(list_transform(list_filter(files_changed, lambda f: coalesce(f.path, '') <> ''), lambda f: coalesce(author, '') || ' on ' || f.path || ': ' || f.path), chr(10)), '')) AS content FROM g)
SELECT 'bitbucket:' || coalesce(repo, '') || ':' || coalesce(pr_number, 0) AS id, md5(content) AS content, substr(coalesce(repo, '') || ' PR#' || coalesce(pr_number, 0) || ': ' || coalesce(subject, ''), 1, 120) AS title, len(files_changed)::VARCHAR AS comment_count, coalesce(author, '') AS approvals FROM c WHERE length(content) >= 20""")
def pull_request_documents(s, d):
    """Commits as pull requests: their files as comments, their author as who approved."""
    said = F.transform("files_changed", lambda f: F.struct(F.col("author").alias("author"), f["path"].alias("content"), F.lit("").alias("created_on"), f["path"].alias("path"), F.lit(1).cast("bigint").alias("line")))
    rows = _read(s, d, "git").dropDuplicates(["hash"]).select("repo", F.col("pr_number").alias("pr_id"), F.col("subject").alias("title"), F.col("body").alias("description"), "author", F.lit("MERGED").alias("state"), F.col("branch").alias("source_branch"), F.lit("main").alias("target_branch"), F.lit("").alias("created_on"), F.lit("").alias("updated_on"), said.alias("comments"), F.array(F.coalesce("author", F.lit("")), F.coalesce("author", F.lit(""))).alias("approvals"), F.lit(0).alias("src_ord"))
    return _normal(normalize.bitbucket(rows), "comment_count", "approvals")


_SKIP = r"(\.min\.js|\.min\.css|_pb2\.py|_pb2_grpc\.py|\.pb\.go)$"
_SKIP_DIRS = "(^|/)((" + "|".join(x.replace(".", r"\.") for x in scrape.SKIPPED_FOLDERS) + ")/|" + "|".join(x.replace(".", r"\.") for x in scrape.SKIPPED_STARTS) + ")"


@_query(rf"SELECT path, coalesce(map {T.LANGUAGES}[regexp_extract(path, '\.([^./]+)$', 1)], 'unknown') AS language, coalesce(lower(regexp_extract(path, '\.([^./]+)$', 1)) IN {scrape.CODE_ENDINGS} AND regexp_extract(path, '([^/]+)$', 1) NOT IN {scrape.SKIPPED_NAMES} AND NOT regexp_matches(path, '{_SKIP}') AND NOT regexp_matches(path, '{_SKIP_DIRS}') AND n BETWEEN 100 AND 100000, false) AS wanted FROM (SELECT f.path AS path, max(length(coalesce(diff, ''))) AS n FROM (SELECT diff, unnest(files_changed) AS f FROM git) GROUP BY 1)")
def code_scan(s, d):
    """Paths of commits, judged as a scan of the tree would; the size is that of the largest diff they are in."""
    rows = _read(s, d, "git").select("diff", F.explode("files_changed").alias("f")).groupBy(F.col("f.path").alias("path")).agg(F.max(F.length(F.coalesce("diff", F.lit("")))).alias("n"))
    return rows.select("path", T.language(F.col("path")).alias("language"), F.coalesce(scrape.wanted_code(F.col("path"), F.col("n")), F.lit(False)).alias("wanted"))


@_query("WITH RECURSIVE f AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer), p(id, path, up) AS (SELECT id, name, parent FROM f UNION ALL SELECT p.id, f.name || ' > ' || p.path, f.parent FROM p JOIN f ON f.id = p.up) SELECT id, path FROM p WHERE up IS NULL")
def folder_paths(s, d):
    """Customers as folders of nations of regions."""
    part = lambda t, k, n, p: _read(s, d, t).select(F.concat(F.lit(k), f"{k}_{n}key").alias("id"), F.col(f"{k}_name").alias("name"), p.alias("parent"))
    folders = part("region", "r", "region", F.lit(None).cast("string")).unionByName(part("nation", "n", "nation", F.concat(F.lit("r"), "n_regionkey"))).unionByName(part("customer", "c", "cust", F.concat(F.lit("n"), "c_nationkey")))
    return scrape.folder_paths(folders)


@_query(f"SELECT doc_id, md5({_strip('coalesce(title, chr(63)) || chr(10) || chr(45) || chr(32) || coalesce(source, chr(63)) || chr(96) || chr(96) || chr(96) || chr(10) || doc_id || chr(10) || chr(96) || chr(96) || chr(96)')}) AS text FROM documents")
def tree_text(s, d):
    """Title, source and id of documents as a tree of a heading, a list and a block of code, and back to text."""
    text = lambda c: F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("?")).alias("text"))
    rows = _read(s, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("heading").alias("type"), F.array(text(F.col("title"))).alias("content"))).alias("h"), F.to_json(F.struct(F.lit("listItem").alias("type"), F.array(text(F.col("source"))).alias("content"))).alias("i"), F.to_json(F.struct(F.lit("codeBlock").alias("type"), F.array(text(F.col("doc_id").cast("string"))).alias("content"))).alias("c"))
    tree = F.concat(F.lit('{"type":"doc","content":['), "h", F.lit(',{"type":"bulletList","content":['), "i", F.lit("]},"), "c", F.lit("]}"))
    return rows.select("doc_id", F.md5(adf_to_text(tree)).alias("text"))


_GIT = f"""WITH g AS (SELECT DISTINCT ON (hash) *, {_strip("coalesce(subject, '')")} AS sub, {_strip("coalesce(body, '')")} AS bod FROM git ORDER BY hash),
d AS (SELECT *, concat_ws(chr(10), sub, nullif(bod, ''), 'Author: ' || coalesce(author, ''), 'Date: ' || coalesce(date, ''), 'PR: #' || nullif(pr_number, 0), 'Branch: ' || nullif(branch, ''),
CASE WHEN len(files_changed) > 0 THEN 'Files changed:' || chr(10) || array_to_string(list_transform(files_changed, lambda f: '  ' || coalesce(f.status, '') || ' ' || coalesce(f.path, '')), chr(10)) END,
CASE WHEN coalesce(diff, '') <> '' THEN 'Diff:' || chr(10) || diff WHEN coalesce(diff_stat, '') <> '' THEN 'Diff stat:' || chr(10) || diff_stat END) AS content FROM g)
SELECT 'git:' || repo || ':' || hash AS id, md5(content) AS content, CASE WHEN nullif(pr_number, 0) IS NOT NULL THEN repo || ' PR#' || pr_number || ': ' || substr(sub, 1, 70) ELSE repo || ': ' || substr(sub, 1, 80) END AS title, author, nullif(branch, '') AS branch FROM d WHERE length(content) >= 10"""


@_query(_GIT)
def git_documents(s, d):
    docs = normalize.git(_read(s, d, "git").dropDuplicates(["hash"]).withColumn("src_ord", F.lit(0)))
    m = lambda k: F.try_element_at("metadata", F.lit(k))["s"]
    return docs.select("id", F.md5("content").alias("content"), "title", m("author").alias("author"), m("branch").alias("branch"))


@_query("SELECT id, source, sha256(content) AS content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, c) AS n FROM (SELECT id, source, content, 0 AS r, content AS c FROM records UNION ALL SELECT doc_id, source, content, 1, id FROM chunks)) WHERE n = 1")
def union_documents(s, d):
    """Records before the documents of chunks; the first of an id stays."""
    a = _read(s, d, "records").select("id", "source", "content", F.col("content").alias("src_ord"))
    b = _read(s, d, "chunks").select(F.col("doc_id").alias("id"), "source", "content", F.col("id").alias("src_ord"))
    return normalize.union_documents([a, b]).select("id", "source", T.content_hash(F.col("content")).alias("content"))


@_query(f"SELECT DISTINCT id FROM (SELECT user_id AS id FROM messages UNION ALL SELECT unnest(regexp_extract_all(coalesce(text, ''), '<@([\\p{{L}}\\p{{N}}_]+)>', 1)) FROM messages) WHERE id IS NOT NULL AND id <> '' AND id NOT IN (SELECT id FROM users WHERE id IS NOT NULL)")
def unknown_users(s, d):
    return scrape.unknown_users(_read(s, d, "messages"), _read(s, d, "users"))


@_query("SELECT file_id, r.ts AS ts, r.channel_id AS channel_id, r.name AS file_name FROM (SELECT f.id AS file_id, arg_min({'ts': ts, 'channel_id': channel_id, 'name': f.name}, (coalesce(try_cast(ts AS DOUBLE), -1), coalesce(channel_id, ''))) AS r FROM (SELECT ts, channel_id, unnest(files) AS f FROM messages) GROUP BY f.id)")
def attached_files(s, d):
    return scrape.attached_files(_read(s, d, "messages")).select("file_id", "ts", "channel_id", "file_name")


@_query("SELECT channel_id, arg_max(ts, try_cast(ts AS DOUBLE)) AS last_ts, count(*) AS message_count FROM messages GROUP BY channel_id")
def high_water(s, d):
    return scrape.high_water(_read(s, d, "messages"))


@_query(r"SELECT channel_id, ts, array_to_string(regexp_extract_all(text, '<(https?://[^|>]+)(?:\|[^>]*)?>', 1), ' ') AS links, CAST(coalesce(list_sum(list_transform(reactions, lambda r: r.count)), 0) AS BIGINT) AS reaction_count, count(*) AS n FROM (SELECT channel_id, ts, coalesce(text, '') AS text, reactions FROM messages) GROUP BY ALL")
def message_records(s, d):
    rows = scrape.message_records(_read(s, d, "messages").select("channel_id", "ts", "text", "reactions"))
    return rows.withColumn("links", F.array_join("links", " ")).groupBy("channel_id", "ts", "links", "reaction_count", F.coalesce("text", F.lit("")).alias("t")).agg(F.count("*").alias("m")).groupBy("channel_id", "ts", "links", "reaction_count").agg(F.sum("m").alias("n"))


@_query("SELECT id FROM records WHERE id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL) GROUP BY id")
def unseen_records(s, d):
    return scrape.unseen(_read(s, d, "records").select("id"), _read(s, d, "chunks").select(F.col("doc_id").alias("id")), "id").distinct()


# --- Vectors remembered ----------------------------------------------------------------------------------------------


def _cache(s, d) -> DataFrame:
    """What an earlier run embedded: vectors by content of the documents they belong to."""
    docs = _read(s, d, "documents").where("text is not null").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("id"))
    return docs.join(_vectors(s, d), "id").select(F.lit("m").alias("model_key"), "content_hash", "embedding")


_CACHED = "(SELECT sha256(text) AS h, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1)"


@_query(f"SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT h FROM {_CACHED} JOIN embeddings ON vec_id = id)")
def embed_cache_misses(s, d):
    return misses(_docs(s, d).select("id", "content"), _cache(s, d), "m").select("content_hash")


@_query(f"SELECT d.doc_id AS id, round(e.embedding[1]::DOUBLE, 6) AS first FROM documents d LEFT JOIN (SELECT h, embedding FROM {_CACHED} JOIN embeddings ON vec_id = id) e ON sha256(d.text) = e.h")
def embed_cache_assembled(s, d):
    return assemble(_docs(s, d).select("id", "content"), _cache(s, d), "m").select("id", F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first"))


@_query("SELECT sha256(d.text) AS content_hash, round(arg_min(e.embedding[1], d.doc_id)::DOUBLE, 6) AS first FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY 1")
def embed_cache_bootstrap(s, d):
    """The cache that an index with vectors but without a cache begins with."""
    return bootstrap(_docs(s, d).select("id", "content"), _vectors(s, d), "m").select("content_hash", F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first"))


# --- Collection ------------------------------------------------------------------------------------------------------



def _catalog(s, d) -> DataFrame:
    """All records, placed by id."""
    return numbered(_records(s, d).select(*C.COLUMNS), ["id"], "ord")


def _batch(s, d) -> DataFrame:
    """What comes then: every chunk under its document's id, and every message under its own, in the order of ids and contents.

    Documents of chunks are among the records, those of messages are not."""
    chunk = _read(s, d, "chunks").select(F.col("doc_id").alias("id"), "source", "content", "title", text_metadata(F.col("metadata")).alias("metadata"), F.struct(F.col("id"), F.coalesce("content", F.lit("")).alias("content")).alias("src_ord"))
    own = F.concat(F.lit("message:"), F.coalesce("channel_id", F.lit("")), F.lit(":"), F.coalesce("ts", F.lit("")))
    said = _read(s, d, "messages").select(own.alias("id"), F.lit("message").alias("source"), F.col("text").alias("content"), F.col("channel_name").alias("title"), F.lit(None).cast("map<string,string>").alias("metadata"))
    said = said.withColumn("metadata", text_metadata(F.col("metadata"))).withColumn("src_ord", F.struct(F.col("id"), F.coalesce("content", F.lit("")).alias("content")))
    return chunk.unionByName(said)


_CATALOG = f"(SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord FROM {_REC})"
_BATCH = """(SELECT id, arg_max({'c': content}, (own, coalesce(content, ''))).c AS content, min((own, coalesce(content, ''))) AS first FROM (SELECT doc_id AS id, id AS own, content FROM chunks
UNION ALL SELECT 'message:' || coalesce(channel_id, '') || ':' || coalesce(ts, ''), 'message:' || coalesce(channel_id, '') || ':' || coalesce(ts, ''), text FROM messages) GROUP BY id)"""


@_query(f"SELECT coalesce(s.id, b.id) AS id, md5(CASE WHEN b.id IS NULL THEN s.content ELSE b.content END) AS content, CAST(coalesce(s.ord, (SELECT max(ord) FROM {_CATALOG}) + row_number() OVER (PARTITION BY s.ord IS NULL ORDER BY b.first, b.id)) AS BIGINT) AS ord FROM {_CATALOG} s FULL JOIN {_BATCH} b ON s.id = b.id")
def catalog_upsert(s, d):
    return C.upsert(_catalog(s, d), _batch(s, d)).select("id", F.md5("content").alias("content"), F.col("ord").cast("bigint").alias("ord"))


@_query(f"SELECT id, ord FROM {_CATALOG} WHERE id NOT IN (SELECT id FROM records WHERE source = 'git')")
def catalog_delete(s, d):
    return C.delete(_catalog(s, d), _read(s, d, "records").where("source = 'git'").select("id")).select("id", "ord")


@_query(f"SELECT id, ord FROM {_CATALOG} WHERE source = 'slack' AND lower(metadata['message_count']) = '2'")
def catalog_select(s, d):
    return C.select_records(_catalog(s, d), "slack", {"message_count": 2}).select("id", "ord")


@_query(f"SELECT id, ord FROM {_CATALOG} WHERE NOT (source = 'slack' AND coalesce(lower(metadata['message_count']) = '2', false))")
def catalog_clear(s, d):
    return C.clear(_catalog(s, d), "slack", {"message_count": 2}).select("id", "ord")


@_query(f"SELECT id, CASE WHEN trim(coalesce(id, '')) = '' THEN 'id must not be blank' WHEN trim(coalesce(source, '')) = '' THEN 'source must not be blank' WHEN content IS NULL THEN 'content must be text' WHEN title IS NULL THEN 'title must be text' END AS problem FROM {_REC} WHERE content IS NULL OR title IS NULL OR trim(coalesce(source, '')) = ''")
def record_problems(s, d):
    return C.problems(_records(s, d))


@_query(f"SELECT id, coalesce(metadata['date'], '') AS date, source AS source_field, title AS title_field FROM {_REC}")
def record_fields(s, d):
    rows = C.flat_metadata(_records(s, d))
    f = lambda k: F.try_element_at("fields", F.lit(k))["s"]
    return rows.select("id", F.coalesce(f("date"), F.lit("")).alias("date"), f("source").alias("source_field"), f("title").alias("title_field"))


# --- Evaluation ------------------------------------------------------------------------------------------------------

_FOUND = "f AS (SELECT entity, doc_id AS id, source, title FROM (SELECT doc_id, source, title, unnest(regexp_extract_all(coalesce(text, ''), '\\b([A-Z]{2,10}-\\d{1,6})\\b', 1)) AS entity FROM documents) WHERE entity NOT IN ('UTF-8', 'ISO-8859', 'US-ASCII', 'X-HTTP', 'X-API', 'X-CSRF') AND entity NOT LIKE 'HTTP-%' AND entity NOT LIKE 'SHA-%')"
_ENT = "e AS (SELECT entity, count(DISTINCT source) AS n_sources, count(*) AS mentions, count(DISTINCT id) AS n_chunks FROM f GROUP BY entity HAVING count(DISTINCT source) >= 2)"


@_query(f"WITH {_FOUND} SELECT entity, id, count(*) AS n FROM f GROUP BY entity, id")
def entity_mentions(s, d):
    return evaluation.mentions(_docs(s, d)).groupBy("entity", "id").agg(F.count("*").alias("n"))


@_query(f"WITH {_FOUND}, {_ENT} SELECT * FROM e")
def cross_source_entities(s, d):
    return evaluation.entities(evaluation.mentions(_docs(s, d)))


@_query(rf"""WITH {_FOUND.replace("doc_id AS id, source, title FROM (SELECT doc_id, source, title,", "doc_id AS id, source, trim(coalesce(title, '')) AS title FROM (SELECT doc_id, source, title,")}, {_ENT},
p AS (SELECT *, contains(title, entity) AS has, trim(regexp_replace(title, '^[A-Z]{{2,10}}-\d{{1,6}}\s*[-:]\s*', '')) AS bare FROM f JOIN e USING (entity)),
q AS (SELECT *, CASE WHEN source = 'atlassian' AND has AND length(bare) > 10 THEN 1 WHEN source = 'atlassian' AND length(title) > 10 THEN 2 WHEN source = 'git' AND has AND length(title) > 10 THEN 3 END AS pr FROM p)
SELECT entity AS query_id, arg_min(CASE pr WHEN 1 THEN bare WHEN 2 THEN title ELSE trim(regexp_replace(title, '^(feat|fix|chore|refactor|docs)\s*[:(]\s*', '')) END, (pr, id)) AS text FROM q WHERE pr IS NOT NULL GROUP BY entity, n_sources, mentions ORDER BY n_sources DESC, mentions DESC, entity LIMIT 50""")
def synthesized_queries(s, d):
    found = evaluation.mentions(_docs(s, d))
    return evaluation.synthesized_queries(found, evaluation.entities(found))


_TRUTH = "truth AS (SELECT a.doc_id AS query_id, b.doc_id AS id, b.source FROM documents a JOIN documents b ON a.space = b.space AND a.source <> b.source WHERE a.doc_id % 100 = 0 AND a.title IS NOT NULL)"




def _measured(head: str, stages: dict[str, str]) -> str:
    """Metrics by stage of lists (query_id, id, rank) in the tables of `stages`; n_hits counts the right ones."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS stage, query_id, id, rank FROM {t}" for n, t in stages.items())
    return f"""{head}, {_TRUTH}, hits AS (SELECT b.stage, b.query_id, b.id, d.source, b.rank FROM ({rows}) b JOIN documents d ON d.doc_id = b.id),
stg AS (SELECT unnest({list(stages)}) AS stage),
src AS (SELECT stage, query_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM hits h WHERE h.stage = stg.stage AND h.query_id = t.query_id AND h.source = t.source)) AS seen FROM stg, (SELECT DISTINCT query_id, source FROM truth) t GROUP BY stage, query_id),
siz AS (SELECT query_id, count(DISTINCT id) AS n FROM truth GROUP BY query_id),
fnd AS (SELECT h.stage, h.query_id, count(t.id) AS ok, max(CASE WHEN t.id IS NOT NULL THEN 1.0 / h.rank END) AS mrr FROM hits h LEFT JOIN (SELECT DISTINCT query_id, id FROM truth) t USING (query_id, id) GROUP BY h.stage, h.query_id)
SELECT src.stage, src.query_id, round(src.seen / src.n, 6) AS source_recall, round(coalesce(fnd.ok, 0) / siz.n, 6) AS entity_recall, round(coalesce(fnd.mrr, 0)::DOUBLE, 6) AS mrr, coalesce(fnd.ok, 0) AS n_hits FROM src JOIN siz USING (query_id) LEFT JOIN fnd USING (stage, query_id)"""


def _scores(s, d, lists: dict[str, DataFrame]) -> DataFrame:
    """Lists measured against documents of the query's space and another source.

    What there is to find is counted by space and source, and a hit is right by its own space and source: documents of a
    space are never paired with its queries."""
    docs = _read(s, d, "documents")
    asked = docs.where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("space").alias("asked_space"), F.col("source").alias("own"))
    counts = docs.groupBy(F.col("space").alias("asked_space"), "source").agg(F.count("*").alias("n_right"))
    expected = asked.join(counts, "asked_space").where("own <> source").select("query_id", "source", "n_right")
    of = docs.select(F.col("doc_id").alias("id"), "source", "space")
    out = None
    for stage, hits in lists.items():
        marked = hits.select("query_id", "id", "rank").join(of, "id").join(asked, "query_id").withColumn("ok", F.coalesce((F.col("space") == F.col("asked_space")) & (F.col("source") != F.col("own")), F.lit(False)))
        part = evaluation.scored(marked, expected).select(F.lit(stage).alias("stage"), "query_id", *(F.round(c, 6).alias(c) for c in ("source_recall", "entity_recall", "mrr")), "n_hits")
        out = part if out is None else out.unionByName(part)
    return out


@_query(f"SELECT * EXCLUDE (stage) FROM ({_measured(f'WITH {_BM}', {'bm25': 'bmr'})})")
def retrieval_metrics(s, d):
    return _scores(s, d, {"bm25": bm25_batch_topk(s, d)}).drop("stage")


@_query(_measured(f"{_HYBRID}, {_RERANK}", {"dense_a": "dvr", "dense_b": "dwr", "bm25": "bmr", "rrf": "f", "rerank": "rr"}))
def stage_metrics(s, d):
    """What each stage of a search leaves of what there is to find."""
    v = _vectors(s, d)
    return _scores(s, d, search.stages(_docs(s, d), _asked(s, d), vectors={"a": v, "b": _turned(v)}, query_vectors={"a": _asked_vectors(v), "b": _asked_vectors(v)}))


# --- Streams, as batches ---------------------------------------------------------------------------------------------


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_activity(s, d):
    out = activity(_read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

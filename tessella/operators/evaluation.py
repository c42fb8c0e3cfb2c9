"""Retrieval measured against labels that the corpus gives itself: ids that occur in several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The form of a ticket id, and what looks like one.
TICKET = r"\b([A-Z]{2,10}-\d{1,6})\b"
NOT_TICKETS = ("UTF-8", "ISO-8859", "US-ASCII", "X-HTTP", "X-API", "X-CSRF")
# What is taken off the beginning of a ticket's and of a commit's title.
TICKET_PREFIX = r"^[A-Z]{2,10}-\d{1,6}\s*[-:]\s*"
COMMIT_PREFIX = r"^(feat|fix|chore|refactor|docs)\s*[:(]\s*"


def mentions(chunks: DataFrame, pattern: str = TICKET, not_these: tuple[str, ...] = NOT_TICKETS) -> DataFrame:
    """(entity, id, source, title, chunk_ord), one row per mention."""
    e = chunks.select(F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(pattern), 1)).alias("entity"), "id", "source", "title", "chunk_ord")
    return e.where(~F.col("entity").isin(*not_these) & ~F.col("entity").startswith("HTTP-") & ~F.col("entity").startswith("SHA-"))


def entities(found: DataFrame, least_sources: int = 2) -> DataFrame:
    """(entity, n_sources, mentions, n_chunks) of entities that occur in several sources."""
    return found.groupBy("entity").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("mentions"), F.countDistinct("id").alias("n_chunks")).where(F.col("n_sources") >= least_sources)


def synthesized_queries(found: DataFrame, chosen: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, text) for the n entities with the most sources, then mentions, that some title gives a question for:
    the ticket's own title without its id, else the first ticket's title, else a commit's title without its prefix."""
    title = F.trim(F.coalesce("title", F.lit("")))
    has = F.instr(title, F.col("entity")) > 0
    bare = F.trim(F.regexp_replace(title, TICKET_PREFIX, ""))
    subject = F.trim(F.regexp_replace(title, COMMIT_PREFIX, ""))
    ticket = F.col("source") == "atlassian"
    priority = F.when(ticket & has & (F.length(bare) > 10), 1).when(ticket & (F.length(title) > 10), 2).when((F.col("source") == "git") & has & (F.length(title) > 10), 3)
    text = F.when(F.col("p") == 1, bare).when(F.col("p") == 2, title).otherwise(subject)
    best = found.join(chosen, "entity").withColumn("p", priority).where("p is not null").withColumn("text", text)
    best = best.groupBy("entity", "n_sources", "mentions").agg(F.min_by("text", F.struct("p", "chunk_ord")).alias("text"))
    return best.orderBy(F.desc("n_sources"), F.desc("mentions"), "entity").limit(n).select(F.col("entity").alias("query_id"), "text")


def labels(found: DataFrame) -> DataFrame:
    """(query_id, id, source): chunks and sources that count as right for an entity's question."""
    return found.select(F.col("entity").alias("query_id"), "id", "source").distinct()


def scored(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, source_recall, entity_recall, mrr, n_hits, sources_found) of hits (query_id, source, rank from 1, ok) and
    what was to be found: (query_id, source, n_right), a row per right source.

    source_recall: share of the right sources among the hits' sources; entity_recall: share of the right chunks found;
    mrr: 1 / rank of the first right one; n_hits: how many right ones were found.  A question without hits has zeros."""
    found = hits.groupBy("query_id").agg(F.sum(F.col("ok").cast("bigint")).alias("n_hits"), F.max(F.when(F.col("ok"), 1 / F.col("rank"))).alias("mrr"))
    sources = expected.groupBy("query_id", "source").agg(F.sum("n_right").alias("n_right"))
    seen = sources.join(hits.select("query_id", "source").distinct().withColumn("seen", F.lit(1)), ["query_id", "source"], "left")
    # As many rows as there are sources.
    seen = seen.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.count("seen").alias("n_seen"), F.sum("n_right").alias("n_right"), F.sort_array(F.collect_list(F.when(F.col("seen") == 1, F.col("source")))).alias("sources_found"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return seen.join(found, "query_id", "left").select(
        "query_id", (F.col("n_seen") / F.col("n_sources")).alias("source_recall"), (zero("n_hits") / F.col("n_right")).alias("entity_recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), zero("n_hits").cast("bigint").alias("n_hits"), "sources_found")


def metrics(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """`scored` for hits (query_id, id, source, rank) and a table of what is right (query_id, id, source)."""
    right = truth.select("query_id", "id").distinct().withColumn("right", F.lit(True))
    marked = hits.join(right, ["query_id", "id"], "left").withColumn("ok", F.coalesce("right", F.lit(False)))
    return scored(marked, truth.groupBy("query_id", "source").agg(F.countDistinct("id").alias("n_right")))


STAGES = ("dense", "bm25", "rrf", "rerank")


def evaluate(stages: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Metrics of every stage's hits, with `stage`."""
    out = None
    for name, hits in stages.items():
        part = metrics(hits, truth).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def summary(measured: DataFrame) -> DataFrame:
    return measured.groupBy("stage").agg(*(F.avg(c).alias(c) for c in ("source_recall", "entity_recall", "mrr", "n_hits")))


def report(measured: DataFrame, asked: DataFrame, truth: DataFrame) -> list[dict]:
    """A mapping per question, for a file: what was asked, what was to be found, and every stage's metrics to three places.

    There are as many questions as `synthesized_queries` was asked for."""
    right = truth.groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.countDistinct("id").alias("n"))
    rows = asked.join(right, "query_id").join(measured, "query_id").orderBy("query_id", "stage").collect()
    out: dict[str, dict] = {}
    for r in rows:
        case = out.setdefault(r["query_id"], {"entity_key": r["query_id"], "query": r["text"], "expected_sources": r["sources"], "n_ground_truth": r["n"], "stages": {}})
        case["stages"][r["stage"]] = {c: round(r[c], 3) for c in ("source_recall", "entity_recall", "mrr")} | {"sources_found": r["sources_found"], "n_hits": r["n_hits"]}
    return list(out.values())


def cut(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import conversations, credentials, leaks, mojibake, neardup, pii, splitter, tokens
from .common import contents, read, records


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(contents(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(contents(spark, folder))


def _diffs(spark: SparkSession, folder: str) -> DataFrame:
    git = read(spark, folder, "git").select(F.lit("git").alias("tbl"), F.col("hash").alias("rec_id"), F.col("diff").alias("content"))
    return git.unionByName(records(spark, folder).drop("source"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_spans(spark, folder).select("tbl", "rec_id", "line_no").distinct()


def p2_spans(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.find_credentials(_diffs(spark, folder))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.redact_credentials(_diffs(spark, folder)).dropDuplicates(["tbl", "rec_id"])


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What redaction must leave and must not: the number of line ends of every text, and of key headers with key lines below."""
    open_key = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----\n[-+ ]?[A-Za-z0-9+/]{40,}"
    return p2_redacted(spark, folder).select("tbl", "rec_id", F.regexp_count("redacted", F.lit("\n")).cast("bigint").alias("n_line_ends"), F.regexp_count("redacted", F.lit(open_key)).cast("bigint").alias("n_open_keys"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(contents(spark, folder), read(spark, folder, "users")).select("tbl", "rec_id", "kind", "start_pos")


def p5_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_personal_data(contents(spark, folder), read(spark, folder, "users")).dropDuplicates(["tbl", "rec_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(read(spark, folder, "messages"), texts=False)


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(read(spark, folder, "messages"), read(spark, folder, "users"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitter.split_oversized(contents(spark, folder), read(spark, folder, "ingest_config"))
    return pieces.where("piece_no = 0").select("tbl", "rec_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.split_oversized(contents(spark, folder), read(spark, folder, "ingest_config"))


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized text put together again from its pieces, and the number of its pieces above the limit."""
    limits = read(spark, folder, "ingest_config").where("max_chunk_tokens is not null").groupBy("source").agg(F.min("max_chunk_tokens").alias("most"))
    rows = splitter.split_oversized(contents(spark, folder), read(spark, folder, "ingest_config"), keys=("tbl", "rec_id", "source"))
    before = F.coalesce(F.lag("end_pos").over(Window.partitionBy("tbl", "rec_id").orderBy("piece_no")), F.lit(0))
    words = F.size(F.array_remove(F.split(F.translate("piece", "\t\r\n", "   "), " "), ""))
    size = F.greatest(words, F.floor(F.length("piece") / 4))
    new = rows.join(limits, "source").withColumn("new", F.substring("piece", before - F.col("start_pos") + 1, F.length("piece"))).withColumn("over", (size > F.col("most")).cast("bigint"))
    # The pieces of one text, which was a row's value.
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"])
    return new.groupBy("tbl", "rec_id").agg(F.md5(F.array_join(parts, "")).alias("content"), F.sum("over").alias("n_over"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, folder, "documents"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every text read back from its ids."""
    return tokens.decode_corpus(p6_ids(spark, folder)).select("doc_id", F.md5("text").alias("text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(read(spark, folder, "documents"), read(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_restored(spark, folder).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.repair_mojibake(read(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_spans, p2_redacted, p2_kept, p3_found, p3_conversations, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_replaced, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_restored)}


_BOTH = "(SELECT DISTINCT 'records' AS tbl, id, source, content FROM records UNION SELECT DISTINCT 'chunks', id, source, content FROM chunks)"
_WORDS = r"list_filter(string_split_regex(content, '[ \t\r\n]+'), lambda t: t <> '')"

_P1 = rf"""WITH s AS (SELECT tbl, id, list_distinct(list_filter(string_split_regex(lower(content), '[ \t\r\n]+'), lambda t: t <> '')) AS w FROM {_BOTH} WHERE content IS NOT NULL),
t AS (SELECT tbl, id, len(w) AS n, unnest(w) AS token FROM s WHERE len(w) >= 30)
SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.tbl = b.tbl AND a.token = b.token AND a.id < b.id AND a.n > 0.75 * b.n AND b.n > 0.75 * a.n
GROUP BY a.tbl, a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*))::DOUBLE > 0.75"""

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_P3 = rf"""WITH m AS (SELECT * FROM (SELECT channel_id, try_cast(ts AS DECIMAL(24, 6)) AS ts, try_cast(thread_ts AS DECIMAL(24, 6)) AS th, text, coalesce(reply_count, 0) AS reply_count, coalesce(subtype, '') AS subtype,
row_number() OVER (PARTITION BY channel_id, try_cast(ts AS DECIMAL(24, 6)) ORDER BY scraped_at DESC NULLS LAST, reply_count DESC NULLS LAST, text DESC NULLS LAST) AS n FROM messages WHERE channel_id IS NOT NULL AND try_cast(ts AS DECIMAL(24, 6)) IS NOT NULL) WHERE n = 1),
k AS (SELECT *, coalesce(th, CASE WHEN reply_count > 0 THEN ts END) AS root, subtype IN {conversations.SYSTEM_SUBTYPES} AS sys FROM m),
l AS (SELECT *, sys OR coalesce(regexp_replace(text, '{_BLANK}', '', 'g'), '') = '' AS gone FROM k WHERE root IS NOT NULL),
c AS (SELECT channel_id, root FROM l GROUP BY ALL HAVING bool_or(ts = root) AND NOT bool_or(ts = root AND sys) AND max(CASE WHEN ts = root THEN reply_count END) <= count(*) FILTER (WHERE ts <> root) AND count(*) FILTER (WHERE NOT gone) >= 2)
SELECT channel_id, root::VARCHAR AS root_ts, row_number() OVER (PARTITION BY channel_id, root ORDER BY ts) AS pos, ts::VARCHAR AS ts FROM l JOIN c USING (channel_id, root) WHERE NOT gone"""

_P4 = f"SELECT DISTINCT tbl, id AS rec_id FROM {_BOTH} JOIN ingest_config USING (source) WHERE max_chunk_tokens IS NOT NULL AND greatest(len({_WORDS}), length(content) // 4) > max_chunk_tokens"

_P7 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, hash(w[k:k + 11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (h)"""


_P7_LEAKS = _P7.replace("SELECT DISTINCT doc_id, item_id FROM", "SELECT doc_id, item_id, count(*) AS n_windows FROM") + " GROUP BY doc_id, item_id"


_P1_GROUPS = rf"""WITH RECURSIVE pairs AS ({_P1}),
sets AS (SELECT tbl, id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[ \t\r\n]+'), lambda t: t <> ''))) AS w FROM {_BOTH} WHERE content IS NOT NULL),
cls AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, w) AS class_id, count(*) OVER (PARTITION BY tbl, w) AS copies FROM (SELECT DISTINCT tbl, id, w FROM sets WHERE len(w) >= 30)),
edges AS (SELECT tbl, id_a AS a, id_b AS b FROM pairs UNION ALL SELECT tbl, id_b, id_a FROM pairs),
reach(tbl, id, g) AS (SELECT tbl, id, id FROM cls UNION SELECT r.tbl, e.b, r.g FROM reach r JOIN edges e ON e.tbl = r.tbl AND e.a = r.id),
grp AS (SELECT tbl, id, min(g) AS group_id FROM reach GROUP BY tbl, id),
lnk AS (SELECT x.tbl, x.class_id, count(DISTINCT y.class_id) AS links FROM edges e JOIN cls x ON x.tbl = e.tbl AND x.id = e.a JOIN cls y ON y.tbl = e.tbl AND y.id = e.b WHERE x.class_id <> y.class_id GROUP BY ALL)
SELECT c.tbl, c.id AS rec_id, c.class_id, g.group_id, c.copies, coalesce(l.links, 0) AS links FROM cls c JOIN grp g USING (tbl, id) LEFT JOIN lnk l ON l.tbl = c.tbl AND l.class_id = c.class_id"""
_P2_KEPT = "SELECT DISTINCT tbl, rec_id, (length(content) - length(replace(content, chr(10), '')))::BIGINT AS n_line_ends, CASE WHEN content IS NOT NULL THEN 0::BIGINT END AS n_open_keys FROM (SELECT 'git' AS tbl, hash AS rec_id, diff AS content FROM git UNION ALL SELECT 'records', id, content FROM records)"
_P3_ROLES = _P3.replace("SELECT channel_id, try_cast(ts AS DECIMAL(24, 6)) AS ts,", "SELECT channel_id, user_id, try_cast(ts AS DECIMAL(24, 6)) AS ts,").replace("text DESC NULLS LAST)", "text DESC NULLS LAST, try_cast(thread_ts AS DECIMAL(24, 6)) DESC NULLS LAST, subtype DESC NULLS LAST, user_id DESC NULLS LAST)").replace(
    "c AS (SELECT channel_id, root FROM l GROUP BY ALL", "c AS (SELECT channel_id, root, max(CASE WHEN ts = root THEN user_id END) AS starter FROM l GROUP BY channel_id, root").replace(
    "ts::VARCHAR AS ts FROM l", "ts::VARCHAR AS ts, user_id, text, CASE WHEN user_id IN (SELECT id FROM users WHERE is_bot AND id IS NOT NULL) THEN 'bot' WHEN user_id = starter THEN 'starter' ELSE 'participant' END AS role FROM l")
_P4_REBUILT = _P4.replace("SELECT DISTINCT tbl, id AS rec_id FROM", "SELECT DISTINCT tbl, id AS rec_id, md5(content) AS content, 0::BIGINT AS n_over FROM")
_P6_DECODED = "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_groups": _P1_GROUPS, "p2_kept": _P2_KEPT, "p3_found": _P3, "p3_conversations": _P3_ROLES, "p4_found": _P4, "p4_rebuilt": _P4_REBUILT, "p6_decoded": _P6_DECODED, "p7_found": _P7, "p7_leaks": _P7_LEAKS}

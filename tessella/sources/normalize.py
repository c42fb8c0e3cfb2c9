"""Raw records of every source as documents (id, source, content, title, metadata, src_ord).

Each normalizer is a DataFrame function: projections and filters stay in one
stage; only threads need a shuffle.  Null fields count as missing, and missing
text as empty.  Contents shorter than the source's least length are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import int_value, make_metadata, text_value
from .raw import read_channels, read_raw, read_users

# Subtypes of messages that no person wrote.
SYSTEM_SUBTYPES = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "bot_message", "file_comment", "tombstone")
# The order in which sources are joined; of documents with one id the first stays.
ORDER = ("messages", "atlassian", "gdrive", "git", "files_extracted", "bookmarks", "pins", "bitbucket", "code")
LEAST = {"git": 10, "code": 100}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _document(rows: DataFrame, source: str, id_: Column, content: Column, title: Column, metadata: dict[str, Column]) -> DataFrame:
    out = rows.select(id_.alias("id"), F.lit(source).alias("source"), content.alias("content"), title.alias("title"), make_metadata(metadata).alias("metadata"), F.col("src_ord").cast("bigint").alias("src_ord"))
    return out.where(F.length("content") >= LEAST.get(source, 20))


def _s(c: Column | str) -> Column:
    return text_value(_text(c) if isinstance(c, str) else c)


def _names(users: DataFrame) -> DataFrame:
    """One row: a map of user id to name."""
    return users.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("id", "name"))), F.expr("CAST(map() AS map<string,string>)")).alias("names"))


#: Users whose names fit one map that goes to every task; with more, mentions are joined.
MAPPED_USERS = 50_000


def _with_names(rows: DataFrame, users: DataFrame) -> DataFrame:
    """`rows` with `names`, a map of user id to name that has those whom the text mentions."""
    one = users.where("id is not null").groupBy("id").agg(F.min(F.coalesce("name", "id")).alias("name"))
    if one.limit(MAPPED_USERS + 1).count() <= MAPPED_USERS:
        return rows.crossJoin(F.broadcast(_names(one)))  # a single row of a checked size
    # By a hash of the text, and of texts with a mention alone: no text is shuffled for its names.
    key = F.when(F.col("text").contains("<@"), F.sha2("text", 256))
    said = rows.select(key.alias("said"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"<@([\p{L}\p{N}_]+)>"), 1))).alias("id")).distinct()
    # A list has the users that one text mentions.
    names = said.join(one, "id").groupBy("said").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("names"))
    return rows.withColumn("said", key).join(names, "said", "left").drop("said").withColumn("names", F.coalesce("names", F.expr("CAST(map() AS map<string,string>)")))


def _spoken(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with cleaned text and the label of who wrote them."""
    one = users.select(F.col("id").alias("user_id"), F.col("name").alias("u_name"), F.col("title").alias("u_title")).dropDuplicates(["user_id"])
    rows = _with_names(messages, users)
    rows = rows.withColumn("clean", T.chat_text(_text("text"), F.col("names"))).drop("names")
    return rows.join(one, "user_id", "left").withColumn("label", T.user_label(F.col("u_name"), F.col("u_title"), F.col("user_id"))).drop("u_name", "u_title")


def messages(rows: DataFrame, users: DataFrame, channels: DataFrame | None = None, by_channel: bool = False) -> DataFrame:
    """Threads (rows of one thread_ts, or of the ts of a row with replies) and single messages.

    Threads are keyed by thread_ts alone; `by_channel` keys them by channel as well.  A thread is one document and so one
    row: it is put together in one task, and its text may have 2 GB at most, which is the limit of a row's value."""
    rows = rows.where(~F.coalesce(F.col("subtype").isin(*SYSTEM_SUBTYPES), F.lit(False)))
    rows = _spoken(rows, users)
    key = F.when(_text("thread_ts") != "", F.col("thread_ts")).when(F.coalesce("reply_count", F.lit(0)) > 0, F.col("ts"))
    at = F.coalesce(F.col("ts").try_cast("double"), F.lit(0.0))
    rows = rows.withColumn("key", key).withColumn("at", at).withColumn("said", F.when(F.col("clean") != "", F.concat("label", F.lit(": "), "clean")))
    keys = ["key", "channel_id"] if by_channel else ["key"]
    first = lambda c: F.min_by(c, F.struct("at", "src_ord"))
    threads = rows.where("key is not null").groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("at", "src_ord", "said")))), lambda x: x["said"]), "\n").alias("content"),
        first(_text("channel_name")).alias("channel"), first(F.col("channel_id")).alias("first_channel"), first(F.col("clean")).alias("clean"), F.min("at").alias("at"),
        F.count("*").alias("n"), F.sum(F.coalesce("reaction_count", F.lit(0))).alias("reactions"), F.min("src_ord").alias("src_ord"),
    ).drop("channel_id").withColumn("threaded", F.lit(0))
    single = rows.where("key is null").where(F.length("clean") >= 20).select(
        F.coalesce("ts", F.lit("0")).alias("key"), F.concat("label", F.lit(": "), "clean").alias("content"), _text("channel_name").alias("channel"), F.col("channel_id").alias("first_channel"),
        "clean", "at", F.lit(1).cast("bigint").alias("n"), F.coalesce("reaction_count", F.lit(0)).alias("reactions"), "src_ord",
    ).withColumn("threaded", F.lit(1))
    both = threads.unionByName(single)
    topic = F.lit(None).cast("string")
    if channels is not None:
        both = both.join(channels.select(F.col("id").alias("first_channel"), "topic").dropDuplicates(["first_channel"]), "first_channel", "left")
        topic = F.when((F.col("threaded") == 0) & (_text("topic") != ""), F.col("topic"))
    date = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    return _document(both, "slack", F.concat(F.lit("slack:"), "channel", F.lit(":"), "key"), F.col("content"), F.concat(F.lit("#"), "channel", F.lit(": "), F.substring("clean", 1, 80)), {
        "channel_name": _s(F.col("channel")), "message_count": int_value(F.col("n")), "reaction_count": int_value(F.col("reactions")), "date": _s(date), "channel_topic": text_value(topic),
    })


def atlassian(rows: DataFrame) -> DataFrame:
    ticket = _text("type") == "jira"
    kind = F.coalesce("type", F.lit("atlassian"))
    title = F.when(ticket, F.concat(_text("key"), F.lit(": "), _text("summary"))).otherwise(_text("title"))
    return _document(rows, "atlassian", F.concat(F.lit("atlassian:"), T.short_hash(title)), _text("content"), F.substring(title, 1, 120), {
        "source_type": _s(kind), "space": _s(F.when(ticket, _text("project")).otherwise(_text("space"))),
    })


def gdrive(rows: DataFrame) -> DataFrame:
    """Drive files without spreadsheets."""
    rows = rows.where(~(_text("mime_type").contains("spreadsheet") | (_text("file_type") == "Google Sheet")))
    return _document(rows, "gdrive", F.concat(F.lit("gdrive:"), F.coalesce("file_id", T.short_hash(_text("name")))), T.strip(_text("content")), F.substring(_text("name"), 1, 120), {
        "path": _s("path"), "doc_type": _s(F.replace(F.lower(F.coalesce("file_type", F.lit("doc"))), F.lit("google "), F.lit(""))),
    })


def git(rows: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Commits; `exclude` are patterns of paths whose files and diff sections are left out."""
    rows = rows.withColumn("diff", T.filter_diff(F.col("diff"), exclude or [])).withColumn("files_changed", T.filter_files(F.col("files_changed"), exclude or []))
    subject, body = T.strip(_text("subject")), T.strip(_text("body"))
    pr, branch = F.nullif(F.col("pr_number"), F.lit(0)), F.nullif(F.col("branch"), F.lit(""))
    files = F.when(F.size("files_changed") > 0, F.array_join(F.transform("files_changed", lambda f: F.concat(F.lit("  "), F.coalesce(f["status"], F.lit("")), F.lit(" "), F.coalesce(f["path"], F.lit("")))), "\n"))
    diff = F.when(_text("diff") != "", F.concat(F.lit("Diff:\n"), "diff")).when(_text("diff_stat") != "", F.concat(F.lit("Diff stat:\n"), "diff_stat"))
    content = F.concat_ws(
        "\n", subject, F.nullif(body, F.lit("")), F.concat(F.lit("Author: "), _text("author")), F.concat(F.lit("Date: "), _text("date")),
        F.concat(F.lit("PR: #"), pr.cast("string")), F.concat(F.lit("Branch: "), branch), F.concat(F.lit("Files changed:\n"), files), diff,
    )
    title = F.when(pr.isNotNull(), F.concat(_text("repo"), F.lit(" PR#"), pr.cast("string"), F.lit(": "), F.substring(subject, 1, 70))).otherwise(F.concat(_text("repo"), F.lit(": "), F.substring(subject, 1, 80)))
    id_ = F.concat(F.lit("git:"), F.when(_text("hash") != "", F.concat(_text("repo"), F.lit(":"), "hash")).otherwise(T.short_hash(content)))
    return _document(rows, "git", id_, content, title, {
        "repo": _s("repo"), "author": _s("author"), "date": _s("date"), "pr_number": int_value(pr), "branch": text_value(branch), "files_count": int_value(F.when(F.size("files_changed") > 0, F.size("files_changed"))),
    })


def files_extracted(rows: DataFrame) -> DataFrame:
    return _document(rows, "file", F.concat(F.lit("file:"), _text("file_id")), T.strip(_text("content")), F.coalesce("file_name", F.lit("unknown")), {
        "file_type": _s("file_type"), "extraction_method": _s("extraction_method"), "channel_name": _s("channel_name"),
    })


def bookmarks(rows: DataFrame) -> DataFrame:
    """Bookmarks with a title and a link, however short."""
    rows = rows.where((_text("title") != "") & (_text("link") != ""))
    return rows.select(
        F.concat(F.lit("bookmark:"), T.short_hash(F.col("link"))).alias("id"), F.lit("bookmark").alias("source"), F.concat("title", F.lit(": "), "link").alias("content"), "title",
        make_metadata({"channel_name": _s("channel_name"), "link": _s("link")}).alias("metadata"), F.col("src_ord").cast("bigint").alias("src_ord"),
    )


def pins(rows: DataFrame, users: DataFrame) -> DataFrame:
    rows = _with_names(rows, users).withColumn("clean", T.chat_text(_text("text"), F.col("names")))
    return _document(rows, "pin", F.concat(F.lit("pin:"), _text("channel_name"), F.lit(":"), F.coalesce("ts", F.lit("0"))), F.col("clean"), F.concat(F.lit("Pinned in #"), _text("channel_name"), F.lit(": "), F.substring("clean", 1, 60)), {"channel_name": _s("channel_name")})


def code(rows: DataFrame) -> DataFrame:
    where = F.concat(_text("repo"), F.lit("/"), _text("path"))
    rows = rows.where(F.length("content") >= 100)
    return _document(rows, "code", F.concat(F.lit("code:"), _text("repo"), F.lit(":"), _text("path")), F.concat(F.lit("# "), where, F.lit("\n\n"), "content"), where, {
        "repo": _s("repo"), "path": _s("path"), "language": _s("language"), "size_bytes": int_value(F.coalesce("size_bytes", F.lit(0))),
    })


def bitbucket(rows: DataFrame) -> DataFrame:
    """Pull requests: the description and every comment with text, with its author and path."""
    said = F.transform(F.filter(F.coalesce("comments", F.expr("array()")), lambda c: F.coalesce(c["content"], F.lit("")) != ""), lambda c: F.concat(
        F.coalesce(c["author"], F.lit("")), F.when(F.coalesce(c["path"], F.lit("")) != "", F.concat(F.lit(" on "), c["path"])).otherwise(""), F.lit(": "), c["content"]))
    about = T.strip(_text("description"))
    first = F.when(about != "", F.array(F.concat(_text("author"), F.lit(": "), about))).otherwise(F.expr("CAST(array() AS array<string>)"))
    content = F.array_join(F.concat(first, said), "\n")
    return _document(rows, "bitbucket", F.concat(F.lit("bitbucket:"), _text("repo"), F.lit(":"), F.coalesce("pr_id", F.lit(0)).cast("string")), content, F.substring(F.concat(_text("repo"), F.lit(" PR#"), F.coalesce("pr_id", F.lit(0)).cast("string"), F.lit(": "), _text("title")), 1, 120), {
        "repo": _s("repo"), "state": _s("state"), "source_branch": _s("source_branch"), "target_branch": _s("target_branch"),
        "comment_count": int_value(F.size(F.coalesce("comments", F.expr("array()")))), "approvals": _s(F.array_join(F.array_distinct(F.coalesce("approvals", F.expr("CAST(array() AS array<string>)"))), ", ")),
    })


def union_documents(parts: list[DataFrame]) -> DataFrame:
    """All parts in order; of documents with one id the first (by part, then place) stays."""
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, ranked)
    first = F.min_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct("source_rank", "src_ord", "content"))
    return rows.groupBy("id").agg(first.alias("r")).select("id", "r.*")


def normalize_all(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of raw files, with source_rank and src_ord as their order."""
    users, channels = read_users(spark, f"{folder}/users.json"), read_channels(spark, f"{folder}/channels.json")
    make: dict[str, Callable[[DataFrame], DataFrame]] = {
        "messages": lambda r: messages(r, users, channels), "atlassian": atlassian, "gdrive": gdrive, "git": git, "files_extracted": files_extracted,
        "bookmarks": bookmarks, "pins": lambda r: pins(r, users), "bitbucket": bitbucket, "code": code,
    }
    return union_documents([make[name](read_raw(spark, folder, name)) for name in ORDER])

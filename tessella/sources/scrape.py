"""What scrapers need from the engine: resuming, selection and raw projections (the calls themselves are in `scrapers`)."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def message_records(api: DataFrame) -> DataFrame:
    """Raw rows of chat API messages: links found, reactions counted."""
    count = F.aggregate(F.coalesce("reactions", F.expr("CAST(array() AS array<struct<name:string,count:bigint>>)")), F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["count"], F.lit(0)))
    return api.withColumn("reaction_count", count).withColumn("links", T.links(F.coalesce("text", F.lit(""))))


def high_water(messages: DataFrame) -> DataFrame:
    """(channel_id, last_ts, message_count): where the next run of a channel begins."""
    return messages.groupBy("channel_id").agg(F.max_by("ts", F.col("ts").try_cast("double")).alias("last_ts"), F.count("*").alias("message_count"))


def unseen(listed: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    """Listed items that are not yet there."""
    return listed.join(have.select(*keys).distinct(), list(keys), "left_anti")


def unknown_users(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Ids that wrote or are mentioned but are no known user."""
    wrote = messages.select(F.col("user_id").alias("id"))
    named = messages.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"<@([\p{L}\p{N}_]+)>"), 1)).alias("id"))
    return wrote.union(named).where("id is not null and id <> ''").distinct().join(users.select("id"), "id", "left_anti")


def attached_files(messages: DataFrame) -> DataFrame:
    """Files of messages, each id once, as of its first message."""
    rows = messages.select("channel_id", "channel_name", "user_id", "ts", F.explode("files").alias("f"))
    return rows.groupBy(F.col("f.id").alias("file_id")).agg(F.min_by(F.struct("channel_id", "channel_name", "user_id", "ts", F.col("f.name").alias("file_name"), F.col("f.filetype").alias("file_type"), F.col("f.mimetype").alias("mime_type"), F.col("f.size").alias("size")), F.struct(F.col("ts").try_cast("double"), "channel_id")).alias("r")).select("file_id", "r.*")


def folder_paths(folders: DataFrame, depth: int = 5) -> DataFrame:
    """(id, path) of folders (id, name, parent): names from the root down, at most `depth` of them."""
    out = folders.select("id", F.array(F.coalesce("name", F.lit(""))).alias("names"), F.col("parent").alias("up"))
    base = folders.select(F.col("id").alias("up"), F.coalesce("name", F.lit("")).alias("up_name"), F.col("parent").alias("next"))
    for _ in range(depth - 1):
        out = out.join(base, "up", "left").select("id", F.when(F.col("up_name").isNotNull(), F.concat(F.array("up_name"), "names")).otherwise(F.col("names")).alias("names"), F.col("next").alias("up"))
    return out.select("id", F.array_join("names", " > ").alias("path"))


def commits(log: DataFrame, exclude: list[str] | None = None, most_diff: int = 50_000) -> DataFrame:
    """Commit rows with PR number and branch read from the subject and excluded paths removed.

    A diff of more than `most_diff` characters is dropped, as a commit that large is generated or moved code: that is the
    format's own rule, and a parameter."""
    diff = F.when(F.length("diff") <= most_diff, F.col("diff"))
    return log.withColumn("pr_number", T.pr_number(F.col("subject"))).withColumn("branch", T.merged_branch(F.col("subject"))).withColumn("files_changed", T.filter_files(F.col("files_changed"), exclude or [])).withColumn("diff", T.filter_diff(diff, exclude or []))


# Source code endings, file names that are no code of one's own, and patterns of paths of generated, foreign
# and data files.
CODE_ENDINGS = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "sql", "sh")
SKIPPED_NAMES = ("__init__.py", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "uv.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum", "cargo.lock", "LICENSE", "NOTICE", "RECORD", "WHEEL", "METADATA")
SKIPPED_ENDINGS = (r"\.min\.js", r"\.min\.css", r"_pb2\.py", r"_pb2_grpc\.py", r"\.pb\.go")
SKIPPED_FOLDERS = ("vendor", "third_party", "node_modules", ".venv", "venv", "site-packages", "openapi", "openapi_client", "generated", "alembic/versions", "dist", "build", ".next", "__pycache__", ".vscode", ".idea", "swagger-ui", "htmlcov", "snapshots", "__snapshots__", "data/corpora", "data/tokenizers", "data/raw", "load_test", "stopwords")
SKIPPED_STARTS = ("static/swagger", ".coverage", "output/model-")


def wanted_code(path: Column, size: Column, least: int = 100, most: int = 100_000) -> Column:
    """Whether a file is code to read: by its ending, name, folders and size."""
    quoted = lambda names: "|".join(map(re.escape, names))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*CODE_ENDINGS)
    name = F.regexp_extract(path, r"([^/]+)$", 1).isin(*SKIPPED_NAMES)
    skipped = path.rlike(rf"({'|'.join(SKIPPED_ENDINGS)})$") | path.rlike(rf"(^|/)(({quoted(SKIPPED_FOLDERS)})/|{quoted(SKIPPED_STARTS)})")
    return ending & ~name & ~skipped & size.between(least, most)


def code_files(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """Raw code records of a checked-out tree.  Size and path are judged before a file is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + str(PurePosixPath(root.split(":", 1)[-1])).replace(".", "\\."), "")
    files = files.withColumn("rel", F.ltrim(path, F.lit("/")))
    rows = files.where(wanted_code(F.col("rel"), F.col("length"))).withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return rows.where(F.col("text").isNotNull() & (T.control_share(F.col("text")) <= 0.1)).select(F.lit(repo).alias("repo"), F.col("rel").alias("path"), T.language(F.col("rel")).alias("language"), F.col("text").alias("content"), F.col("length").alias("size_bytes"))

"""Schemas: raw sources, documents, chunks and metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A metadata scalar: kind, its text, its number where it has one, and its case-folded text.
META = "struct<kind:string,s:string,d:double,cf:string>"
DOCUMENT = f"id string, source string, content string, title string, metadata map<string,{META}>"
CHUNK = DOCUMENT.replace("id string,", "id string, doc_id string,", 1) + ", chunk_idx int"

RAW = {
    "messages": "channel_id string, channel_name string, user_id string, ts string, thread_ts string, text string, is_reply boolean, reply_count bigint, subtype string, reactions array<struct<name:string,count:bigint>>, reaction_count bigint, files array<struct<id:string,name:string,filetype:string,mimetype:string,size:bigint,url_private_download:string>>, links array<string>",
    "pins": "channel_id string, channel_name string, user_id string, ts string, text string, pinned_by string",
    "bookmarks": "channel_id string, channel_name string, title string, link string, emoji string, created_by string",
    "files": "channel_id string, channel_name string, user_id string, ts string, file_id string, file_name string, file_type string, mime_type string, size bigint, local_path string",
    "files_extracted": "channel_id string, channel_name string, user_id string, ts string, file_id string, file_name string, file_type string, mime_type string, size bigint, local_path string, content string, extraction_method string",
    "atlassian": "type string, title string, content string, space string, ancestors string, key string, summary string, project string",
    "gdrive": "file_id string, name string, owner string, content string, mime_type string, file_type string, path string",
    "git": "repo string, hash string, author string, date string, subject string, body string, diff_stat string, files_changed array<struct<status:string,path:string>>, pr_number bigint, branch string, diff string",
    "code": "repo string, path string, language string, content string, size_bytes bigint",
    "bitbucket": "repo string, pr_id bigint, title string, description string, author string, state string, source_branch string, target_branch string, created_on string, updated_on string, comments array<struct<author:string,content:string,created_on:string,path:string,line:bigint>>, approvals array<string>",
}
RECORD = "id string, source string, content string, title string, metadata string"


def _value(kind: str, s: Column, d: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s.alias("s"), d.alias("d"), F.lower(s).alias("cf"))


def text_value(c: Column) -> Column:
    return _value("str", c, F.lit(None).cast("double"))


def int_value(c: Column) -> Column:
    return _value("int", c.cast("string"), c.cast("double"))


def text_metadata(c: Column) -> Column:
    """map<string,string> as metadata; a null map is empty."""
    return F.coalesce(F.transform_values(c, lambda _, v: text_value(v)), F.expr(f"CAST(map() AS map<string,{META}>)"))


def make_metadata(fields: dict[str, Column]) -> Column:
    """Metadata of named values; a null value leaves its key out."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"]["s"].isNotNull())).cast(f"map<string,{META}>")


def with_value(meta: Column, key: str, value: Column) -> Column:
    """`meta` with `key` set, whatever it was."""
    return F.map_concat(F.map_filter(meta, lambda k, _: k != key), F.create_map(F.lit(key), value)).cast(f"map<string,{META}>")

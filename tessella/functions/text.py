"""Text functions as column expressions, evaluated in the JVM.  Nulls stay null unless a function says otherwise."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every blank but the space.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words(c: Column, lower: bool = True) -> Column:
    """Runs of non-blank characters, lower-cased unless told otherwise; null gives an empty array."""
    c = F.coalesce(c, F.lit(""))
    spaced = F.translate(F.lower(c) if lower else c, _BLANKS, " " * len(_BLANKS))
    # A single character is split without a pattern, and removing is code that Spark generates.
    return F.array_remove(F.split(spaced, " "), "")


def approx_tokens(c: Column) -> Column:
    """The greater of the number of words and a quarter of the code points, rounded down; null counts as empty."""
    return F.greatest(F.size(words(c, False)), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def chat_text(c: Column, mentions: Column | None = None) -> Column:
    """Chat markup as plain text.  `mentions` is a map of user id to name for `<@id>`; an unknown id stays as it is."""
    ids = F.array_distinct(F.regexp_extract_all(c, F.lit(r"<@([\p{L}\p{N}_]+)>"), 1))
    known = mentions if mentions is not None else F.expr("CAST(map() AS map<string,string>)")
    c = F.aggregate(ids, c, lambda acc, i: F.replace(acc, F.concat(F.lit("<@"), i, F.lit(">")), F.concat(F.lit("@"), F.coalesce(F.try_element_at(known, i), i))))
    # Fixed values, in this order: mail, telephone, channel, labelled link, bare link, emoji, bold, italic, struck out.
    for pattern, to in (
        (r"<mailto:([^|>]+)\|([^>]+)>", "$2"),
        (r"<tel:([^|>]+)\|([^>]+)>", "$2"),
        (r"<#[\p{L}\p{N}_]+\|([^>]+)>", "#$1"),
        (r"<(https?://[^|>]+)\|([^>]+)>", "$2"),
        (r"<(https?://[^>]+)>", "$1"),
        (r":[\p{L}\p{N}_+\-]+:", ""),
        (r"\*([^*]+)\*", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"~([^~]+)~", "$1"),
        (r"[ \t]+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def links(c: Column) -> Column:
    """Addresses of `<address>` and `<address|label>`."""
    return F.regexp_extract_all(c, F.lit(r"<(https?://[^|>]+)(?:\|[^>]*)?>"), 1)


# Fixed values, in this order: the tags that become text, every other tag, entities, runs of line ends.
HTML_STEPS = (
    (r"<br\s*/?>", "\n"), (r"<li[^>]*>", "- "), (r"<h[1-6][^>]*>", "\n## "), (r"</h[1-6]>", "\n"), (r"<p[^>]*>", "\n"), (r"<[^>]+>", ""),
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n"),
)


def html_to_text(c: Column) -> Column:
    for pattern, to in HTML_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def epoch_date(c: Column) -> Column:
    """UTC date text of epoch seconds in a string."""
    return F.date_format(F.timestamp_seconds(F.expr("0") + c.try_cast("double")), "yyyy-MM-dd")


def user_label(name: Column, title: Column, user_id: Column) -> Column:
    name = F.coalesce(name, user_id, F.lit(""))
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(name, F.lit(" ("), title, F.lit(")"))).otherwise(name)


def pr_number(c: Column) -> Column:
    return F.regexp_extract(c, r"pull request #(\d+)", 1).try_cast("bigint")


def merged_branch(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)Merged in (\S+)", 1), F.lit(""))


def filter_diff(diff: Column, exclude: list[str]) -> Column:
    """A unified diff without the files whose path matches one of `exclude`, and without blank sections."""
    if not exclude:
        return diff
    out = F.lit(False)
    path = lambda s: F.regexp_extract(s, r"^diff --git a/(\S+) b/", 1)
    kept = lambda s: (F.trim(F.regexp_replace(s, r"\s", "")) != "") & ~((path(s) != "") & _any(path(s), exclude, out))
    return F.when(F.coalesce(diff, F.lit("")) == "", diff).otherwise(F.array_join(F.filter(F.split(diff, r"(?m)(?=^diff --git a/)"), kept), ""))


def filter_files(files: Column, exclude: list[str]) -> Column:
    return F.filter(files, lambda f: ~_any(f["path"], exclude, F.lit(False))) if exclude else files


def _any(c: Column, patterns: list[str], none: Column) -> Column:
    for p in patterns:
        none = none | c.rlike(p)
    return none


def control_share(c: Column, sample: int = 1024) -> Column:
    """Share of control characters (other than tab, LF and CR) in the beginning; empty counts as 1."""
    s = F.substring(c, 1, sample)
    return F.when(F.length(s) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(s, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", "")) / F.length(s))


def snippet(c: Column, length: int, term: str = "") -> Column:
    """`length` characters around the first `term`, or the beginning; line ends become spaces.  A length of 0 is the whole."""
    c = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    if length <= 0:
        return c
    n = F.length(c)
    head = F.concat(F.substring(c, 1, length), F.when(n > length, "...").otherwise(""))
    out = head
    if term:
        pos = F.instr(F.lower(c), term.lower()) - 1
        start = F.greatest(F.lit(0), pos - length // 4)
        end = F.least(n, start + length)
        around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(c, start + 1, F.lit(length)), F.when(end < n, "...").otherwise(""))
        out = F.when(pos >= 0, around).otherwise(head)
    return F.when(n <= length, c).otherwise(out)


def short_title(c: Column, width: int = 80) -> Column:
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 3), F.lit("...")))


def parse_date(s: str, today: date | None = None) -> str:
    """YYYY-MM-DD of a date or of an age such as 90d, 2w, 3m (30 days each) or 1y (365 days)."""
    s = s.strip().lower()
    if m := re.fullmatch(r"(\d+)([dwmy])", s):
        days = int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]]
        return ((today or date.today()) - timedelta(days=days)).isoformat()
    return date.fromisoformat(s).isoformat()


def record_id(chunk_id: Column) -> Column:
    """The id of the record that a chunk id belongs to."""
    return F.regexp_replace(chunk_id, r":[^:]*$", "")


# File endings and their languages.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "sql": "sql", "sh": "shell"}


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("unknown"))

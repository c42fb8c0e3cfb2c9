"""Items above a size limit, cut into overlapping pieces at natural boundaries.

A text is split by sections; parts that are still above the limit by paragraphs,
lines, sentences, words and at last characters.  The parts are packed greedily
up to the limit, and every piece but the first begins with the end of the one
before.  Pieces are spans of the source, so nothing is lost or rewritten.

A part that fits the limit stays whole: where it fits only without the full
overlap, the overlap is what still fits, and the part is not cut for its sake.
Else the overlap is what was asked, less at most 7 tokens so that it begins at a
word; a word above 32 characters is cut.  Every piece says how much it overlaps.

The size of a text is the greater of its number of words and a quarter of its
code points, rounded down.  A null limit or null content never splits; a null
overlap counts as 0, one of the limit or more as one below the limit, as every
piece must bring something new.  Empty and blank texts are one piece at most.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^ \t\r\n]+")
# Each level's pattern ends where a new part begins.
LEVELS = (
    ("section", re.compile(r"\n(?=#{1,6} |diff --git |=== )")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n+")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"”’»)\]]*[ \t]+|(?<=[。！？；])")),
    ("word", re.compile(r"[ \t\r\n]+")),
)


def size(text: str) -> int:
    return max(len(_WORD.findall(text)), len(text) // 4)


#: Longest word that an overlap is not begun within.
LONG_WORD = 32


def _parts(text: str, start: int, end: int, level: int, limit: int, step: int) -> list[tuple[int, int, int]]:
    """Spans (start, end, words) that fill [start, end), none above `limit`; runs of characters are cut every `step` tokens."""
    n = len(_WORD.findall(text, start, end))
    if max(n, (end - start) // 4) <= limit:
        return [(start, end, n)]
    if level == len(LEVELS):
        return [(i, min(i + 4 * step, end), 1) for i in range(start, end, 4 * step)]
    cuts = [m.end() for m in LEVELS[level][1].finditer(text, start, end) if start < m.end() < end]
    out = []
    for a, b in zip([start, *cuts], [*cuts, end]):
        out += _parts(text, a, b, level + 1, limit, step)
    return out


def _tail(text: str, start: int, end: int, overlap: int) -> int:
    """Where the last `overlap` tokens of [start, end) begin: at a word, unless the one there is above `LONG_WORD`."""
    if overlap <= 0:
        return end
    at = max(start, end - 4 * overlap - 3)
    ws = [m.start() for m in _WORD.finditer(text, at, end)]
    if len(ws) > overlap:
        at = ws[-overlap]
    if at == start or text[at - 1] in " \t\r\n" or text[at] in " \t\r\n":
        return at
    # Within a word: on to the next, if the word is one.
    a, b = at, at
    while a > start and at - a <= LONG_WORD and text[a - 1] not in " \t\r\n":
        a -= 1
    while b < end and b - a <= LONG_WORD and text[b] not in " \t\r\n":
        b += 1
    return b if b - a <= LONG_WORD and b < end else at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of consecutive pieces, each within `limit`, that together cover `text`."""
    if size(text) <= limit:
        return [(0, len(text))]
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    out: list[tuple[int, int]] = []
    start, words, last = 0, 0, 0
    todo = _parts(text, 0, len(text), 0, limit, max(1, limit - overlap))[::-1]
    while todo:
        a, b, n = todo.pop()
        if max(words + n, (b - start) // 4) > limit:
            if a > last:
                out.append((start, a))
                last = a
                start = _tail(text, start, a, overlap)
                words = len(_WORD.findall(text, start, a))
            # The part is whole within the limit: the overlap gives way where both don't fit.
            for less in range(overlap - 1, -1, -1):
                if max(words + n, (b - start) // 4) <= limit:
                    break
                start = _tail(text, start, a, min(less, limit - max(n, (b - a) // 4)))
                words = len(_WORD.findall(text, start, a))
        words += n
    if last < len(text):
        out.append((start, len(text)))
    return out


def split_oversized(df: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("tbl", "rec_id"), text_col: str = "content", source_col: str = "source") -> DataFrame:
    """(*keys, piece_no, start_pos, end_pos, overlap, piece) of every row of `df` above its source's max_chunk_tokens.

    overlap is the size of what a piece shares with the one before.  `limits` has source, max_chunk_tokens and chunk_overlap_tokens; repeated sources take the smallest limit.  Repeated
    rows come out once.  Rows within their limit don't come out."""
    per = limits.where(F.col("max_chunk_tokens").isNotNull()).groupBy(F.col("source").alias("__source")).agg(F.min(F.struct("max_chunk_tokens", "chunk_overlap_tokens")).alias("__l"))
    rows = df.select(*keys, F.col(source_col).alias("__source"), F.col(text_col).alias("__text")).join(per, "__source")
    # A text of n words has 2n - 1 characters at least: shorter ones can't be oversized.
    rows = rows.where(F.length("__text") >= 2 * F.col("__l.max_chunk_tokens") - 1)
    rows = rows.select(*keys, F.col("__l.max_chunk_tokens").alias("__limit"), F.col("__l.chunk_overlap_tokens").alias("__overlap"), "__text")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            at, no, starts, ends, shared, texts = [], [], [], [], [], []
            limit, overlap = b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()
            for i, t in enumerate(b.column(len(keys) + 2)):
                t = t.as_py()
                if size(t) <= limit[i]:
                    continue
                before = 0
                for k, (s, e) in enumerate(pieces(t, limit[i], overlap[i] or 0)):
                    at.append(i), no.append(k), starts.append(s), ends.append(e), shared.append(size(t[s:before])), texts.append(t[s:e])
                    before = e
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(shared, pa.int32()), pa.array(texts, pa.string())], [*keys, "piece_no", "start_pos", "end_pos", "overlap", "piece"])

    return rows.mapInArrow(run, schema + ", piece_no int, start_pos int, end_pos int, overlap int, piece string").dropDuplicates([*keys, "start_pos", "end_pos", "piece_no"])

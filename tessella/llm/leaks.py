"""Passages of held-out items inside a training corpus.

The smallest leak that counts is a run of `least` words, so what is looked for is
a window of that many words (8 shingles of 5 words) inside texts of any length.
Documents are partitioned by size: a document of n windows belongs to the class
of the power of two above n, and its signature has a MinHash value for every
window, of which neighbours mostly share theirs; so a class has signatures of a
length its bound sets, and containment 1 in a document of any class is
similarity 1 with one of its windows.  An item's windows ask every class.
Equal values are joined, and the words of the window themselves are compared:
all its shingles are contained, in their order.

Null or empty texts and passages, and those under `least` words, never match.
Repeated rows count once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

LEAST, WIDTH = 12, 5
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if not text:
        return []
    return _WORD.findall(text.lower()) if "İ" not in text else [w.lower() for w in _WORD.findall(text)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, n: int, width: int) -> np.ndarray:
    """Mixed hashes of the runs of `width` values."""
    k = n - width + 1
    s = h[:k].copy()
    for i in range(1, width):
        s = s * _ODD + h[i:i + k]
    return _mix(s)


def window_minima(h: np.ndarray, least: int, width: int) -> np.ndarray:
    """The MinHash value of each window of `least` words whose hashes are `h`."""
    s = _rolled(h, len(h), width)
    k = len(h) - least + 1
    m = s[:k].copy()
    for i in range(1, least - width + 1):
        np.minimum(m, s[i:i + k], out=m)
    return m


class _Hashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[w] = h
        return h


def size_class(n: int) -> int:
    """The partition of a document of n windows: 2 ** (c - 1) < n <= 2 ** c."""
    return max(0, n - 1).bit_length()


#: Windows of a document that its class allows at most; no text of 2 GB has more words.
CLASSES = 32


def _signatures(df: DataFrame, id_col: str, text_col: str, out: str, least: int, width: int) -> DataFrame:
    """(out, size_class, bucket): the distinct MinHash values of each text's windows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        known = _Hashes()
        for b in batches:
            rows, classes, buckets = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ws = words(t)
                if len(ws) < least:
                    continue
                m = np.unique(window_minima(np.array([known[w] for w in ws], np.uint64), least, width))
                rows.append(np.full(len(m), i, np.int64)), buckets.append(m.view(np.int64))
                classes.append(np.full(len(m), size_class(len(ws) - least + 1), np.int32))
            cat = lambda x, t=np.int64: np.concatenate(x) if x else np.empty(0, t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cat(rows))), pa.array(cat(classes, np.int32)), pa.array(cat(buckets))], [out, "size_class", "bucket"])

    return df.select(F.col(id_col), F.col(text_col)).where(F.length(text_col) >= 2 * least - 1).mapInArrow(run, f"`{out}` {kind}, size_class int, bucket bigint")


def windows_of(ws: list[str], least: int = LEAST) -> set[tuple[str, ...]]:
    return {tuple(ws[k:k + least]) for k in range(len(ws) - least + 1)}


#: Words of all passages together that are shipped to the scan of the corpus; above it both sides are shuffled by bucket.
SHIPPED_WORDS = 1_000_000


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", passage_col: str = "passage", least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """Distinct (doc_id, item_id, n_windows) where at least `least` consecutive words of the passage stand consecutively in
    the text: n_windows of the passage's distinct windows of that many words do.

    Whether the passages are shipped whole depends on their counted size; the result does not."""
    passages = items.select(F.col(item_id).alias("item"), F.col(passage_col).alias("passage")).where(F.length("passage") >= 2 * least - 1).distinct()
    size = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0] // 2  # a word has a character and a blank
    found = _scan(docs, passages, doc_id, text_col, least, width) if size <= SHIPPED_WORDS else _joined(docs, passages, doc_id, text_col, least, width)
    # A repeated document, or an item under two passages, counts once, with the most that was found of it.
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("n_windows").alias("n_windows"))


def _verified(pairs: DataFrame, least: int) -> DataFrame:
    """(doc, item, n_windows) of pairs (doc, item, text, passage) that share a window, word for word."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches):
        for b in batches:
            n = [len(windows_of(words(t), least) & windows_of(words(p), least)) for t, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc", "item", "n_windows"]).filter(pa.array([x > 0 for x in n], pa.bool_()))

    return pairs.select("doc", "item", "text", "passage").mapInArrow(run, f"doc {kinds['doc']}, item {kinds['item']}, n_windows bigint")


def _joined(docs: DataFrame, passages: DataFrame, doc_id: str, text_col: str, least: int, width: int) -> DataFrame:
    """Signatures of both sides joined by size class and value.  A value that all documents have (a licence header) is split
    by class, and within a class by the adaptive skew join, as the item side has few rows of it."""
    asked = _signatures(passages, "item", "passage", "item", least, width).select("item", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("size_class"), "bucket").distinct()
    pairs = _signatures(docs, doc_id, text_col, "doc", least, width).join(asked, ["size_class", "bucket"]).select("doc", "item").distinct()
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text"))
    return _verified(pairs.join(texts, "doc").join(passages, "item"), least)


def _scan(docs: DataFrame, passages: DataFrame, doc_id: str, text_col: str, least: int, width: int) -> DataFrame:
    rows = [(r[0], words(r[1])) for r in passages.collect()]  # at most SHIPPED_WORDS words
    of: dict[tuple[str, ...], list] = {}
    for i, ws in rows:
        for w in windows_of(ws, least):
            of.setdefault(w, []).append(i)
    known = _Hashes()
    asked = [window_minima(np.array([known[w] for w in ws], np.uint64), least, width) for _, ws in rows if len(ws) >= least]
    shipped = docs.sparkSession.sparkContext.broadcast((np.unique(np.concatenate(asked)) if asked else np.empty(0, np.uint64), of))
    d_kind, i_kind = docs.schema[doc_id].dataType.simpleString(), passages.schema["item"].dataType.simpleString()

    def run(batches):
        buckets, of = shipped.value
        # A table of bits answers most of the searches.
        bits = np.zeros(1 << 20, bool)
        bits[buckets & np.uint64(0xFFFFF)] = True
        known = _Hashes()
        for b in batches:
            lists = [words(t) for t in b.column(1).to_pylist()]
            # By size class: documents of one class have signatures of like length, and are looked up together.
            parts: dict[int, list[int]] = {}
            for i, ws in enumerate(lists):
                if len(ws) >= least:
                    parts.setdefault(size_class(len(ws) - least + 1), []).append(i)
            docs_at, found, counts = [], [], []
            for members in parts.values():
                ends = np.cumsum([len(lists[i]) for i in members])
                h = np.fromiter((known[w] for i in members for w in lists[i]), np.uint64, int(ends[-1]))
                if not len(buckets):
                    continue
                m = window_minima(h, least, width)
                at = np.flatnonzero(bits[m & np.uint64(0xFFFFF)])
                doc = np.searchsorted(ends, at, side="right")
                inside = at + least <= ends[doc]
                at, doc = at[inside], doc[inside]
                pos = np.searchsorted(buckets, m[at])
                hit = buckets[np.minimum(pos, len(buckets) - 1)] == m[at]
                seen: dict[tuple, set] = {}
                for p, d in zip(at[hit].tolist(), doc[hit].tolist()):
                    i = members[d]
                    first = p - (int(ends[d]) - len(lists[i]))
                    w = tuple(lists[i][first:first + least])
                    for item in of.get(w, ()):  # the words themselves
                        seen.setdefault((i, item), set()).add(w)
                for (i, item), ws in seen.items():
                    docs_at.append(i), found.append(item), counts.append(len(ws))
            columns = [b.column(0).take(pa.array(docs_at, pa.int64())), pa.array(found, item_type), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "item", "n_windows"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(passages.schema["item"].dataType)
    return spread(docs.select(F.col(doc_id), F.col(text_col))).where(F.length(text_col) >= 2 * least - 1).mapInArrow(run, f"doc {d_kind}, item {i_kind}, n_windows bigint")
